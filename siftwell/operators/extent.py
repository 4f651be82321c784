"""What of a file an answer shows: the names inside a hit, the declaration a
question asked for, and how far a declaration or a section reaches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import explode_lines, hyphenated
from siftwell.operators.chunker import text_lines

DOC_LINES, DECLARATION_LINES, SHOWN_NAMES = 15, 80, 8
_DOC_MARKS = ("//", "/**", "*", "#", "@")
LEVELS = 6


def inside_hits(hits: DataFrame, chunks: DataFrame, *keep: str) -> DataFrame:
    """(query_id, rank, keep, chunk, ord, name, line): the declared names of the chunks
    that lie inside each hit's lines. ``hits`` (query_id, rank, file_id,
    start_line, end_line), a few per question."""
    own = chunks.select("file_id", F.col("chunk_id").alias("chunk"), F.col("start_line").alias("a"), F.col("end_line").alias("b"), "names")
    held = hits.select("query_id", "rank", "file_id", "start_line", "end_line", *keep).join(own, "file_id").where((F.col("a") >= F.col("start_line")) & (F.col("b") <= F.col("end_line")))
    return held.select("query_id", "rank", *keep, "chunk", F.posexplode("names").alias("ord", "x")).select("query_id", "rank", *keep, "chunk", "ord", F.col("x.name").alias("name"), F.col("x.line").alias("line")).where("name is not null")


def span_names(hits: DataFrame, chunks: DataFrame, k: int = SHOWN_NAMES) -> DataFrame:
    """(query_id, rank, names): the first ``k`` names inside each hit."""
    order = Window.partitionBy("query_id", "rank").orderBy("chunk", "ord")
    first = inside_hits(hits, chunks).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return first.groupBy("query_id", "rank").agg(F.array_sort(F.collect_list(F.struct("n", "name")))["name"].alias("names"))


def asked_words(text: Column) -> Column:
    """Words of a question that may be a declared name, in lower case."""
    plain = F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}_$]+"), lambda w: w != "")
    return F.transform(F.concat(plain, hyphenated(text)), F.lower)


def asked_declarations(hits: DataFrame, queries: DataFrame, chunks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, name, line): the first declaration inside each hit that the
    question names. ``titles`` (query_id, chunk_id, name) adds page headings that
    title a question."""
    words = queries.select("query_id", asked_words(F.col("text")).alias("words"))
    found = inside_hits(hits, chunks).join(words, "query_id")
    named = F.array_contains("words", F.lower("name"))
    if titles is not None:
        t = titles.select("query_id", F.col("chunk_id").alias("chunk"), "name", F.lit(True).alias("titled")).distinct()
        found = found.join(t, ["query_id", "chunk", "name"], "left")
        named = named | F.coalesce("titled", F.lit(False))
    return found.where(named).groupBy("query_id", "rank").agg(F.min(F.struct("chunk", "ord", "name", "line")).alias("x")).select("query_id", "rank", "x.name", "x.line")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def declaration_extent(lines: list[str], declared: int) -> tuple[int, int]:
    """First and last line (from 1) of what line ``declared`` declares: the comments
    and attributes right above it, and its body by indentation. A name behind a
    closing brace reaches back to the line that opened."""
    at = declared - 1
    depth = _indent(lines[at])
    if lines[at].lstrip().startswith("}"):
        above = (i for i in range(at - 1, -1, -1) if lines[i].strip() and _indent(lines[i]) <= depth)
        return next(above, at) + 1, declared

    def documents(line: str) -> bool:
        t = line.lstrip()
        return t.startswith(_DOC_MARKS) and (t[0] == "*" or _indent(line) == depth)

    def goes_on(i: int) -> bool:
        return _indent(lines[i]) > depth or (closes(i) and lines[i].rstrip().endswith(("{", "(", "[", ":", "=>")))

    def closes(i: int) -> bool:
        body = lines[i].strip()
        return body[0] in "})]" or body == "end"

    docs = sum(1 for _ in takewhile(documents, reversed(lines[max(0, at - DOC_LINES) : at])))
    written = [i for i in range(at + 1, len(lines)) if lines[i].strip()] if at + 1 < len(lines) else []
    body = list(takewhile(goes_on, written))
    beyond = written[len(body)] if len(body) < len(written) else None
    last = beyond if beyond is not None and closes(beyond) else body[-1] if body else at
    return at - docs + 1, last + 1


def declaration_extents(texts: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, line, first, last) of ``declared`` (key, line) in ``texts`` (key, text).
    Each text is cut into lines once; lines beyond its end give no row."""
    lines = declared.where("line >= 1").groupBy(key).agg(F.collect_set("line").alias("at"))  # at most one entry per line of the text
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text, at in zip(pdf[key], pdf["text"], pdf["at"]):
                own = text_lines(text)
                out += [(k, int(n), *declaration_extent(own, int(n))) for n in at if n <= len(own)]
            yield pd.DataFrame(out, columns=[key, "line", "first", "last"])

    return texts.where("text is not null").select(key, "text").join(lines, key).mapInPandas(run, f"{key} {kind}, line int, first int, last int")


def section_extents(pages: DataFrame, key: str) -> DataFrame:
    """(key, line, title, last): each heading of pages (key, text) with the last
    written line before the next heading of its level or above, outside fences.
    One window per page; fence parity is a running sum."""
    ls = explode_lines(pages.select(key, "text")).withColumn("fence", F.col("content").rlike(r"^\s*(?:```|~~~)").cast("int"))
    down = Window.partitionBy(key).orderBy("line")
    ls = ls.withColumn("open", F.sum("fence").over(down.rowsBetween(Window.unboundedPreceding, 0)) % 2)
    mark = F.char_length(F.regexp_extract("content", r"^\s*(#+) ", 1))
    ls = ls.withColumn("stop", F.when((F.col("open") == 0) & (F.col("fence") == 0) & (mark > 0), mark))
    ls = ls.withColumn("written", F.when(F.col("content").rlike(r"(?U)\S"), F.col("line")))
    ls = ls.withColumn("above", F.max("written").over(down.rowsBetween(Window.unboundedPreceding, -1))).withColumn("bottom", F.max("written").over(Window.partitionBy(key)))
    after = down.rowsBetween(1, Window.unboundedFollowing)
    for n in range(1, LEVELS + 1):
        ls = ls.withColumn(f"next{n}", F.min(F.when(F.col("stop") <= n, F.struct("line", "above"))).over(after))
    title = F.regexp_extract("content", r"^#{1,6}[ \t]+(.*?)[#\s]*$", 1)
    own = F.char_length(F.regexp_extract("content", r"^(#+)", 1))
    ends = F.coalesce(*[F.when(own == n, F.col(f"next{n}")) for n in range(1, LEVELS + 1)])
    heads = ls.where((F.col("open") == 0) & (F.col("fence") == 0) & (title != ""))
    return heads.select(key, "line", title.alias("title"), F.greatest(F.coalesce(ends["above"], F.col("bottom")), F.col("line")).alias("last"))
