"""Where a name or a text occurs: what was asked for, the lines that answer it,
which of them are shown, and what there is beyond the path asked for."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import lookup

WORD, TEXT, PATTERN = "word", "text", "pattern"
ELSEWHERE = 3
_PATH_OF_NAMES = re.compile(r"(?:::|->|[.\\$]|\w)*\Z", re.S)


@dataclass(frozen=True)
class Needle:
    """What is looked for: a whole word, a text as written, or a pattern."""

    kind: str
    said: str
    asked: str

    @property
    def qualified(self) -> bool:
        """Whether a longer name (``Session::open``) was read as its last part."""
        return self.kind == WORD and self.said != self.asked

    @property
    def bare(self) -> str:
        return self.said.lstrip(".#%")


def needle(asked: str) -> Needle:
    """A path of names (parts joined by ``::``, ``->``, ``.``, ``\\`` or ``$``) asks for
    its last part as a word; anything else for the text as written."""
    asked = asked.strip()
    parts = re.findall(r"\w+", asked)
    if parts and _PATH_OF_NAMES.match(asked):
        return Needle(WORD, parts[-1], asked)
    return Needle(TEXT, asked, asked)


def pruning_words(n: Needle) -> str | None:
    """The part of the needle whose index terms every file with a match must hold.
    The first and last word of a text may be cut off, so only those between count."""
    if n.kind == WORD:
        return n.said
    inner = n.said.split()[1:-1] if n.kind == TEXT else []
    return " ".join(inner) or None


def _test(n: Needle, java: str | None) -> Column:
    content = F.col("content")
    if n.kind == WORD:
        return T.whole_word(content, n.said) & ((F.col("kind") == "Docs") | ~T.comment_line(content))
    return content.contains(n.said) if n.kind == TEXT else content.rlike(java)


def collected(texts: DataFrame, declarations: DataFrame, n: Needle, path: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """(file_id, path, kind, line, content, inside, declares) of every line that
    answers. ``texts`` (file_id, path, kind, text), ``declarations`` (file_id,
    line, name), ``among`` (file_id) the files left by an index. Words skip
    settings and, but for pages, comment lines. A line that declares the bare
    name of a text asked for answers too."""
    java = lookup.checked_regex(texts, n.said) if n.kind == PATTERN else None
    files = texts.where("kind <> 'Config'") if n.kind == WORD else texts
    files = files.where(F.col("path").contains(path)) if path else files
    files = files.join(among, "file_id", "left_semi") if among is not None else files
    declared = declarations.where(F.col("name") == n.bare).select("file_id", "line").distinct()
    if n.kind == TEXT:
        held = files.join(declared.select("file_id").distinct().withColumn("named", F.lit(True)), "file_id", "left").where(F.col("text").contains(n.said) | F.col("named"))
        lines = T.explode_lines(held.select("file_id", "path", "kind", "text")).join(declared.withColumn("here", F.lit(True)), ["file_id", "line"], "left")
        found = lines.where(_test(n, java) | F.col("here")).drop("here")
    else:
        held = files.where(F.col("text").contains(n.said)) if n.kind == WORD else files
        found = T.explode_lines(held.select("file_id", "path", "kind", "text")).where(_test(n, java))
    labelled = lookup.with_enclosing(found.select("file_id", "line", "content"), declarations.join(found.select("file_id").distinct(), "file_id", "left_semi"), n.said)
    flags = declared.withColumn("bare", F.lit(True))
    labelled = labelled.join(flags, ["file_id", "line"], "left").withColumn("declares", F.col("declares") | F.coalesce("bare", F.lit(False))).drop("bare")
    return labelled.join(files.select("file_id", "path", "kind"), "file_id").select("file_id", "path", "kind", "line", T.trim(F.col("content")).alias("content"), "inside", "declares")


def is_written_in_quotes(found: DataFrame, n: Needle) -> bool:
    """Whether any line has the whole of what was asked next to a quote mark."""
    return not found.where(T.quoted(F.col("content"), n.asked)).isEmpty()


def answered(found: DataFrame, limit: int = lookup.BUDGET) -> DataFrame:
    """The lines of an answer: (role, place, file_id, path, kind, line, content,
    inside). Declarations come first and use up the budget; then the files by
    kind, number of lines and path, each with at most 8 lines ``shown`` while the
    budget lasts, and the numbers of the rest as ``also``. Files that got nothing
    are ``unshown``, the first 10 by name, with their number of lines as ``line``.

    Files are ranked by their counts; only the first that the budget can reach,
    and 10 more, come together."""
    order = [lookup.kind_rank(F.col("kind")), F.desc("n"), F.asc("path"), F.asc("file_id")]
    counts = found.groupBy("file_id", "path", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("declares")).alias("uses"))
    spent = found.agg(F.greatest(F.lit(limit) - F.count_if("declares"), F.lit(0)).alias("budget"))  # one row
    files = counts.where("uses > 0").orderBy(*order).limit(limit + lookup.UNSHOWN).withColumn("place", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(spent))
    before = F.sum(F.least("uses", F.lit(lookup.PER_FILE))).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("room", F.greatest(F.col("budget") - F.coalesce(before, F.lit(0)), F.lit(0))).withColumn("shown", F.least("uses", "room", F.lit(lookup.PER_FILE)))
    uses = found.where(~F.col("declares")).join(F.broadcast(files.where("shown > 0").select("file_id", "place", "shown")), "file_id")
    uses = uses.withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy("line")))
    columns = ["role", "place", "file_id", "path", "kind", "line", "content", "inside"]
    listed = uses.withColumn("role", F.when(F.col("r") <= F.col("shown"), "shown").otherwise("also")).withColumn("content", F.when(F.col("role") == "shown", T.clip(F.col("content"))))
    declared = found.where("declares").withColumn("role", F.lit("declared")).withColumn("place", F.lit(0)).withColumn("content", T.clip(F.col("content"))).withColumn("inside", F.lit(None).cast("string"))
    left = files.where("shown = 0").withColumn("k", F.row_number().over(Window.orderBy("place"))).where(F.col("k") <= lookup.UNSHOWN)
    unshown = left.select(F.lit("unshown").alias("role"), "place", "file_id", "path", "kind", F.col("uses").cast("int").alias("line"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("inside"))
    return declared.select(*columns).unionByName(listed.withColumn("inside", F.when(F.col("role") == "shown", F.col("inside"))).select(*columns)).unionByName(unshown)


def totals(found: DataFrame) -> DataFrame:
    """(lines, declarations, files), one row."""
    return found.agg(F.count(F.lit(1)).alias("lines"), F.count_if("declares").alias("declarations"), F.count_distinct("file_id").alias("files"))


def elsewhere(found: DataFrame) -> DataFrame:
    """(lines, files, named), one row: how much there is when the path is dropped,
    and the three files with most lines, tests last."""
    order = [F.when(F.col("kind") == "Test", 1).otherwise(0), F.desc("n"), F.asc("path")]
    counts = found.groupBy("file_id", "path", "kind").agg(F.count(F.lit(1)).alias("n"))
    first = counts.orderBy(*order).limit(ELSEWHERE).withColumn("k", F.row_number().over(Window.orderBy(*order)))
    named = first.agg(F.array_sort(F.collect_list(F.struct("k", "path")))["path"].alias("named"))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.count(F.lit(1)).alias("files"))
    return whole.crossJoin(F.broadcast(named))  # one row each
