"""Exact look-ups in lines: usages of a name or text, regular expressions, and
the declaration each line sits in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import clip, explode_lines

BUDGET, PER_FILE, UNSHOWN = 40, 8, 10
_POSIX = {"alpha": r"\p{IsAlphabetic}", "digit": r"\p{Nd}", "alnum": r"\p{IsAlphabetic}\p{N}", "space": r"\s", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "punct": r"\p{Punct}", "word": r"\w", "xdigit": "0-9A-Fa-f", "blank": r" \t"}
_SCRIPTS = ("Arabic", "Armenian", "Cyrillic", "Devanagari", "Georgian", "Greek", "Han", "Hangul", "Hebrew", "Hiragana", "Katakana", "Latin", "Thai")


def java_regex(pattern: str) -> str:
    """A linear-time regular expression in Java's dialect. Named groups, scripts
    and bracketed POSIX classes are translated; look-around and back-references,
    which the source dialect lacks, are refused. Raises ``ValueError`` on the
    driver, before any job starts."""
    if re.search(r"\(\?<?[=!]", pattern):
        raise ValueError("look-around isn't supported")
    if re.search(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k<)", pattern):
        raise ValueError("back-references aren't supported")
    out = pattern.replace("(?P<", "(?<")
    out = re.sub(r"\[:(\^?)(\w+):\]", lambda m: ("^" if m[1] else "") + _POSIX[m[2]] if m[2] in _POSIX else m[0], out)
    return re.sub(r"\\([pP])\{(" + "|".join(_SCRIPTS) + r")\}", r"\\\1{Is\2}", out)


def checked_regex(df: DataFrame, pattern: str) -> str:
    """:func:`java_regex`, compiled once on the driver so that errors show early."""
    out = java_regex(pattern)
    try:
        df.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(out)
    except Exception as e:  # a py4j error that wraps the compiler's message
        raise ValueError(f"invalid regular expression: {pattern}") from e
    return out


def matching_lines(docs: DataFrame, test: Column, *keys: str) -> DataFrame:
    """(keys, line, content) of the lines that pass ``test``, a condition on
    ``content``."""
    return explode_lines(docs.select(*keys, "text")).where(test)


def grep(docs: DataFrame, pattern: str, *keys: str) -> DataFrame:
    """Lines in which ``pattern`` occurs. The text is tested before it is cut
    into lines, so texts without a match cost one pass and no rows."""
    java = checked_regex(docs, pattern)
    return matching_lines(docs.where(F.col("text").rlike(f"(?m){java}") | F.col("text").contains("\r")), F.col("content").rlike(java), *keys)


def candidates(postings: DataFrame, terms: list[str], key: str = "file_id") -> DataFrame:
    """Keys that hold every one of ``terms``: the posting lists intersected by
    relational division, from literals that reach the scan."""
    wanted = sorted(set(terms))
    hit = postings.where(F.col("term").isin(*wanted) & (F.col("weight") > 0)).select(key, "term").distinct()
    return hit.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(wanted)).select(key)


def with_enclosing(lines: DataFrame, declarations: DataFrame, symbol: str, key: str = "file_id") -> DataFrame:
    """Adds ``inside``, the last declaration at or above each line whose name
    isn't ``symbol``, and ``declares``, whether the line declares ``symbol``.

    An as-of join: lines and declarations are merged and the last name carried
    down; a file's lines are its only group."""
    own = declarations.where(F.col("name") == symbol).select(key, "line", F.lit(True).alias("declares")).distinct()
    marks = declarations.where(F.col("name") != symbol).groupBy(key, "line").agg(F.min("name").alias("name"))
    both = lines.select(key, "line", "content", F.lit(1).alias("o"), F.lit(None).cast("string").alias("name")).unionByName(marks.select(key, "line", F.lit(None).cast("string").alias("content"), F.lit(0).alias("o"), "name"))
    down = Window.partitionBy(key).orderBy("line", "o").rowsBetween(Window.unboundedPreceding, 0)
    labelled = both.withColumn("inside", F.last("name", ignorenulls=True).over(down)).where("o = 1").select(key, "line", "content", "inside")
    return labelled.join(own, [key, "line"], "left").withColumn("declares", F.coalesce("declares", F.lit(False)))


def kind_rank(kind: Column) -> Column:
    return F.when(kind.isin("Code", "Config"), 0).when(kind == "Test", 1).otherwise(2)


def budgeted(usages: DataFrame, key: str = "file_id", budget: int = BUDGET) -> DataFrame:
    """The lines that an answer shows: files by kind, number of lines, path;
    within a file declarations first; at most 8 lines a file, and ``budget`` in
    all. Ranks are cut per file before the global order, which then sees at most
    ``budget`` files of 8 lines."""
    counts = usages.groupBy(key, "path", "kind").agg(F.count(F.lit(1)).alias("n"))
    order = [kind_rank(F.col("kind")), F.desc("n"), F.asc("path"), F.asc(key)]
    files = counts.orderBy(*order).limit(budget).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    own = Window.partitionBy(key).orderBy(F.desc("declares"), "line")
    first = usages.join(F.broadcast(files.select(key, "place")), key).withColumn("r", F.row_number().over(own)).where(F.col("r") <= PER_FILE)
    shown = Window.orderBy("place", "r")
    return first.withColumn("position", F.row_number().over(shown)).where(F.col("position") <= budget).select("position", key, "path", "kind", "line", "declares", clip(F.col("content")).alias("content"))


def snippet_window(lines: DataFrame, terms: list[str], size: int, key: str) -> DataFrame:
    """(key, first_line, distinct_terms, hits): the window of ``size`` lines with
    most distinct terms, then most hits, the earliest of equals; it slides forward
    until at most two lines precede its first match, if that costs no term. Terms
    match as whole lower-case words; at most 64 of them fit the bitmap. Texts
    shorter than a window are one window."""
    if not 0 < len(terms) <= 64:
        raise ValueError("between 1 and 64 terms")
    low = F.lower("content")
    flags = [low.rlike(rf"(?<![\p{{IsAlphabetic}}\p{{N}}_])\Q{t.lower()}\E(?![\p{{IsAlphabetic}}\p{{N}}_])") for t in terms]
    bits = F.lit(0).cast("long")
    for i, f in enumerate(flags):
        bits = bits.bitwiseOR(F.when(f, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    frame = Window.partitionBy(key).orderBy("line").rowsBetween(0, size - 1)
    whole = Window.partitionBy(key)
    b = lines.select(key, "line", bits.alias("bits"), F.count(F.lit(1)).over(whole).alias("n"))
    w = b.select(key, "line", "n", F.bit_or("bits").over(frame).alias("seen"), F.sum(F.bit_count("bits")).over(frame).alias("hits"), F.min(F.when(F.col("bits") != 0, F.col("line"))).over(frame).alias("match"))
    end = F.greatest(F.col("n") - size + 1, F.lit(1))
    w = w.where((F.col("line") <= end) & (F.col("seen") != 0))
    w = w.withColumn("worth", F.struct(F.bit_count("seen").alias("terms"), F.col("hits")))
    best = w.withColumn("top", F.max("worth").over(whole)).where(F.col("worth") == F.col("top"))
    slid = F.least(F.greatest(F.col("match") - 2, F.lit(1)), end)
    best = best.withColumn("goal", F.min(F.struct("line", slid.alias("slid"))).over(whole)["slid"])
    x = best.groupBy(key).agg(F.min("line").alias("first"), F.max(F.when(F.col("line") == F.col("goal"), F.col("line"))).alias("slid"), F.first("worth").alias("worth"))
    return x.select(key, F.coalesce("slid", "first").alias("first_line"), F.col("worth.terms").alias("distinct_terms"), F.col("worth.hits").alias("hits"))
