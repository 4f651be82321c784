"""The index as tables: merge-on-read, differences of snapshots, incremental
upserts, reuse by content, upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SEGMENTS, DEAD_SHARE, RACY_SECONDS = 8, 0.25, 2


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Merge on read: of the rows of a key the one with the highest ``order``.
    An aggregate, so versions combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def differences(old: DataFrame, new: DataFrame, keys: Sequence[str], changed: Column) -> DataFrame:
    """(keys, change): added, changed and gone, by a full outer join. ``changed``
    is a condition on ``o`` and ``n``, structs of the other columns."""
    pack = lambda d, a: d.select(*keys, F.struct(*[c for c in d.columns if c not in keys]).alias(a))
    both = pack(old, "o").join(pack(new, "n"), list(keys), "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "gone").when(changed, "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def upsert(old: DataFrame, fresh: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` without the keys in ``fresh`` and ``gone``, then ``fresh``."""
    out = fresh.select(*keys).unionByName(gone.select(*keys)).distinct()
    return old.join(out, list(keys), "left_anti").unionByName(fresh)


def borrowed(missing: DataFrame, donors: DataFrame, on: Sequence[str], order: Sequence[str], take: Sequence[str], own: str) -> DataFrame:
    """What other checkouts have already computed for the same content: of the donor
    rows with the same ``on`` keys and another ``own`` (a checkout), the newest by
    ``order``, joined to ``missing``. Of each content only the newest donor and the
    newest of another checkout travel on, however many hold it."""
    keys = missing.select(*on).distinct()
    rows = donors.join(keys, list(on), "left_semi").groupBy(*on, F.col(own).alias("_own")).agg(F.max(F.struct(*order)).alias("_o"), F.max_by(F.struct(*take), F.struct(*order)).alias("_d"))
    first = rows.groupBy(*on).agg(F.max_by(F.struct("_own", "_d"), F.struct("_o", "_own")).alias("_a"))
    others = rows.join(first.select(*on, F.col("_a._own").alias("_top")), list(on)).where(F.col("_own") != F.col("_top"))
    second = others.groupBy(*on).agg(F.max_by("_d", F.struct("_o", "_own")).alias("_b"))
    found = missing.join(first.join(second, list(on), "left"), list(on))
    donor = F.when(F.col("_a._own") != F.col(own), F.col("_a._d")).otherwise(F.col("_b"))
    return found.withColumn("_d", donor).where("_d is not null").select(*missing.columns, *[F.col(f"_d.{c}").alias(f"donor_{c}") for c in take])


def racy(old: DataFrame, new: DataFrame, keys: Sequence[str], walked_s: Column) -> DataFrame:
    """Keys whose stamp did not change although the content did, because the
    edit fell within two seconds of the last walk (``walked_s``, a column of
    ``o``): same size and time, another hash."""
    pack = lambda d, a: d.select(*keys, F.struct(*[c for c in d.columns if c not in keys]).alias(a))
    both = pack(old, "o").join(pack(new, "n"), list(keys))
    o, n = F.col("o"), F.col("n")
    same = o["stamp"].eqNullSafe(n["stamp"])
    return both.where(same & (n["stamp"]["mtime_s"] >= walked_s - RACY_SECONDS) & ~o["hash"].eqNullSafe(n["hash"])).select(*keys)


def upkeep(segments: DataFrame) -> DataFrame:
    """(segments, chunks, live, dead_share, compact) of (segment_id, chunks, live):
    more than 8 segments, or more than a quarter dead, calls for a merge."""
    s = segments.agg(F.count(F.lit(1)).alias("segments"), F.sum("chunks").alias("chunks"), F.sum("live").alias("live"))
    dead = F.when(F.col("chunks") > 0, 1 - F.col("live") / F.col("chunks")).otherwise(F.lit(0.0))
    return s.withColumn("dead_share", F.round(dead, 9)).withColumn("compact", (F.col("segments") > MAX_SEGMENTS) | (dead > DEAD_SHARE))


def merged_postings(segments: DataFrame) -> DataFrame:
    """(term, chunk_id, weight, segments) of the postings of many segments (segment,
    term, chunk_id, weight): one dictionary, sorted by term within its files, and
    how many segments held a posting. Of a posting in several the newest counts."""
    out = segments.groupBy("term", "chunk_id").agg(F.max_by("weight", "segment").alias("weight"), F.count_distinct("segment").alias("segments"))
    return out.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")


def built_postings(body: DataFrame, names: DataFrame, paths: DataFrame) -> DataFrame:
    """(term, chunk_id, weight): body terms count once, terms of declared names
    three times more, terms of the path twice in every chunk. One aggregate of
    the three, each (chunk_id, term, n)."""
    weighed = [body.select("chunk_id", "term", F.col("n").alias("w")), names.select("chunk_id", "term", (3 * F.col("n")).alias("w")), paths.select("chunk_id", "term", (2 * F.col("n")).alias("w"))]
    union = weighed[0].unionByName(weighed[1]).unionByName(weighed[2])
    return union.groupBy("term", "chunk_id").agg(F.greatest(F.round(F.sum("w")), F.lit(0)).cast("int").alias("weight"))


def dense_ids(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Dense ids from 0 in the order of ``order``, the same for the same rows."""
    from siftwell.operators.ordered import running

    one = rows.withColumn("_one", F.lit(1).cast("long"))
    return running(one, [], [F.col(c) for c in order], "_one", name).withColumn(name, F.col(name) - 1).drop("_one")
