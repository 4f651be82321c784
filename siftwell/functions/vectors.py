"""Vector functions on array columns, and the dense channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.ordered import top_per_group


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def quantized(v: Column) -> Column:
    """struct<q array<tinyint>, scale float>: scale is the largest magnitude over
    127. A zero, empty or non-finite row gives zeros and scale 0."""
    d = F.transform(v, lambda x: x.cast("double"))
    scale = F.coalesce(F.array_max(F.transform(d, F.abs)) / 127.0, F.lit(0.0))
    ok = (scale > 0) & (scale < float("inf")) & ~F.isnan(scale)
    q = F.when(ok, F.transform(d, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x / scale))).cast("tinyint"))).otherwise(F.transform(d, lambda _: F.lit(0).cast("tinyint")))
    return F.struct(q.alias("q"), F.when(ok, scale).otherwise(F.lit(0.0)).alias("scale"))


def mean_direction(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, direction): the sum of a group's vectors, of length 1; a zero sum
    stays zero. Components are summed apart, so no group is gathered."""
    parts = vectors.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("s"))
    norm = F.sqrt(dot(F.col("s"), F.col("s")))
    return whole.select(group, F.when(norm > 0, F.transform("s", lambda x: x / norm)).otherwise(F.col("s")).alias("direction"))


def dense_channel(queries: DataFrame, vectors: DataFrame, depth: int) -> DataFrame:
    """(query_id, doc, score, rank): the ``depth`` best positive dot products of
    each query vector. ``queries`` is the stated set of questions, small beside
    ``vectors``: every question meets every row once and only the best of each
    salt travel on."""
    pairs = queries.select("query_id", F.col("vector").alias("asked")).join(vectors.select("doc", "vector"))
    scored = pairs.select("query_id", "doc", F.round(dot(F.col("vector"), F.col("asked")), 9).alias("score")).where("score > 0").withColumn("_n", F.lit(depth))
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("doc")], "_n", depth).drop("_n")
