"""Ordered computations over groups of any size.

A window function sorts each group in one task, which fails once a group holds
a large share of all rows. These operators range-partition the rows on
(group, order) instead, so that a large group spreads over many partitions,
compute within each partition, and correct each partition by what the earlier
ones hold of its first group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siftwell.session import materialise

_HOW = {"sum": F.sum, "max": F.max}
HOT_SHARE = 10_000


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, out: str, how: str = "sum") -> DataFrame:
    """Adds ``out``: the sum (or maximum) of ``value`` over the rows of the same
    ``by`` group up to and including this one, in ``order``.

    ``order`` must be total; rows that tie may take either place. Null group
    keys form one group; null values count as 0 in a sum and are passed over in
    a maximum. An empty table gives an empty table. No task holds more than a
    range partition, and the correction has at most one row per partition, which
    is the proven bound for broadcasting it.
    """
    if how not in _HOW:
        raise ValueError(f"how must be one of {sorted(_HOW)}")
    spark, by = df.sparkSession, list(by)
    if how == "sum":
        df = df.withColumn(value, F.coalesce(F.col(value), F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    laid = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    kind = df.schema[value].dataType
    names = [*df.columns, out, "_part"]
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind), T.StructField("_part", T.IntegerType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, None
        for batch in batches:
            n_rows = batch.num_rows
            if not n_rows:
                continue
            new = np.zeros(n_rows, dtype=bool)
            for c in by:
                col = batch.column(c)
                a, b = col.slice(1), col.slice(0, n_rows - 1)
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                new[1:] |= ~same.to_numpy(zero_copy_only=False)
            block = np.cumsum(new)
            grouped = batch.column(value).to_pandas().groupby(block)
            run = grouped.cumsum() if how == "sum" else grouped.cummax().groupby(block).ffill()
            run = run.to_numpy().copy()
            first = tuple(batch.column(c)[0].as_py() for c in by)
            if last is not None and first == last:
                head = block == 0
                run[head] = run[head] + carry if how == "sum" else np.fmax(run[head], carry)
            last, carry = tuple(batch.column(c)[n_rows - 1].as_py() for c in by), run[-1]
            columns = [*batch.columns, pa.array(run, from_pandas=True).cast(to_arrow_type(kind)), pa.array(np.full(n_rows, part, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = materialise(laid.mapInArrow(local, schema), "running")
    totals = kept.groupBy("_part", *by).agg(_HOW[how](value).alias("_t"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    corrections = totals.select("_part", *by, _HOW[how]("_t").over(before).alias("_before")).where(F.col("_before").isNotNull())
    c = corrections.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_before")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)], F.col("_part") == F.col("_p"))
    total = F.col(out) + F.coalesce("_before", F.lit(0)) if how == "sum" else F.greatest(out, "_before")
    return kept.join(F.broadcast(c), on, "left").select(*[c for c in df.columns if c != out], total.cast(kind).alias(out))


def join_counted(rows: DataFrame, keyed: DataFrame, on: Sequence[str], count: str, total: int) -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row per key and in ``count`` how
    many of the ``total`` rows have it. Null keys join each other.

    A key with a ten-thousandth of all rows or more is hot; by arithmetic there are
    at most 10,000 of them, which bounds their broadcast. All other keys are
    shuffled, none with more than that share. ``rows`` is read twice, so it should
    lie in files."""
    right = keyed.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[c for c in keyed.columns if c not in on])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)])
    hot = right.where(F.col(count) * HOT_SHARE >= total)
    keys = F.broadcast(hot.select(*[f"_on{i}" for i in range(len(on))]))
    of_hot = rows.join(F.broadcast(hot), same)
    of_rest = rows.join(keys, same, "left_anti").join(right.where(F.col(count) * HOT_SHARE < total), same)
    return of_hot.unionByName(of_rest).drop(*[f"_on{i}" for i in range(len(on))])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: str, most: int, salts: int = 16) -> DataFrame:
    """The first ``n`` rows (a column) of each group in ``order``, with ``rank``.

    ``most`` bounds ``n``. Every task keeps at most ``most`` rows of a group before
    rows are shuffled (a group limit below the window), so the sort of a hot group
    sees no more than that from each task. Where ``most`` is too large for Spark's
    group limit, salted parts of a group are cut first. Null or non-positive
    ``n`` keeps nothing.
    """
    if most <= 0:
        return df.withColumn("rank", F.lit(1)).where(F.lit(False))
    if most > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c not in group and df.schema[c].dataType.typeName() != "map"]), F.lit(salts)))
        part = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= most).drop("_r", "_salt")
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where((F.col("rank") <= most) & (F.col("rank") <= F.col(n)))
