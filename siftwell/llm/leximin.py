"""One ranking from several differently scaled scores, by leximin order.

Each score becomes a percentile among the items of its group: the share of
items at or below it. Units, spread and extreme values vanish, so each score
has an equal say. An item's percentiles are sorted ascending and the vectors
compared lexicographically, so a weak score cannot be masked by strong ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.ordered import join_counted, running, top_per_group
from siftwell.session import materialise

# Rows of a group that one task may sort. Larger groups are ranked over many tasks.
HOT_ROWS = 1_000_000


def _items(rows: DataFrame, n: int) -> DataFrame:
    """One row per item, the highest value of each score."""
    return rows.groupBy("g", "i").agg(*[F.max(f"s{k}").alias(f"s{k}") for k in range(n)])


def _vector(shares: list[Column]) -> Column:
    return F.sort_array(F.array(*shares)).alias("vector")


def _within_tasks(rows: DataFrame, n: int) -> DataFrame:
    """(g, i, vector) of groups that fit a task: after one shuffle by group, items,
    lowest values and percentiles all come from windows over the same layout."""
    one = _items(rows.repartition("g"), n)
    group = Window.partitionBy("g")
    full = one.select("g", "i", *[F.coalesce(f"s{k}", F.min(f"s{k}").over(group), F.lit(0.0)).alias(f"s{k}") for k in range(n)])
    shares = full.select("g", "i", *[F.cume_dist().over(group.orderBy(f"s{k}")).alias(f"p{k}") for k in range(n)])
    return shares.select("g", "i", _vector([F.col(f"p{k}") for k in range(n)]))


def _across_tasks(rows: DataFrame, n: int) -> DataFrame:
    """(g, i, vector) of groups of any size. Percentiles come from counts of the
    distinct values, null first, summed along a range partition; values that very
    many items share are joined back apart from the others."""
    one = materialise(_items(rows, n), "items")
    long = materialise(one.select("g", "i", F.posexplode(F.array(*[f"s{k}" for k in range(n)])).alias("k", "v")), "scores")
    distinct = materialise(long.groupBy("g", "k", "v").agg(F.count(F.lit(1)).alias("c")), "values")
    whole = distinct.groupBy("g", "k").agg(F.sum("c").alias("n"), F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("missing"), F.coalesce(F.min_by("c", F.col("v")), F.lit(0)).alias("lowest"))
    whole = whole.select(F.col("g").alias("g1"), F.col("k").alias("k1"), "n", "missing", "lowest")
    summed = running(distinct, ["g", "k"], [F.asc_nulls_first("v")], "c", "at_or_below")
    below = F.when(F.col("v").isNull(), F.col("missing") + F.col("lowest")).otherwise(F.col("at_or_below"))
    share = summed.join(whole, F.col("g").eqNullSafe(F.col("g1")) & (F.col("k") == F.col("k1"))).select("g", "k", "v", "c", (below / F.col("n")).alias("p"))
    total = long.count()
    ranked = join_counted(long, materialise(share, "shares"), ["g", "k", "v"], "c", total)
    return ranked.groupBy("g", "i").agg(F.sort_array(F.collect_list("p")).alias("vector"))


def percentile_vectors(items: DataFrame, group: str, item: str, scores: Sequence[str]) -> DataFrame:
    """(group, item, vector): the ascending percentiles of each item's scores.

    ``items`` may hold several rows of an item; the highest value of each score
    counts. Null and NaN are missing and count as the lowest value present in
    the group (so they tie with it); where a group has no value of a score at
    all, its items tie at the top of it and the score decides nothing. Booleans
    count as 0 and 1. Null groups form one group, null items one item. Other
    columns are ignored, whatever their names. An empty table gives no rows.

    Groups are counted first. Those of up to ``HOT_ROWS`` rows are ranked within
    tasks after a single shuffle; larger ones over many tasks, with equal results.
    """
    n = len(scores)
    clean = [F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")).alias(f"s{k}") for k, s in enumerate(scores)]
    rows = items.select(F.col(group).alias("g"), F.col(item).alias("i"), *clean)
    hot = rows.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_ROWS).select(F.col("g").alias("g0"))
    hot = materialise(hot, "hot")
    if hot.isEmpty():
        vectors = _within_tasks(rows, n)
    else:
        same = F.col("g").eqNullSafe(F.col("g0"))
        vectors = _within_tasks(rows.join(hot, same, "left_anti"), n).unionByName(_across_tasks(rows.join(hot, same, "left_semi"), n))
    return vectors.select(F.col("g").alias(group), F.col("i").alias(item), "vector")


def leximin_top(items: DataFrame, sizes: DataFrame, group: str, item: str, scores: Sequence[str], n: str) -> DataFrame:
    """(group, item, rank, vector): the first ``n`` items of each group.

    ``sizes`` holds one ``n`` per group; of several the largest counts, and a
    group without one gets no rows. Equal vectors rank by ascending item.
    """
    wanted = sizes.groupBy(group).agg(F.max(n).alias("_n")).where(F.col("_n") > 0)
    most = wanted.agg(F.max("_n")).first()[0] or 0
    vectors = percentile_vectors(items, group, item, scores).join(wanted, group)
    top = top_per_group(vectors, [group], [F.desc("vector"), F.asc(item)], "_n", most)
    return top.select(group, item, "rank", "vector")
