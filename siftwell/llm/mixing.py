"""Mixing sources to target weights, by weighted fair queueing.

Each source shuffles its documents and queues them, as often as its cap allows.
A document's virtual finish time is the source's tokens up to and including it,
divided by the source's target share. Served in the order of these times, the
sources progress in proportion to their shares; the mix ends when the budget is
reached. A source that runs dry leaves its place to the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.ordered import running


def source_key(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case; blank counts as null."""
    s = F.lower(F.regexp_replace(F.regexp_replace(source, r"(?U)^\s+", ""), r"(?U)\s+$", ""))
    return F.when(s != "", s)


def fair_queue(docs: DataFrame, targets: DataFrame, seed: int = 17, budget: int | None = None) -> DataFrame:
    """The mix: (source, doc_id, repeat, tokens, finish), one row per drawn copy.

    ``docs`` (doc_id, source, tokens) one row per document with its own source
    spelling, ``targets`` (source, target_share, max_repeats). Spellings of a
    source are one source, written as in ``targets``. ``budget`` is in tokens,
    by default those of all documents that have a source, each once. Copies are
    drawn up to and including the one that reaches the budget. Documents without
    a source, of a source without a target, with a null or zero size, or of a
    share or cap that is null or not positive are never drawn. Of repeated
    targets the largest share and cap count. Empty tables give no rows.

    Both cumulative sums are range-partitioned, so one source may hold any share
    of the documents.
    """
    named = docs.select("doc_id", source_key(F.col("source")).alias("key"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens")).where("key is not null")
    if budget is None:
        budget = named.agg(F.sum("tokens")).first()[0] or 0
    plan = targets.select(source_key(F.col("source")).alias("key"), "source", "target_share", "max_repeats").where("key is not null and target_share > 0 and max_repeats > 0")
    plan = plan.groupBy("key").agg(F.min("source").alias("source"), F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    queued = named.where("tokens > 0").withColumn("place", F.xxhash64(F.lit(seed), "key", "doc_id"))
    sizes = named.groupBy("key").agg(F.sum("tokens").alias("all"))
    summed = running(queued, ["key"], [F.col("place"), F.col("doc_id")], "tokens", "through").join(plan, "key").join(sizes, "key")
    copies = summed.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("cap").cast("int"))))
    timed = copies.withColumn("finish", ((F.col("repeat") - 1) * F.col("all") + F.col("through")) / F.col("share"))
    slim = timed.select("key", "source", "doc_id", "repeat", "tokens", "finish")
    served = running(slim, [], [F.col("finish"), F.col("key"), F.col("doc_id"), F.col("repeat")], "tokens", "served")
    return served.where(F.col("served") - F.col("tokens") < F.lit(budget)).select("source", "doc_id", "repeat", "tokens", "finish")


def mix_report(docs: DataFrame, targets: DataFrame, mix: DataFrame, budget: int | None = None) -> DataFrame:
    """What the mix reached, one row per target source: (source, target_share,
    max_repeats, available, drawn, copies, actual_share, dry, short).

    ``available`` is the source's tokens times its cap, ``drawn`` its tokens in
    the mix, ``actual_share`` drawn over all drawn (null for an empty mix),
    ``dry`` whether every copy was drawn, ``short`` whether the source ran dry
    below its share of the budget.
    """
    named = docs.select(source_key(F.col("source")).alias("key"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens")).where("key is not null")
    sizes = named.groupBy("key").agg(F.sum("tokens").alias("own"))
    whole = named.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("budget")) if budget is None else named.sparkSession.range(1).select(F.lit(budget).alias("budget"))
    plan = targets.where(source_key(F.col("source")).isNotNull()).groupBy(source_key(F.col("source")).alias("key")).agg(F.min("source").alias("source"), F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    got = mix.groupBy("source").agg(F.sum("tokens").alias("drawn"), F.count(F.lit(1)).alias("copies"))
    total = mix.agg(F.sum("tokens").alias("total"))
    cap, share = F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)), F.coalesce("target_share", F.lit(0.0))
    out = plan.join(sizes, "key", "left").join(got, "source", "left").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(total))  # one row each
    out = out.withColumn("available", F.coalesce("own", F.lit(0)) * cap).withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    dry = F.col("drawn") >= F.col("available")
    return out.select(
        "source", "target_share", "max_repeats", "available", "drawn", F.coalesce("copies", F.lit(0)).alias("copies"), (F.col("drawn") / F.col("total")).alias("actual_share"),
        dry.alias("dry"), (dry & (F.col("drawn") < share * F.col("budget"))).alias("short"),
    )
