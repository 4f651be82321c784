"""Queries of change capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.changes import ChangeCapture
from siftwell.session import scratch
from siftwell.sources import table


def p2_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every added or changed record, by a first run over the whole log."""
    capture = ChangeCapture(spark, scratch(spark, "changes"))
    capture.run(table(spark, sf_dir, "tree_walks"), table(spark, sf_dir, "file_records"))
    return capture.result()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_changes(spark, sf_dir).select("record_id")


def p2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per walk the number of added and of changed records."""
    return p2_changes(spark, sf_dir).groupBy("walk_id", "change").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p2_found": p2_found, "p2_changes": p2_changes, "p2_summary": p2_summary}

_PAIRS = r"""
with done as (
  select walk_id, checkout_id, row_number() over (partition by checkout_id order by started_at nulls first, walk_id) as place
  from (select walk_id, max(checkout_id) as checkout_id, max(started_at) as started_at from tree_walks where status = 'done' group by walk_id)),
spelt as (
  select d.walk_id, d.checkout_id, d.place, r.record_id, r.hash, r.stamp,
    regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(r.path, '^\\\\\?\\', ''), '\', '/'), '/(\./)+', '/', 'g'), '/{2,}', '/', 'g'), '^(\./|/)+|/+$', '', 'g') as path, r.seen_at
  from file_records r join done d on d.walk_id = r.walk_id),
one as (
  select * from (select *, row_number() over (partition by walk_id, path order by seen_at desc nulls last, record_id desc) as rn from spelt) where rn = 1),
pairs as (
  select n.walk_id, n.place, n.path, n.record_id,
    case when p.record_id is null then 'added'
         when n.hash is not null and p.hash is not null then case when n.hash <> p.hash then 'changed' end
         when n.stamp.mtime_s is not null and n.stamp.mtime_ns is not null and p.stamp.mtime_s is not null and p.stamp.mtime_ns is not null
           then case when n.stamp.mtime_s <> p.stamp.mtime_s or n.stamp.mtime_ns <> p.stamp.mtime_ns or n.stamp.bytes is distinct from p.stamp.bytes then 'changed' end
         else 'changed' end as change
  from one n join done b on b.checkout_id = n.checkout_id and b.place = n.place - 1
  left join one p on p.walk_id = b.walk_id and p.path is not distinct from n.path)
"""
SQL = {
    "p2_found": _PAIRS + "select record_id from pairs where change is not null",
    "p2_changes": _PAIRS + "select walk_id, cast(place as integer) as place, path, record_id, change from pairs where change is not null",
    "p2_summary": _PAIRS + "select walk_id, change, count(*) as n from pairs where change is not null group by all",
}
