"""Retrieval quality from probes: what was expected for a question, and where it
stands among the hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.text import explode_lines


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text, expected, anchor) of a file of probes: question, expected path
    and, if given, a text that must stand in the lines, parted by tabs. Lines that
    are blank or lack a path are passed over; ids follow the file's order."""
    raw = spark.read.text(path).where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    parts = raw.select("at", F.split("value", "\t").alias("p")).where(F.size("p") >= 2)
    anchor = F.trim(F.get("p", F.lit(2)))
    one = parts.select("at", F.get("p", F.lit(0)).alias("text"), F.trim(F.get("p", F.lit(1))).alias("expected"), F.when(anchor != "", anchor).alias("anchor"))
    return one.withColumn("query_id", F.row_number().over(Window.orderBy("at")).cast("long")).drop("at").select("query_id", "text", "expected", "anchor")


def file_ranks(probes: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank): the place of the first expected file among the distinct files
    of the hits, from 1, null beyond ``limit``. ``probes`` (query_id, expected, a
    part of the path), ``hits`` (query_id, rank, path), a few per question."""
    files = hits.groupBy("query_id", "path").agg(F.min("rank").alias("first"))
    places = files.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).where(F.col("place") <= limit)
    found = probes.select("query_id", "expected").join(places, "query_id").where(F.col("path").contains(F.col("expected")))
    best = found.groupBy("query_id").agg(F.min("place").alias("rank"))
    return probes.select("query_id").distinct().join(best, "query_id", "left")


def span_ranks(probes: DataFrame, hits: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank) of the probes with an anchor: the first of the best ``limit``
    hits that lies in the expected file and has the anchor in one of its lines.
    ``hits`` (query_id, rank, path, start_line, end_line), ``texts`` (path, text)."""
    asked = probes.where("anchor is not null").select("query_id", "expected", "anchor")
    wanted = texts.join(asked.select(F.col("expected").alias("path")).distinct(), "path", "left_semi").select("path", "text")
    lines = explode_lines(wanted).withColumnRenamed("path", "expected")
    marked = asked.join(lines, "expected").where(F.col("content").contains(F.col("anchor"))).select("query_id", "expected", "line")
    near = hits.where(F.col("rank") <= limit).join(marked, "query_id").where((F.col("path") == F.col("expected")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    return asked.select("query_id").distinct().join(near.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")
