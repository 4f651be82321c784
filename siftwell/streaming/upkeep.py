"""Keeping a table current from a stream of changes.

A micro-batch holds (path, seq, hash, gone): the latest row of a path wins, a
``gone`` row deletes. ``foreachBatch`` writes each batch as an immutable segment
named after its batch id and lists it in a manifest, so a replay changes nothing.
Readers merge on read: of a path's rows the highest ``seq`` counts. State never
expires, as deletions are explicit; there is no watermark. Deletions stay after
a compaction, so late rows can't bring a path back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators.manifest import Manifest, fresh_name
from siftwell.operators.store import MAX_SEGMENTS, latest

STATE = "path string, seq long, hash string, gone boolean"
OVERFLOW = 256


class LiveTable:
    """A latest-wins table in ``root``, kept by a stream; one writer."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.manifest = spark, Manifest(spark, root)

    def _upsert(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("path", "seq", "hash", F.coalesce("gone", F.lit(False)).alias("gone")).where("path is not null")
        if not any(note["last"] >= batch_id for note in self.manifest.live().values()):  # else already merged or listed
            self.manifest.add(f"batch-{batch_id:09d}", latest(rows, ["path"], ["seq"]).write.mode("overwrite").parquet, last=batch_id)

    def follow(self, changes: DataFrame) -> StreamingQuery:
        """Starts upserting a streaming frame of changes. The query ends when the
        source has no more: awaiting it is the barrier after which every earlier
        change is visible to the next read."""
        writer = changes.writeStream.foreachBatch(self._upsert).option("checkpointLocation", self.manifest.folder.path("checkpoint"))
        return writer.trigger(availableNow=True).start()

    def segments(self) -> list[str]:
        return list(self.manifest.live())

    def _rows(self) -> DataFrame | None:
        """All rows of the live segments, ``segment`` telling the newer of equal ``seq``."""
        frames = [self.spark.read.schema(STATE).parquet(self.manifest.path(s)).withColumn("segment", F.lit(i)) for i, s in enumerate(self.segments())]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def read(self) -> DataFrame:
        """(path, seq, hash) of the paths that exist now."""
        rows = self._rows()
        if rows is None:
            return self.spark.createDataFrame([], STATE).drop("gone")
        return latest(rows, ["path"], ["seq", "segment"]).where("not gone").select("path", "seq", "hash")

    def compact(self, more_than: int = 1) -> bool:
        """Merges the segments into one, under a name of its own, where there are
        more than ``more_than``. Deletions are kept. Call :meth:`sweep` once no
        reader uses the merged segments any longer."""
        live = self.manifest.live()
        if len(live) <= max(1, more_than):
            return False
        name = fresh_name("merged")
        rows = latest(self._rows(), ["path"], ["seq", "segment"]).select("path", "seq", "hash", "gone")
        rows.write.mode("overwrite").parquet(self.manifest.path(name))
        self.manifest.replace({name: {"last": max(n["last"] for n in live.values())}})
        return True

    def sweep(self) -> int:
        return self.manifest.sweep()

    def reconcile(self, listing: DataFrame, seq: int) -> DataFrame:
        """(path, seq, hash, gone): what a full listing (path, hash) says that the
        table missed. Applied after lost events, or now and then as a check."""
        both = self.read().select("path", F.col("hash").alias("old")).withColumn("had", F.lit(True)).join(listing.select("path", "hash").withColumn("has", F.lit(True)), "path", "full_outer")
        differs = F.col("had").isNull() | F.col("has").isNull() | ~F.col("old").eqNullSafe(F.col("hash"))
        return both.where(differs).select("path", F.lit(seq).cast("long").alias("seq"), "hash", F.col("has").isNull().alias("gone"))

    def repair(self, listing: DataFrame, seq: int) -> int:
        """Writes :meth:`reconcile` as a segment; the number of paths mended."""
        name = fresh_name("repair")
        last = max([-1, *(n["last"] for n in self.manifest.live().values())])
        self.manifest.add(name, self.reconcile(listing, seq).write.mode("overwrite").parquet, last=last)
        return self.spark.read.schema(STATE).parquet(self.manifest.path(name)).count()


def overflows(batch: DataFrame, limit: int = OVERFLOW) -> bool:
    """Whether a batch of changes names the root itself, an ignore file, or more
    than ``limit`` paths: then a full listing costs less, and is safer."""
    name = F.element_at(F.split("path", "/"), -1)
    whole = batch.where(F.col("path").isNull() | F.col("path").isin("", ".") | name.isin(".gitignore", ".ignore"))
    return not whole.isEmpty() or batch.select("path").distinct().limit(limit + 1).count() > limit


__all__ = ["MAX_SEGMENTS", "LiveTable", "overflows"]
