"""Processing only what was added or changed since the last successful run.

The log (``file_records``) is cut into partitions, one per checkout, and an
offset in a partition is the place of a successful walk in it. The state holds an
index of the log: which files hold rows of which walk. A run

1. replays a batch that was planned but not committed, if there is one;
2. indexes the files that are new in the log and plans a batch: the walks that no
   committed batch has covered as they are now. Index and plan are written ahead
   of any work (plans/batch=N, by one rename);
3. compares each planned walk with the one before it, reading only the files that
   hold rows of either, and overwrites sink/batch=N, so that a replay leaves no
   second copy;
4. commits by one manifest; many committed batches are merged into one.

Readers see committed batches only, and of a walk that several batches covered
only the latest, one row per walk and path: the sink deduplicates by key and
offset. Rows that reach the log after their walk was committed lie in a new file
and change the walk's mark (number and hash of its rows), which plans it and its
successor again. A log that isn't made of files is indexed anew in each run.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.paths import normal_path
from siftwell.operators.manifest import Manifest, fresh_name
from siftwell.operators.store import MAX_SEGMENTS

_PLAN = "walk_id long, checkout_id long, place int, before long, mark string, before_mark string"
_SINK = "walk_id long, place int, path string, record_id long, change string"
_INDEX = "file string, walk_id long, n long, h long"
BROADCAST_WALKS = 200_000


def content_changed(now: Column, then: Column) -> Column:
    """Whether two versions (structs with ``hash`` and ``stamp``) differ: by hash;
    where either is null by the whole stamp; where that lacks its time on either
    side too, they count as different."""
    timed = lambda x: x["stamp"]["mtime_s"].isNotNull() & x["stamp"]["mtime_ns"].isNotNull()
    stamps = [now["stamp"][f].eqNullSafe(then["stamp"][f]) for f in ("mtime_s", "mtime_ns", "bytes")]
    return (
        F.when(now["hash"].isNotNull() & then["hash"].isNotNull(), now["hash"] != then["hash"])
        .when(timed(now) & timed(then), ~(stamps[0] & stamps[1] & stamps[2]))
        .otherwise(F.lit(True))
    )


def done_walks(walks: DataFrame) -> DataFrame:
    """(walk_id, checkout_id, place, before): the successful walks in the order
    of their checkout, each with the one before it. Repeated rows of a walk count
    once; walks without an id or checkout, and any other status, don't count; a
    null ``started_at`` comes first; equal times go by ``walk_id``."""
    done = walks.where("status = 'done' and walk_id is not null and checkout_id is not null")
    one = done.groupBy("walk_id").agg(F.max("checkout_id").alias("checkout_id"), F.max("started_at").alias("started_at"))
    order = Window.partitionBy("checkout_id").orderBy(F.asc_nulls_first("started_at"), "walk_id")
    return one.select("walk_id", "checkout_id", F.row_number().over(order).alias("place"), F.lag("walk_id").over(order).alias("before"))


def changes(plan: DataFrame, records: DataFrame) -> DataFrame:
    """The added and changed records of the planned walks against the walk
    before each: (walk_id, place, path, record_id, change).

    One record per walk and path counts, that with the latest ``seen_at`` (null
    is earliest), then the highest ``record_id``; spellings of a path are one
    path, and null paths are one path too. Walks without one before them give
    nothing. One shuffle by (checkout, path) serves both steps. The planned walks
    are counted and broadcast up to ``BROADCAST_WALKS``; beyond, Spark decides.
    """
    planned = plan.where("before is not null")
    own = planned.select("walk_id", "checkout_id", "place", F.lit(True).alias("planned"))
    base = planned.select(F.col("before").alias("walk_id"), "checkout_id", (F.col("place") - 1).alias("place"), F.lit(False).alias("planned"))
    roles = own.unionByName(base).groupBy("walk_id", "checkout_id", "place").agg(F.max("planned").alias("planned"))
    rows = records.where("walk_id is not null and record_id is not null").select("walk_id", "record_id", normal_path(F.col("path")).alias("path"), "hash", "stamp", "seen_at")
    small = F.broadcast if planned.count() <= BROADCAST_WALKS else lambda d: d
    rows = rows.join(small(roles), "walk_id").repartition("checkout_id", "path")
    latest = Window.partitionBy("checkout_id", "path", "place").orderBy(F.desc_nulls_last("seen_at"), F.desc("record_id"))
    one = rows.withColumn("_r", F.row_number().over(latest)).where("_r = 1").withColumn("now", F.struct("place", "hash", "stamp"))
    earlier = Window.partitionBy("checkout_id", "path").orderBy("place")
    pairs = one.withColumn("then", F.lag("now").over(earlier)).where("planned")
    known = F.col("then").isNotNull() & (F.col("then")["place"] == F.col("place") - 1)
    change = F.when(~F.coalesce(known, F.lit(False)), F.lit("added")).when(content_changed(F.col("now"), F.col("then")), F.lit("changed"))
    return pairs.withColumn("change", change).where("change is not null").select("walk_id", "place", "path", "record_id", "change")


def _files(records: DataFrame) -> set[str]:
    """The files of a frame, spelt as in ``_metadata.file_path``."""
    return {re.sub(r"^(\w+):///", r"\1:/", f) for f in records.inputFiles()}


class ChangeCapture:
    """Incremental runs whose state lives in ``root``, a folder that all
    executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.manifest = spark, Manifest(spark, root)
        self.folder = self.manifest.folder

    def _pending(self) -> list[int]:
        """Batches that were planned but not committed."""
        done = max([0, *(note["last"] for note in self.manifest.live().values())])
        return sorted(n for x in self.folder.names("plans") if x.startswith("batch=") and (n := int(x.split("=")[1])) > done)

    def _read(self, kind: str, schema: str, labels: list[str]) -> DataFrame:
        frames = [self.spark.read.schema(schema).parquet(self.folder.path(kind, x)).withColumn("batch", F.lit(i)) for i, x in enumerate(labels)]
        return reduce(DataFrame.unionByName, frames, self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0)))

    def covered(self) -> DataFrame:
        """(walk_id, batch, mark, before, before_mark): the latest committed plan of each walk."""
        plans = self._read("plans", _PLAN, list(self.manifest.live()))
        return plans.groupBy("walk_id").agg(F.max(F.struct("batch", "mark", "before", "before_mark", "checkout_id", "place")).alias("x")).select("walk_id", "x.*")

    def _index(self, labels: list[str]) -> DataFrame:
        """The index rows that hold: of a file the newest."""
        rows = self._read("index", _INDEX, labels)
        newest = rows.groupBy("file").agg(F.max("batch").alias("batch"))
        return rows.join(newest, ["file", "batch"], "left_semi").drop("batch")

    def _index_new(self, records: DataFrame, label: str) -> tuple[list[str], set[str]]:
        """Indexes the files of the log that no committed batch has. The list of
        files is what Spark's own listing holds on the driver."""
        files = _files(records)
        known = {r.file for r in self._index(list(self.manifest.live())).select("file").distinct().collect()}
        new = sorted(files - known)
        rows = records.where("walk_id is not null and record_id is not null")
        if files:
            rows = rows.withColumn("file", F.col("_metadata.file_path"))
            rows = rows.where(F.col("file").isin(new)) if len(new) < len(files) else rows
        else:
            rows = rows.withColumn("file", F.lit(""))
        found = rows.groupBy("file", "walk_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("record_id")).alias("h"))
        names = self.spark.createDataFrame([(f, None, 0, 0) for f in new or ([] if files else [""])], _INDEX)
        found.unionByName(names).write.mode("overwrite").parquet(self.folder.path("index", label))
        return [*self.manifest.live(), label], files

    def plan(self, walks: DataFrame, records: DataFrame) -> int | None:
        """Writes the next batch's index and plan; None if there is nothing to do."""
        batch = max([0, *(note["last"] for note in self.manifest.live().values()), *self._pending()]) + 1
        labels, files = self._index_new(records, f"batch={batch}")
        rows = self._index(labels).where("walk_id is not null")
        gone = files and {r.file for r in rows.select("file").distinct().collect()} - files
        rows = rows.where(~F.col("file").isin(sorted(gone))) if gone else rows
        marks = rows.groupBy("walk_id").agg(F.concat_ws(":", F.sum("n"), F.bit_xor("h")).alias("mark"))
        units = done_walks(walks).join(marks, "walk_id", "left").join(marks.select(F.col("walk_id").alias("before"), F.col("mark").alias("before_mark")), "before", "left")
        old = self.covered().select("walk_id", *[F.col(c).alias(f"old_{c}") for c in ("mark", "before", "before_mark")], F.lit(True).alias("seen"))
        same = F.col("seen").isNotNull()
        for c in ("mark", "before", "before_mark"):
            same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
        todo = units.join(old, "walk_id", "left").where(~same).select("walk_id", "checkout_id", "place", "before", "mark", "before_mark")
        self.folder.drop("drafts")
        todo.write.mode("overwrite").parquet(self.folder.path("drafts", batch))
        if self.spark.read.schema(_PLAN).parquet(self.folder.path("drafts", batch)).isEmpty():
            self.folder.drop("drafts")
            return None
        self.folder.move(("drafts", batch), ("plans", f"batch={batch}"))
        return batch

    def _needed(self, plan: DataFrame, records: DataFrame, label: str) -> DataFrame:
        """The rows of the log in files that hold a planned walk or the one before."""
        files = _files(records)
        if not files:
            return records
        wanted = plan.select("walk_id").unionByName(plan.select(F.col("before").alias("walk_id"))).where("walk_id is not null").distinct()
        labels = [*(x for x in self.manifest.live() if x != label), label]
        held = files & {r.file for r in self._index(labels).join(wanted, "walk_id", "left_semi").select("file").distinct().collect()}
        return records if held == files else records.where(F.col("_metadata.file_path").isin(sorted(held)))

    def process(self, batch: int, records: DataFrame) -> None:
        label = f"batch={batch}"
        plan = self.spark.read.schema(_PLAN).parquet(self.folder.path("plans", label))
        changes(plan, self._needed(plan, records, label)).write.mode("overwrite").parquet(self.folder.path("sink", label))

    def commit(self, batch: int) -> None:
        self.manifest.replace({**self.manifest.live(), f"batch={batch}": {"last": batch}})

    def run(self, walks: DataFrame, records: DataFrame) -> list[int]:
        """Replays what failed, then processes what is new. The batches done."""
        done = self._pending()
        for batch in done:
            self.process(batch, records)
            self.commit(batch)
        batch = self.plan(walks, records)
        if batch is not None:
            self.process(batch, records)
            self.commit(batch)
            done.append(batch)
        if len(self.manifest.live()) > MAX_SEGMENTS:
            self.compact()
        return done

    def compact(self) -> None:
        """Merges the committed batches into one. What they were merged from goes
        with the next :meth:`sweep`, when no reader uses it any longer."""
        live, label = self.manifest.live(), fresh_name("merged")
        if len(live) < 2:
            return
        plan = self.covered().select(*[x.split()[0] for x in _PLAN.split(", ")])
        for kind, rows in (("plans", plan), ("index", self._index(list(live))), ("sink", self.result())):
            rows.write.mode("overwrite").parquet(self.folder.path(kind, label))
        self.manifest.replace({label: {"last": max(note["last"] for note in live.values())}})

    def sweep(self) -> None:
        kept = {*self.manifest.live(), *(f"batch={b}" for b in self._pending())}
        for kind in ("plans", "index", "sink"):
            for x in self.folder.names(kind):
                if x not in kept:
                    self.folder.drop(kind, x)
        self.manifest.sweep()

    def result(self) -> DataFrame:
        """(walk_id, place, path, record_id, change): every walk once, as the
        latest batch that covered it left it."""
        labels = list(self.manifest.live())
        rows = self._read("sink", _SINK, labels)
        if len(labels) > 1:
            rows = rows.join(self.covered().select("walk_id", "batch"), ["walk_id", "batch"], "left_semi")
        return rows.drop("batch")
