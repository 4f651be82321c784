"""A persistent index of texts: segments of files, chunks and postings.

A segment holds what was read of some files at one time, keyed by path: the file
(stamp, hash, kind; ``gone`` marks a deletion), its chunks and their postings.
The newest row of a path counts; older ones are dead and go with the next merge.
A refresh compares a new listing with the live files, reads only what is new,
changed or in doubt, and appends one segment. Vectors may be attached to a
segment later under its name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import analyze
from siftwell.operators import chunker, declare
from siftwell.operators.classify import mostly_imports
from siftwell.operators.manifest import Manifest, fresh_name
from siftwell.operators.store import DEAD_SHARE, MAX_SEGMENTS, RACY_SECONDS, latest
from siftwell.session import materialise

FILES = "path string, kind string, indexed boolean, stamp struct<mtime_s:bigint,mtime_ns:int,bytes:bigint>, hash string, seen_s bigint, gone boolean"
CHUNKS = "path string, ord int, start_line int, end_line int, length double, imports boolean, names array<struct<name:string,line:int>>"
POSTINGS = "path string, ord int, term string, own int, in_path boolean"
VECTORS = "path string, ord int, vector array<float>"
TABLES = {"files": FILES, "chunks": CHUNKS, "postings": POSTINGS}
NAME_WEIGHT, PATH_WEIGHT = 3, 2


def tail(path: Column) -> Column:
    """The last two components of a path."""
    p = F.split(path, "/")
    return F.array_join(F.when(F.size(p) > 2, F.slice(p, -2, 2)).otherwise(p), "/")


def chunk_bodies(texts: DataFrame) -> DataFrame:
    """(path, ord, start_line, end_line, body) of texts (path, text)."""
    spans = chunker.chunk_spans(texts, "path")
    lines = F.slice(F.split("text", "\r?\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    return spans.join(texts.select("path", "text"), "path").select("path", "ord", "start_line", "end_line", F.array_join(lines, "\n").alias("body"))


def chunk_tables(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, postings) of texts (path, text), one row per path. Postings hold
    ``own``, the weight of body (1) and declared names (3) in the chunk, and
    whether the term is in the path, which weighs 2 once per chunk and per file."""
    bodies = materialise(chunk_bodies(texts), "bodies").withColumn("key", F.struct("path", "ord"))
    terms = materialise(analyze.index_terms(bodies.select("key", "body"), "key", "body"), "terms")
    named = declare.chunk_declarations(texts.select(F.col("path").alias("key"), "path", "text"), "key").select(F.col("key").alias("path"), "ord", "name", "line")
    named = materialise(named, "names")
    of_names = analyze.index_terms(named.select(F.struct("path", "ord").alias("key"), "name"), "key", "name")
    paths = texts.select("path", tail(F.col("path")).alias("tail"))
    of_paths = bodies.select("path", "ord").join(analyze.index_terms(paths, "path", "tail").select("path", "term"), "path")
    parts = [
        terms.select("key.path", "key.ord", "term", F.col("tf").alias("own"), F.lit(False).alias("in_path")),
        of_names.select("key.path", "key.ord", "term", (NAME_WEIGHT * F.col("tf")).alias("own"), F.lit(False).alias("in_path")),
        of_paths.select("path", "ord", "term", F.lit(0).alias("own"), F.lit(True).alias("in_path")),
    ]
    postings = reduce(DataFrame.unionByName, parts).groupBy("path", "ord", "term").agg(F.sum("own").cast("int").alias("own"), F.max("in_path").alias("in_path"))
    lengths = terms.groupBy("key.path", "key.ord").agg(F.sum("tf").cast("double").alias("length"))
    imports = mostly_imports(bodies.select("key", F.col("body").alias("text")), "key").select("key.path", "key.ord", "imports")
    names = named.groupBy("path", "ord").agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("n"))
    pairs = F.transform("n", lambda x: F.struct(x["name"].alias("name"), x["line"].alias("line")))
    chunks = bodies.select("path", "ord", "start_line", "end_line").join(lengths, ["path", "ord"], "left").join(imports, ["path", "ord"], "left").join(names, ["path", "ord"], "left")
    empty = F.array().cast("array<struct<name:string,line:int>>")
    return chunks.select("path", "ord", "start_line", "end_line", F.coalesce("length", F.lit(0.0)).alias("length"), F.coalesce("imports", F.lit(False)).alias("imports"), F.coalesce(pairs, empty).alias("names")), postings


class IndexStore:
    """The segments below ``root``; one writer. ``texts`` given to it are rows of a
    tree: (path, kind, indexed, stamp, hash, text), one per path."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.manifest = spark, Manifest(spark, root)

    def _write(self, texts: DataFrame, gone: DataFrame | None, now: int):
        texts = materialise(texts, "fresh")

        def to(path: str) -> None:
            files = texts.select("path", "kind", "indexed", "stamp", "hash", F.lit(now).cast("long").alias("seen_s"), F.lit(False).alias("gone"))
            if gone is not None:
                blank = self.spark.createDataFrame([], FILES).drop("path", "gone")
                dead = gone.select("path", *[F.lit(None).cast(f.dataType).alias(f.name) for f in blank.schema.fields], F.lit(True).alias("gone"))
                files = files.unionByName(dead)
            chunks, postings = chunk_tables(texts.where("indexed and text is not null"))
            for name, df in (("files", files), ("chunks", chunks), ("postings", postings)):
                df.write.mode("overwrite").parquet(f"{path}/{name}")

        return to

    def append(self, texts: DataFrame, now: int, gone: DataFrame | None = None, name: str | None = None) -> str:
        """Reads ``texts`` into a new segment; ``gone`` (path) are deletions. A name
        that is live already is left as it is."""
        return self.manifest.add(name or fresh_name("files"), self._write(texts, gone, now))

    def build(self, texts: DataFrame, now: int, batches: int = 1) -> int:
        """A first build in ``batches`` of paths, each a segment of its own: a build
        that broke off goes on with the batches that aren't live yet. Their number."""
        todo = [b for b in range(batches) if f"build-{b}-of-{batches}" not in self.manifest.live()]
        for b in todo:
            self.append(texts.where(F.pmod(F.xxhash64("path"), F.lit(batches)) == b), now, name=f"build-{b}-of-{batches}")
        return len(todo)

    def _all(self, table: str) -> DataFrame:
        schema = TABLES[table]
        frames = [self.spark.read.schema(schema).parquet(f"{self.manifest.path(s)}/{table}").withColumn("segment", F.lit(i)) for i, s in enumerate(self.manifest.live())]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema).withColumn("segment", F.lit(0))

    def _newest(self) -> DataFrame:
        return latest(self._all("files"), ["path"], ["segment"])

    def files(self) -> DataFrame:
        """The live files, with the number of the segment that holds them."""
        return self._newest().where("not gone")

    def _live(self, table: str) -> DataFrame:
        return self._all(table).join(self.files().select("path", "segment"), ["path", "segment"], "left_semi").drop("segment")

    def chunks(self) -> DataFrame:
        return self._live("chunks")

    def postings(self) -> DataFrame:
        return self._live("postings")

    def changes(self, listing: DataFrame) -> DataFrame:
        """(path, change) of a listing (path, kind, stamp) against the live files:
        added, changed (other stamp or kind), gone, or racy: the stamp is the same,
        but the file was last written within two seconds of when it was read, so
        its content is in doubt."""
        old = self.files().select("path", F.struct("stamp", "kind", "seen_s").alias("o"))
        both = old.join(listing.select("path", F.struct("stamp", "kind").alias("n")), "path", "full_outer")
        o, n = F.col("o"), F.col("n")
        racy = o["stamp"]["mtime_s"] >= o["seen_s"] - RACY_SECONDS
        change = F.when(o.isNull(), "added").when(n.isNull(), "gone").when(~o["stamp"].eqNullSafe(n["stamp"]) | ~o["kind"].eqNullSafe(n["kind"]), "changed").when(racy, "racy")
        return both.select("path", change.alias("change")).where("change is not null")

    def refresh(self, tree: DataFrame, now: int, only: DataFrame | None = None) -> bool:
        """Brings the index up to a tree; ``only`` (path) narrows it to what a change
        stream named. Racy files count as changed only if their hash differs. Whether
        there was anything to do."""
        found = self.changes(tree.select("path", "kind", "stamp"))
        found = materialise(found if only is None else found.join(only, "path", "left_semi"), "changes")
        fresh = tree.join(found.where("change <> 'gone'"), "path")
        held = self.files().select("path", F.col("hash").alias("held"))
        fresh = fresh.join(held, "path", "left").where((F.col("change") != "racy") | ~F.col("hash").eqNullSafe(F.col("held"))).drop("change", "held")
        fresh, gone = materialise(fresh, "reread"), found.where("change = 'gone'").select("path")
        if fresh.isEmpty() and gone.isEmpty():
            return False
        self.append(fresh, now, gone)
        return True

    def borrow(self, missing: DataFrame, donor: IndexStore) -> DataFrame:
        """(path, hash) of ``missing`` (path, hash, kind) that another checkout's
        index has already read: same path, content and kind."""
        have = donor.files().select("path", "hash", "kind")
        return missing.where("hash is not null").join(have, ["path", "hash", "kind"], "left_semi").select("path", "hash")

    def shares(self) -> DataFrame:
        """(segments, chunks, live, dead_share, compact), one row: whether more than 8
        segments, or more than a quarter of dead chunks, call for a merge."""
        every = self._all("chunks").agg(F.count(F.lit(1)).alias("chunks"))
        alive = self.chunks().agg(F.count(F.lit(1)).alias("live"))
        n = len(self.manifest.live())
        dead = F.when(F.col("chunks") > 0, 1 - F.col("live") / F.col("chunks")).otherwise(F.lit(0.0))
        both = every.crossJoin(F.broadcast(alive))  # one row each
        return both.select(F.lit(n).alias("segments"), "chunks", "live", dead.alias("dead_share"), (F.lit(n > MAX_SEGMENTS) | (dead > DEAD_SHARE)).alias("compact"))

    def compact(self, always: bool = False) -> bool:
        """Merges the live rows of all segments into one where that is called for.
        Deleted paths need no mark any longer, since no older rows are left."""
        if len(self.manifest.live()) < 2 or not (always or self.shares().first()["compact"]):
            return False
        name = fresh_name("merged")
        for table in TABLES:
            rows = self.files().drop("segment") if table == "files" else self._live(table)
            keys = [k for k in ("term", "path", "ord") if k in rows.columns]
            rows.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{self.manifest.path(name)}/{table}")
        self.manifest.replace({name: {}})
        return True

    def attach_vectors(self, segment: str, vectors: DataFrame) -> None:
        """Vectors (path, ord, vector) of a segment's chunks, written aside and moved
        into place at once. They must be as many as the chunks."""
        chunks = self.spark.read.schema(CHUNKS).parquet(f"{self.manifest.path(segment)}/chunks").count()
        aside = fresh_name("vectors")
        vectors.select("path", "ord", F.col("vector").cast("array<float>").alias("vector")).write.parquet(self.manifest.folder.path("aside", aside))
        if self.spark.read.schema(VECTORS).parquet(self.manifest.folder.path("aside", aside)).count() != chunks:
            self.manifest.folder.drop("aside", aside)
            raise ValueError(f"segment {segment} has {chunks} chunks, and as many vectors are needed")
        self.manifest.folder.move(("aside", aside), ("segments", segment, "vectors"))

    def vectors(self) -> DataFrame | None:
        """(path, ord, vector) of all live chunks, or None while any segment lacks
        them: until then answers rank by words only."""
        live = self.manifest.live()
        if not live or not all(self.manifest.folder.exists("segments", s, "vectors") for s in live):
            return None
        frames = [self.spark.read.schema(VECTORS).parquet(f"{self.manifest.path(s)}/vectors").withColumn("segment", F.lit(i)) for i, s in enumerate(live)]
        return reduce(DataFrame.unionByName, frames).join(self.files().select("path", "segment"), ["path", "segment"], "left_semi").drop("segment")


def chunk_weights(postings: DataFrame) -> DataFrame:
    """(path, ord, term, weight): body and names, and 2 for a term of the path."""
    return postings.select("path", "ord", "term", (F.col("own") + F.when(F.col("in_path"), PATH_WEIGHT).otherwise(0)).alias("weight"))


def file_weights(postings: DataFrame) -> DataFrame:
    """(path, term, weight): the sum over a file's chunks, and 2 once for a term of
    its path, however many chunks it has."""
    out = postings.groupBy("path", "term").agg(F.sum("own").alias("own"), F.max("in_path").alias("in_path"))
    return out.select("path", "term", (F.col("own") + F.when(F.col("in_path"), PATH_WEIGHT).otherwise(0)).cast("int").alias("weight"))
