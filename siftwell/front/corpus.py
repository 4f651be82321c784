"""A tree with its index, and the four questions it answers as DataFrames."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import analyze
from siftwell.functions.text import explode_lines
from siftwell.operators import extent, lookup, outline, rank, segments, store, usages
from siftwell.session import materialise, scratch
from siftwell.sources import tree

QUERY = "query_id long, text string, content string, path_filter string"
SHEETS = r"\.(?:css|scss|less|pcss|postcss)$"


class Corpus:
    """The index of ``root`` in the folder ``kept`` (a temporary one by default), brought
    up to date when opened, and the tables that answers are made from."""

    def __init__(self, spark: SparkSession, root: str, kept: str | None = None, now: int | None = None) -> None:
        tree.register(spark)
        self.spark, self.root = spark, root
        self.store = segments.IndexStore(spark, kept or scratch(spark, "index"))
        read = materialise(spark.read.format("tree").option("path", root).load(), "tree")
        self.store.refresh(read, int(time.time()) if now is None else now)
        if self.store.compact():
            self.store.manifest.sweep()
        self._tables(read)

    def _tables(self, read: DataFrame) -> None:
        live = self.store.files().where("indexed")
        ids = materialise(store.dense_ids(live.select("path", "kind"), ["path"], "file_id"), "files")
        chunks = self.store.chunks().join(ids.select("path", "file_id"), "path")
        chunks = materialise(store.dense_ids(chunks, ["file_id", "ord"], "chunk_id"), "chunks")
        sizes = chunks.groupBy("file_id").agg(F.sum("length").alias("length"))
        self.files = materialise(ids.join(sizes, "file_id", "left").fillna({"length": 0.0}), "sized")
        self.chunks = chunks.drop("path", "ord")
        postings = self.store.postings()
        keys = chunks.select("path", "ord", F.col("chunk_id").alias("doc"))
        self.chunk_postings = materialise(segments.chunk_weights(postings).join(keys, ["path", "ord"]).select("term", "doc", "weight"), "chunk_postings")
        self.file_postings = materialise(segments.file_weights(postings).join(ids.select("path", F.col("file_id").alias("doc")), "path").select("term", "doc", "weight"), "file_postings")
        self.texts = materialise(read.where("indexed").select("path", "text").join(ids, "path"), "texts")
        self.declared = materialise(outline.declared_lines(chunks), "declared")
        self.every_name = chunks.select("file_id", F.explode("names").alias("x")).select("file_id", F.col("x.line").alias("line"), F.col("x.name").alias("name")).distinct()

    def question(self, text: str, content: str = "code", path: str | None = None) -> DataFrame:
        return self.spark.createDataFrame([(1, text, content, path)], QUERY)

    def search(self, queries: DataFrame, limit: int = rank.LIMIT) -> DataFrame:
        """(HIT columns, rank, path, kind) of a batch of questions."""
        hits = rank.search(queries, analyze.query_terms(queries), self.chunk_postings, self.file_postings, self.chunks, self.files, limit)
        return hits.join(self.files.select("file_id", "path", "kind"), "file_id")

    def documented(self, queries: DataFrame, limit: int = rank.LIMIT) -> DataFrame:
        """As :meth:`search`; questions for code whose first hit declares nothing are
        answered from pages instead, if a page's heading titles them. Adds ``from_page``."""
        return rank.documented(queries, lambda q: self.search(q, limit))

    def usages(self, n: usages.Needle, path: str | None = None) -> DataFrame:
        said = usages.pruning_words(n)
        terms = [r.term for r in analyze.index_terms(self.spark.createDataFrame([(1, said)], "k int, text string"), "k").select("term").distinct().collect()] if said else []
        among = lookup.candidates(self.file_postings.withColumnRenamed("doc", "file_id"), terms) if terms else None
        return usages.collected(self.texts, self.every_name, n, path, among)

    def outline_of(self, files: DataFrame) -> DataFrame:
        """(file_id, line, depth, text) of some files."""
        own = self.texts.join(files.select("file_id"), "file_id", "left_semi")
        return outline.file_outlines(self.declared.join(files.select("file_id"), "file_id", "left_semi"), explode_lines(own.select("file_id", "path", "text")), F.col("path").rlike(SHEETS))

    def line_of(self, hits: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, rank, name, line): the declaration that a question asked for."""
        titles = rank.heading_matches(queries, self.chunks, self.files)
        return extent.asked_declarations(hits, queries, self.chunks, titles)
