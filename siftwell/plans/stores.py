"""Queries of vectors, chunks, declarations and the index as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import analyze, vectors
from siftwell.functions import text as T
from siftwell.functions.paths import normal_path
from siftwell.operators import chunker, declare, segments, store
from siftwell.operators.changes import content_changed, done_walks
from siftwell.plans.files import CHUNKS, FILES, live_chunks, live_files
from siftwell.sources import table


CODE_PATH = r"\.(?:py|go|ts|js|rs|java|c|h)$"
LEADS = r"^\s*(?:def|class|fn|interface|trait|function|func)\s+(?:\([^)]*\)\s*)?[A-Za-z_$][A-Za-z0-9_$]*"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), "label")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100, as a question."""
    return _vectors(spark, sf_dir).where("doc % 100 = 0").select(F.col("doc").alias("query_id"), "vector")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dense_channel(_asked(spark, sf_dir), _vectors(spark, sf_dir), 10).select("query_id", F.col("doc").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _vectors(spark, sf_dir).select("doc", vectors.quantized(F.col("vector")).alias("x"))
    return q.select(F.col("doc").alias("vec_id"), F.aggregate(F.transform("x.q", lambda v: v.cast("long")), F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.round("x.scale", 9).alias("scale"))


def quantized_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _vectors(spark, sf_dir).select("doc", vectors.quantized(F.col("vector")).alias("x"))
    back = q.select("doc", F.transform("x.q", lambda v: v.cast("double") * F.col("x.scale")).alias("vector"))
    return vectors.dense_channel(_asked(spark, sf_dir), back, 10).select("query_id", F.col("doc").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = vectors.mean_direction(_vectors(spark, sf_dir), "label", "vector")
    return m.select("label", F.posexplode("direction").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def file_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, here the labels, by their mean direction, for every question vector."""
    means = vectors.mean_direction(_vectors(spark, sf_dir), "label", "vector").select(F.col("label").cast("long").alias("doc"), F.col("direction").alias("vector"))
    return vectors.dense_channel(_asked(spark, sf_dir), means, 3).select("query_id", F.col("doc").alias("label"), F.round("score", 6).alias("score"), "rank")


def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunker.chunk_spans(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declare.declarations(table(spark, sf_dir, "documents", "doc_id", "path", "text"), "doc_id")


def declared_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of declarations whose line leads with a declaring word, in code."""
    docs = table(spark, sf_dir, "documents", "doc_id", "path", "text").where(F.lower("path").rlike(CODE_PATH))
    names = declare.declarations(docs, "doc_id").select("doc_id", "line", "name")
    lines = T.explode_lines(docs.select("doc_id", "text")).where(F.col("content").rlike(LEADS))
    return names.join(lines, ["doc_id", "line"]).select("doc_id", "name").distinct()


def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed postings of whole texts: body, declared names and path together."""
    docs = table(spark, sf_dir, "documents", "doc_id", "path", "text")
    body = analyze.index_terms(docs, "doc_id").select(F.col("doc_id").alias("chunk_id"), "term", F.col("tf").alias("n"))
    names = analyze.index_terms(declare.declarations(docs, "doc_id").select("doc_id", "name"), "doc_id", "name").groupBy(F.col("doc_id").alias("chunk_id"), "term").agg(F.sum("tf").alias("n"))
    tails = docs.where("path is not null").select("doc_id", segments.tail(F.col("path")).alias("tail"))
    paths = analyze.index_terms(tails, "doc_id", "tail").select(F.col("doc_id").alias("chunk_id"), "term", F.lit(1).alias("n"))
    return store.built_postings(body, names, paths)


def file_postings_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File postings from stored chunk postings: the sum over a file's chunks, and 2
    once for a term of the path, on unstemmed path terms."""
    p = table(spark, sf_dir, "chunk_postings").where("weight > 0 and term is not null and chunk_id is not null and file_id is not null").groupBy("term", "chunk_id", "file_id").agg(F.max("weight").alias("own"))
    own = p.select(F.col("file_id").alias("path"), "term", "own", F.lit(False).alias("in_path"))
    tails = live_files(spark, sf_dir).select(F.col("file_id").alias("path"), F.explode(T.path_tail_terms(F.col("path"))).alias("term"), F.lit(0).alias("own"), F.lit(True).alias("in_path"))
    return segments.file_weights(own.unionByName(tails)).withColumnRenamed("path", "file_id")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    walks = done_walks(table(spark, sf_dir, "tree_walks"))
    r = table(spark, sf_dir, "file_records", "record_id", "walk_id", normal_path(F.col("path")).alias("path"), "hash", "stamp", "seen_at")
    return r.join(walks, "walk_id")


def merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest state of every path of every checkout."""
    rows = _versions(spark, sf_dir).select("checkout_id", "path", "place", "seen_at", "record_id", "hash")
    return store.latest(rows, ["checkout_id", "path"], ["place", "seen_at", "record_id"]).select("checkout_id", "path", "record_id", "hash")


def _ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """First and last successful walk of each checkout."""
    rows = _versions(spark, sf_dir)
    ends = rows.groupBy("checkout_id").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a < b")
    one = store.latest(rows.join(ends, "checkout_id").where("place = a or place = b").withColumn("first", F.col("place") == F.col("a")).select("checkout_id", "path", "first", "seen_at", "record_id", "hash", "stamp"), ["checkout_id", "path", "first"], ["seen_at", "record_id"])
    return tuple(one.where("first" if x else "not first").select("checkout_id", "path", "hash", "stamp") for x in (True, False))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First against last successful walk of each checkout."""
    old, new = _ends(spark, sf_dir)
    return store.differences(old, new, ["checkout_id", "path"], content_changed(F.col("n"), F.col("o")))


def borrow_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the newest state of each checkout whose content (path, hash and kind)
    another checkout of the same root has already read."""
    walks = done_walks(table(spark, sf_dir, "tree_walks")).select("walk_id", "place")
    r = table(spark, sf_dir, "file_records", "record_id", "walk_id", "root_id", "checkout_id", normal_path(F.col("path")).alias("path"), "hash", "walked_kind", "seen_at").join(walks, "walk_id")
    want = store.latest(r, ["checkout_id", "path"], ["place", "seen_at", "record_id"]).where("hash is not null").select("root_id", "checkout_id", "path", "hash", "walked_kind")
    return store.borrowed(want, r.drop("place", "seen_at", "walk_id"), ["root_id", "path", "hash", "walked_kind"], ["record_id"], ["record_id"], "checkout_id").select("checkout_id", "path", "donor_record_id")


def borrow_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text and kind another document has, with the newest of those."""
    d = table(spark, sf_dir, "documents", "doc_id", F.sha2("text", 256).alias("hash"), "kind", "fetched_at").where("hash is not null")
    return store.borrowed(d.drop("fetched_at"), d, ["hash", "kind"], ["fetched_at", "doc_id"], ["doc_id"], "doc_id").select("doc_id", "donor_doc_id")


def racy_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the stamp of the walk before them but another hash, last written
    within two seconds of that walk's end."""
    rows = _versions(spark, sf_dir).select("checkout_id", "path", "place", "walk_id", "hash", "stamp", "seen_at", "record_id")
    one = store.latest(rows, ["checkout_id", "path", "place"], ["seen_at", "record_id"]).drop("seen_at")
    ended = table(spark, sf_dir, "tree_walks", "walk_id", F.col("finished_at").cast("long").alias("walked")).groupBy("walk_id").agg(F.max("walked").alias("walked"))
    old = one.join(ended, "walk_id").withColumn("place", F.col("place") + 1).drop("record_id", "walk_id")
    return store.racy(old, one.drop("walk_id"), ["checkout_id", "path", "place"], F.col("o.walked"))


def touched_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`racy_edits` for any time of the edit since the walk a day before it
    ended: the same check with a wider margin."""
    rows = _versions(spark, sf_dir).select("checkout_id", "path", "place", "walk_id", "hash", "stamp", "seen_at", "record_id")
    one = store.latest(rows, ["checkout_id", "path", "place"], ["seen_at", "record_id"]).drop("seen_at")
    started = table(spark, sf_dir, "tree_walks", "walk_id", F.col("started_at").cast("long").alias("walked")).groupBy("walk_id").agg(F.max("walked").alias("walked"))
    old = one.join(started, "walk_id").withColumn("place", F.col("place") + 1).drop("record_id", "walk_id")
    return store.racy(old, one.drop("walk_id"), ["checkout_id", "path", "place"], F.col("o.walked") - 86_400_000)


def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first snapshot of each checkout, brought up to the last by its differences."""
    old, new = _ends(spark, sf_dir)
    keys = ["checkout_id", "path"]
    found = store.differences(old, new, keys, content_changed(F.col("n"), F.col("o")))
    fresh = new.join(found.where("change <> 'gone'").select(*keys), keys, "left_semi")
    return store.upsert(old, fresh, found.where("change = 'gone'"), keys).select("checkout_id", "path", "hash")


def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the segments of the live index call for a merge: chunks of files
    that could not be read, or are gone, are dead."""
    f, c = live_files(spark, sf_dir).select("file_id", "segment_id", "indexed"), live_chunks(spark, sf_dir).select("chunk_id", "file_id")
    s = c.join(f, "file_id").groupBy("segment_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.coalesce("indexed", F.lit(False))).alias("live"))
    return store.upkeep(s)


def live_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings per term once those of unread files are out."""
    live = live_files(spark, sf_dir).where("indexed").select("file_id")
    p = table(spark, sf_dir, "file_postings").where("weight > 0 and term is not null").select("term", "file_id").distinct()
    return p.join(live, "file_id", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("files"))


def segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk postings of all segments of the live index merged into one dictionary."""
    p = table(spark, sf_dir, "chunk_postings").where("weight > 0 and term is not null and chunk_id is not null").select("term", "chunk_id", "file_id", "weight")
    held = live_files(spark, sf_dir).select("file_id", F.col("segment_id").alias("segment"))
    merged = store.merged_postings(p.groupBy("term", "chunk_id", "file_id").agg(F.max("weight").alias("weight")).join(held, "file_id"))
    return merged.groupBy("term").agg(F.count(F.lit(1)).alias("postings"), F.sum("weight").alias("weight"))


def file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids in path order."""
    return store.dense_ids(live_files(spark, sf_dir).select("path", F.col("file_id").alias("old_id")), ["path", "old_id"], "new_id")


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest state per user of the event stream, as a batch."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return store.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (dense_topk, quantize, quantized_dense_topk, mean_vector, chunk_spans, declarations, declared_by_keyword, index_postings, file_postings_plain, merge_on_read, upsert_snapshot, touched_again, file_dense_topk, snapshot_diff, borrow_by_hash, borrow_texts, racy_edits, compaction, live_map, segment_merge, file_ids, latest_events)}

_D = "list_transform(embedding, lambda x: cast(x as double))"
_TOP = "select query_id, vec_id, round(score, 6) as score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score > 0) where rank <= 10"
_DONE = "done as (select walk_id, checkout_id, cast(row_number() over (partition by checkout_id order by started_at nulls first, walk_id) as integer) as place from (select walk_id, max(checkout_id) as checkout_id, max(started_at) as started_at from tree_walks where status = 'done' and walk_id is not null and checkout_id is not null group by walk_id))"
_VERSIONS = rf"{_DONE}, v as (select d.checkout_id, d.place, r.record_id, r.hash, r.stamp, r.seen_at, regexp_replace(regexp_replace(regexp_replace(translate(r.path, '\', '/'), '/(\./)+', '/', 'g'), '/{{2,}}', '/', 'g'), '^(\./|/)+|/+$', '', 'g') as path from file_records r join done d on d.walk_id = r.walk_id)"
_CHANGED = "(case when n.hash is not null and o.hash is not null then n.hash <> o.hash when n.stamp.mtime_s is not null and n.stamp.mtime_ns is not null and o.stamp.mtime_s is not null and o.stamp.mtime_ns is not null then n.stamp is distinct from o.stamp else true end)"
_PARTS = r"list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(word, '_', ' '), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{L})([^\p{L} ])', '\1 \2', 'g'), '([^\p{L} ])(\p{L})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), ' '), lambda x: length(x) >= 2 and not regexp_full_match(x, '[0-9]+'))"
_RACY = "with " + _VERSIONS.replace("{", "{{").replace("}", "}}") + ", one as (select v.*, d.walk_id from v join done d on d.checkout_id = v.checkout_id and d.place = v.place qualify row_number() over (partition by v.checkout_id, path, v.place order by seen_at desc, record_id desc) = 1), ended as (select walk_id, max(epoch_us({at})) // 1000000 as walked from tree_walks group by walk_id) select n.checkout_id, n.path, n.place from one n join one o on o.checkout_id = n.checkout_id and o.path = n.path and o.place = n.place - 1 join ended e on e.walk_id = o.walk_id where n.stamp is not distinct from o.stamp and n.stamp.mtime_s >= e.walked - {margin} and n.hash is distinct from o.hash"
SQL = {
    "dense_topk": f"with e as (select vec_id, {_D} as v from embeddings), s as (select a.vec_id as query_id, b.vec_id, round(list_dot_product(a.v, b.v), 9) as score from e a, e b where a.vec_id % 100 = 0) " + _TOP,
    "quantize": f"with e as (select vec_id, {_D} as v from embeddings), s as (select vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127.0 as scale from e) select vec_id, cast(list_sum(list_transform(v, lambda x: cast(round(x / scale) as bigint))) as bigint) as total, round(scale, 9) as scale from s",
    "quantized_dense_topk": f"with e as (select vec_id, {_D} as v from embeddings), q as (select vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127.0 as scale from e), b as (select vec_id, list_transform(v, lambda x: round(x / scale) * scale) as w from q), s as (select a.vec_id as query_id, b.vec_id, round(list_dot_product(b.w, a.v), 9) as score from e a, b where a.vec_id % 100 = 0) " + _TOP,
    "mean_vector": f"with e as (select label, {_D} as v from embeddings), p as (select label, generate_subscripts(v, 1) as i, unnest(v) as x from e), t as (select label, i, sum(x) as x from p group by all), m as (select label, sqrt(sum(x * x)) as norm from t group by label) select t.label, cast(i - 1 as integer) as i, round(case when norm > 0 then x / norm else x end, 6) as x from t join m on m.label = t.label",
    "merge_on_read": f"with {_VERSIONS} select checkout_id, path, record_id, hash from v qualify row_number() over (partition by checkout_id, path order by place desc, seen_at desc, record_id desc) = 1",
    "snapshot_diff": f"with {_VERSIONS}, ends as (select checkout_id, min(place) as a, max(place) as b from v group by all having a < b), one as (select v.*, place = a as first from v join ends e on e.checkout_id = v.checkout_id where place in (a, b) qualify row_number() over (partition by v.checkout_id, path, place order by seen_at desc, record_id desc) = 1), o as (select * from one where first), n as (select * from one where not first) select coalesce(o.checkout_id, n.checkout_id) as checkout_id, coalesce(o.path, n.path) as path, case when o.record_id is null then 'added' when n.record_id is null then 'gone' else 'changed' end as change from o full outer join n on o.checkout_id = n.checkout_id and o.path = n.path where o.record_id is null or n.record_id is null or {_CHANGED}",
    "borrow_by_hash": rf"with {_DONE}, r as (select d.place, r.record_id, r.root_id, r.checkout_id, r.hash, r.walked_kind, r.seen_at, regexp_replace(regexp_replace(regexp_replace(translate(r.path, '\', '/'), '/(\./)+', '/', 'g'), '/{{2,}}', '/', 'g'), '^(\./|/)+|/+$', '', 'g') as path from file_records r join done d on d.walk_id = r.walk_id), w as (select * from r qualify row_number() over (partition by checkout_id, path order by place desc, seen_at desc, record_id desc) = 1) select w.checkout_id, w.path, max(d.record_id) as donor_record_id from w join r d on d.root_id = w.root_id and d.path = w.path and d.hash = w.hash and d.walked_kind = w.walked_kind and d.checkout_id <> w.checkout_id group by all",
    "borrow_texts": "with d as (select doc_id, text, kind, fetched_at from documents where text is not null), r as (select *, row_number() over (partition by text, kind order by fetched_at desc nulls last, doc_id desc) as k from d) select a.doc_id, b.doc_id as donor_doc_id from r a join r b on b.text = a.text and b.kind = a.kind and b.k = case when a.k = 1 then 2 else 1 end",
    "racy_edits": _RACY.format(at="finished_at", margin=2),
    "touched_again": _RACY.format(at="started_at", margin=86400002),
    "upsert_snapshot": f"with {_VERSIONS}, ends as (select checkout_id, min(place) as a, max(place) as b from v group by all having a < b), n as (select v.* from v join ends e on e.checkout_id = v.checkout_id where place = b qualify row_number() over (partition by v.checkout_id, path order by seen_at desc, record_id desc) = 1), o as (select v.* from v join ends e on e.checkout_id = v.checkout_id where place = a qualify row_number() over (partition by v.checkout_id, path order by seen_at desc, record_id desc) = 1) select n.checkout_id, n.path, case when o.record_id is not null and not {_CHANGED} then o.hash else n.hash end as hash from n left join o on o.checkout_id = n.checkout_id and o.path = n.path",
    "declared_by_keyword": rf"with docs as (select doc_id, text from documents where regexp_matches(lower(path), '{CODE_PATH}') and text is not null and text <> ''), lines as (select doc_id, unnest(regexp_split_to_array(text, '\r?\n')) as content from docs), n as (select distinct doc_id, regexp_extract(content, '^\s*(?:def|class|fn|interface|trait|function|func)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][A-Za-z0-9_$]*)', 1) as name from lines where regexp_matches(content, '{LEADS}')) select doc_id, name from n where name not in ({', '.join(repr(x) for x in sorted(declare.RESERVED))})",
    "file_postings_plain": rf"""with {FILES}, w as (select file_id, unnest(regexp_split_to_array(array_to_string(string_split(path, '/')[-2:], '/'), '[^\p{{L}}\p{{N}}_]+')) as word from files),
        p as (select file_id, word, {_PARTS} as parts from w where word <> ''),
        t as (select distinct file_id, unnest(list_transform(case when len(parts) > 1 then list_append(parts, word) else parts end, lambda x: lower(x))) as term from p),
        c as (select term, chunk_id, file_id, max(weight) as weight from chunk_postings where weight > 0 and term is not null and chunk_id is not null and file_id is not null group by all),
        u as (select file_id, term, weight from c union all select file_id, term, 2 from t)
        select file_id, term, cast(sum(weight) as integer) as weight from u group by all""",
    "file_dense_topk": f"with e as (select label, {_D} as v from embeddings), p as (select label, generate_subscripts(v, 1) as i, unnest(v) as x from e), t as (select label, i, sum(x) as x from p group by all), m as (select label, list(x order by i) as s from t group by label), n as (select label, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) as v from m), s as (select a.vec_id as query_id, n.label as vec_id, round(list_dot_product(n.v, list_transform(a.embedding, lambda x: cast(x as double))), 9) as score from embeddings a, n where a.vec_id % 100 = 0), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score > 0) select query_id, cast(vec_id as bigint) as label, round(score, 6) as score, cast(rank as integer) as rank from r where rank <= 3",
    "compaction": f"with {FILES}, {CHUNKS}, s as (select f.segment_id, count(*) as chunks, count(*) filter (coalesce(f.indexed, false)) as live from chunks c join files f on f.file_id = c.file_id group by f.segment_id) select count(*) as segments, cast(sum(chunks) as bigint) as chunks, cast(sum(live) as bigint) as live, round(1 - sum(live) / sum(chunks), 9) as dead_share, count(*) > 8 or 1 - sum(live) / sum(chunks) > 0.25 as compact from s",
    "live_map": f"with {FILES} select p.term, count(distinct p.file_id) as files from file_postings p join files f on f.file_id = p.file_id where f.indexed and p.weight > 0 and p.term is not null group by p.term",
    "segment_merge": f"with {FILES} select term, count(*) as postings, cast(sum(weight) as bigint) as weight from (select p.term, p.chunk_id, max(p.weight) as weight from chunk_postings p join files f on f.file_id = p.file_id where p.weight > 0 and p.term is not null and p.chunk_id is not null group by all) group by term",
    "file_ids": f"with {FILES} select path, file_id as old_id, row_number() over (order by path, file_id) - 1 as new_id from files",
    "latest_events": "select user_id, event_id, event_type, round(value, 6) as value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
}
