"""Queries on files: kinds, filters, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.paths import normal_path
from siftwell.functions.text import path_tail_terms
from siftwell.operators import classify, outline
from siftwell.sources import table


def live_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file: repeated rows of a file agree up to nulls."""
    t = table(spark, sf_dir, "code_files").where("file_id is not null")
    return t.groupBy("file_id").agg(F.max("root_id").alias("root_id"), F.max("path").alias("path"), F.max("kind").alias("kind"), F.max("indexed").alias("indexed"), F.max("length").alias("length"), F.max("hash").alias("hash"), F.max("segment_id").alias("segment_id"))


def live_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "code_chunks").where("chunk_id is not null")
    names = F.max_by("names", F.coalesce(F.size("names"), F.lit(-1)))
    return t.groupBy("chunk_id").agg(F.max("file_id").alias("file_id"), F.max("root_id").alias("root_id"), F.max("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("length").alias("length"), F.coalesce(F.max("imports"), F.lit(False)).alias("imports"), names.alias("names"))


FILES = "files as (select file_id, max(root_id) as root_id, max(path) as path, max(kind) as kind, max(indexed) as indexed, max(length) as length, max(hash) as hash, max(segment_id) as segment_id from code_files where file_id is not null group by file_id)"
CHUNKS = "chunks as (select chunk_id, max(file_id) as file_id, max(root_id) as root_id, max(start_line) as start_line, max(end_line) as end_line, max(length) as length, coalesce(max(imports), false) as imports, arg_max(names, coalesce(len(names), -1)) as names from code_chunks where chunk_id is not null group by chunk_id)"


def _listed(names) -> str:
    return ", ".join("'" + n + "'" for n in names)


_FOLDERS = "string_split(path, '/')[:-2]"
_NAME = "string_split(path, '/')[-1]"
_JUNK = f"(list_has_any({_FOLDERS}, [{_listed(classify.JUNK_FOLDERS)}]) or {_NAME} in ({_listed(classify.JUNK_NAMES)}) or {_NAME} like '%.map' or {_NAME} like '%.snap' or contains({_NAME}, '.min.'))"
_TEST = f"(list_has_any({_FOLDERS}, [{_listed(classify.TEST_FOLDERS)}]) or starts_with({_NAME}, 'test_') or contains({_NAME}, '_test.') or contains({_NAME}, '.test.') or contains({_NAME}, '.spec.'))"
_EXT = f"lower(regexp_extract({_NAME}, '^.+\\.([^.]+)$', 1))"
_KIND = f"case when {_EXT} in ({_listed(classify.CODE)}) then case when {_TEST} then 'Test' else 'Code' end when {_EXT} in ({_listed(classify.DOCS)}) then 'Docs' when {_EXT} in ({_listed(classify.CONFIG)}) then 'Config' end"


def kind_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_files(spark, sf_dir).select("file_id", classify.kind_of(F.col("path")).alias("derived_kind"))


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_files(spark, sf_dir).groupBy("root_id", "kind").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("total_length"))


def junk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_files(spark, sf_dir).where(classify.is_junk(F.col("path"))).select("file_id", "path")


def test_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_files(spark, sf_dir).where(classify.is_test_path(F.col("path"))).select("file_id", "path")


def entry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk keeps: known kind, not junk, at most 1 MiB."""
    f = table(spark, sf_dir, "code_files", "file_id", "path", F.col("stamp.bytes").alias("bytes")).distinct()
    p = F.col("path")
    return f.where((F.col("bytes") <= classify.MAX_FILE_BYTES) & ~classify.is_junk(p) & classify.kind_of(p).isNotNull()).select("file_id", "path", "bytes")


def path_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain substring of the path, pushed down to the scan."""
    return table(spark, sf_dir, "code_files", "file_id", "path").where(F.col("path").contains("src/")).distinct()


def content_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each stored question's content and path filters admit. Files are
    counted per kind for the questions without a path filter."""
    q = table(spark, sf_dir, "search_queries", "query_id", "content", "path_filter")
    f = live_files(spark, sf_dir).select("kind", "path")
    kinds = f.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    wanted = classify.admits(F.col("content"), F.col("kind"))
    anywhere = q.where("path_filter is null").join(kinds, wanted).select("query_id", "n")
    below = q.where("path_filter is not null").join(f, F.col("path").contains(F.col("path_filter")) & wanted).select("query_id", F.lit(1).cast("long").alias("n"))
    return anywhere.unionByName(below).groupBy("query_id").agg(F.sum("n").alias("files"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = live_chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg("length"), 6).alias("avg_chunk_len"))
    f = live_files(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_files"), F.round(F.avg("length"), 6).alias("avg_file_len"))
    return c.crossJoin(F.broadcast(f))  # one row each


def directory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.directory_rollup(live_files(spark, sf_dir).select("root_id", "path"), "src/")


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_chunks(spark, sf_dir).groupBy("file_id").agg(F.max("end_line").alias("lines"))


def first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.first_names(live_chunks(spark, sf_dir).select("file_id", "chunk_id", "names"), 6)


def declared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.declared_lines(live_chunks(spark, sf_dir).select("file_id", "names"))


def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files whose names are most like those of the stored questions; a path
    filter names the folder asked in."""
    asked = table(spark, sf_dir, "search_queries", "query_id", F.regexp_replace("text", " ", "").alias("asked"), F.col("path_filter").alias("beside"))
    return outline.near_names(asked, live_files(spark, sf_dir).select("file_id", "path", "kind"))


def tail_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_files(spark, sf_dir).select("file_id", path_tail_terms(F.col("path")).alias("terms"))


def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_records", "record_id", normal_path(F.col("path")).alias("path"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", F.substring(F.sha2("text", 256), 1, 32).alias("hash"))


def minified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.minified(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")


def test_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.reads_as_tests(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")


def import_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.mostly_imports(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")


def _quote(s: str) -> str:
    return classify._quote(s).replace("'", "''")


LINES = r"lines as (select doc_id, unnest(generate_series(1, len(l))) as line, unnest(l) as content from (select doc_id, case when text = '' then [] else regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n') end as l from documents where text is not null))"
_WS = r"[\s\x0b\x{85}\p{Z}]"
TRIM = rf"regexp_replace(regexp_replace(content, '^{_WS}+', ''), '{_WS}+$', '')"
_MARKS = "|".join(map(_quote, classify.ASSERTIONS))

QUERIES = {f.__name__: f for f in (kind_by_extension, kind_counts, junk_filter, test_by_path, entry_filter, path_contains, content_admit, corpus_stats, directory_rollup, file_lines, first_names, declared_lines, near_names, tail_terms, normal_paths, content_hash, minified_files, test_by_content, import_share)}
SQL = {
    "kind_by_extension": f"with {FILES} select file_id, {_KIND} as derived_kind from files",
    "kind_counts": f"with {FILES} select root_id, kind, count(*) as files, sum(length) as total_length from files group by all",
    "junk_filter": f"with {FILES} select file_id, path from files where {_JUNK}",
    "test_by_path": f"with {FILES} select file_id, path from files where {_TEST}",
    "entry_filter": f"select distinct file_id, path, stamp.bytes as bytes from code_files where stamp.bytes <= 1048576 and not {_JUNK} and {_KIND} is not null",
    "path_contains": "select distinct file_id, path from code_files where contains(path, 'src/')",
    "content_admit": f"with {FILES} select query_id, cast(count(*) as bigint) as files from search_queries q join files f on case lower(q.content) when 'code' then f.kind in ('Code', 'Test') when 'docs' then f.kind = 'Docs' when 'config' then f.kind = 'Config' else true end and (q.path_filter is null or contains(f.path, q.path_filter)) group by query_id",
    "corpus_stats": f"with {FILES}, {CHUNKS} select (select count(*) from chunks) as n_chunks, (select round(avg(length), 6) from chunks) as avg_chunk_len, (select count(*) from files) as n_files, (select round(avg(length), 6) from files) as avg_file_len",
    "directory_rollup": f"with {FILES} select root_id, case when contains(substr(path, 5), '/') then string_split(substr(path, 5), '/')[1] || '/' else '' end as entry, count(*) as files from files where starts_with(path, 'src/') group by all",
    "file_lines": f"with {CHUNKS} select file_id, max(end_line) as lines from chunks group by file_id",
    "first_names": f"with {CHUNKS}, n as (select file_id, chunk_id, unnest(names) as x, generate_subscripts(names, 1) as ord from chunks), r as (select file_id, x.name as name, row_number() over (partition by file_id order by chunk_id, ord) as k from n where x.name is not null) select file_id, list(name order by k) filter (k <= 6) as names, count(*) > 6 as more from r group by file_id",
    "declared_lines": f"with {CHUNKS}, n as (select file_id, unnest(names) as x from chunks) select file_id, x.line as line, min(x.name) as name from n where x.name is not null and x.line is not null group by all",
    "tail_terms": r"""with f as (select file_id, max(path) as path from code_files group by file_id),
        w as (select file_id, unnest(regexp_split_to_array(array_to_string(string_split(path, '/')[-2:], '/'), '[^\p{L}\p{N}_]+')) as word from f),
        p as (select file_id, word, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(word, '_', ' '), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{L})([^\p{L} ])', '\1 \2', 'g'), '([^\p{L} ])(\p{L})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), ' '), lambda x: length(x) >= 2 and not regexp_full_match(x, '[0-9]+')) as parts from w where word <> ''),
        t as (select file_id, list_transform(case when len(parts) > 1 then list_append(parts, word) else parts end, lambda x: lower(x)) as ts from p)
        select file_id, list_sort(list_distinct(flatten(list(ts)))) as terms from t group by file_id""",
    "normal_paths": r"select record_id, regexp_replace(regexp_replace(regexp_replace(translate(path, '\', '/'), '/(\./)+', '/', 'g'), '/{2,}', '/', 'g'), '^(\./|/)+|/+$', '', 'g') as path from file_records",
    "content_hash": "select doc_id, substr(sha256(text), 1, 32) as hash from documents",
    "minified_files": f"""with {LINES}, k as (select doc_id, line, strlen(content) > 400 as long from lines),
        i as (select doc_id, long, row_number() over (partition by doc_id order by line) - row_number() over (partition by doc_id, long order by line) as island from k),
        r as (select doc_id, max(n) as longest from (select doc_id, island, count(*) as n from i where long group by all) group by doc_id),
        s as (select d.doc_id, strlen(d.text) as bytes, greatest(coalesce((select count(*) from lines l where l.doc_id = d.doc_id), 0), 1) as n from documents d)
        select s.doc_id, cast(n as integer) as lines, coalesce(bytes > 4096 and bytes // n > 400 and (n < 8 or coalesce(longest, 0) * 2 > n), false) as minified from s left join r on r.doc_id = s.doc_id""",
    "test_by_content": rf"with {LINES} select doc_id, count(*) filter (regexp_matches(content, '^{_WS}*({_MARKS})|[ (]({_MARKS})')) as checking, count(*) as written, checking >= 6 and checking * 100 >= written * 5 as tests from lines where {TRIM} <> '' group by doc_id",
    "import_share": rf"""with {LINES}, t as (select doc_id, {TRIM} as t from lines),
        f as (select doc_id, (starts_with(t, '"') and ends_with(regexp_replace(t, ',+$', ''), '"')) or (ends_with(t, '"') and len(regexp_split_to_array(t, '{_WS}+')) = 2 and contains(t, '/')) or regexp_matches(t, '^({"|".join(map(_quote, classify.IMPORTS))})') or (contains(t, 'require(') and starts_with(t, 'const ')) as imp from t where t not in ('', '(', ')'))
        select doc_id, count(*) filter (imp) as importing, count(*) as written, importing * 5 >= written * 3 as imports from f group by doc_id""",
    "near_names": rf"""with {FILES}, a as (select query_id, path_filter, lower(split_part(replace(text, ' ', ''), '.', 1)) as s from search_queries),
        f as (select file_id, kind, path, lower(split_part({_NAME}, '.', 1)) as s from files),
        g as (select query_id, path_filter, list_transform(generate_series(1, length(s)), lambda i: substr(' ' || s || ' ', i, 3)) as w from a),
        h as (select file_id, kind, path, list_transform(generate_series(1, length(s)), lambda i: substr(' ' || s || ' ', i, 3)) as h from f),
        x as (select query_id, file_id, round(2.0 * len(list_filter(w, lambda t: list_contains(h, t))) / (len(w) + len(h)), 9) as likeness, kind, coalesce(starts_with(path, path_filter), false) as beside from g, h),
        r as (select query_id, file_id, likeness, row_number() over (partition by query_id order by round(likeness + case when beside then 1 else 0 end - case when kind = 'Test' then 0.5 else 0 end, 9) desc, file_id) as rank from x where likeness >= case when beside then 0.3 else 0.6 end)
        select query_id, file_id, likeness, cast(rank as integer) as rank from r where rank <= 5""",
}
