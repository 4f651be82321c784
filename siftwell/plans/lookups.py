"""Queries on the lines and words of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import analyze
from siftwell.functions import text as T
from siftwell.operators import lookup, outline
from siftwell.plans.files import FILES, LINES, TRIM, live_chunks, live_files
from siftwell.sources import table

SYMBOL, PATTERN, LITERAL = "stack", r"return [a-z]+\(", "cargo"
QUESTION = ["stack", "thread", "kernel", "cache"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.explode_lines(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("content")).alias("chars"), F.max(F.char_length("content")).alias("longest"))


def camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of the queries and declared names, cut into their parts."""
    names = live_chunks(spark, sf_dir).select(F.explode("names").alias("x")).select(F.col("x.name").alias("name")).where(F.col("name").rlike("^[A-Za-z0-9_]+$")).distinct()
    return names.select("name", T.parts(F.col("name")).alias("parts"))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select("doc_id", F.explode(T.plain_words(F.col("text"))).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index terms of each text before stemming, as counts."""
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("doc_id").alias("documents"))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "chunk_postings").where("weight > 0 and term is not null and chunk_id is not null")
    return p.select("term", "chunk_id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "search_queries", "query_id", "text")
    return q.select("query_id", F.array_distinct(T.plain_words(F.col("text"))).alias("terms"), F.array_sort(T.identifier_words(F.col("text"))).alias("identifiers"))


def query_terms_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms of the stored questions without stop words, before stemming."""
    return analyze.query_terms(table(spark, sf_dir, "search_queries", "query_id", "text").dropDuplicates(["query_id"]), stemmed=False)


def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = T.explode_lines(_docs(spark, sf_dir))
    return ls.groupBy("doc_id").agg(F.count_if(T.comment_line(F.col("content"))).alias("comments"), F.count(F.lit(1)).alias("lines"))


def grep_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.grep(_docs(spark, sf_dir), PATTERN, "doc_id")


def whole_word_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where(F.col("text").contains(SYMBOL))
    return lookup.matching_lines(docs, T.whole_word(F.col("content"), SYMBOL), "doc_id")


def literal_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where(F.col("text").contains(LITERAL))
    return lookup.matching_lines(docs, F.col("content").contains(LITERAL), "doc_id").select("doc_id", "line", T.clip(F.col("content"), 60).alias("content"))


def quoted_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where(F.col("text").contains(LITERAL))
    return lookup.matching_lines(docs, T.quoted(F.col("content"), LITERAL), "doc_id").select("doc_id", "line")


def posting_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.candidates(table(spark, sf_dir, "file_postings", "term", "file_id", "weight"), ["return", "stack"])


def _file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "file_id", "text").where("file_id is not null and text is not null and text <> ''")
    return d.groupBy("file_id").agg(F.min_by("text", "doc_id").alias("text"))


def _usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "file_id", "text").where("file_id is not null and text is not null and text <> ''")
    first = docs.groupBy("file_id").agg(F.min_by("text", "doc_id").alias("text")).where(F.col("text").contains(SYMBOL))
    found = lookup.matching_lines(first, T.whole_word(F.col("content"), SYMBOL), "file_id")
    declared = outline.declared_lines(live_chunks(spark, sf_dir).select("file_id", "names"))
    labelled = lookup.with_enclosing(found, declared.join(found.select("file_id").distinct(), "file_id", "left_semi"), SYMBOL)
    return labelled.join(live_files(spark, sf_dir).where("kind <> 'Config'").select("file_id", "path", "kind"), "file_id")


def inside_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages of a word, each with the declaration it sits in."""
    return _usages(spark, sf_dir).select("file_id", "line", "inside", "declares")


def usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usages(spark, sf_dir).agg(F.count_if(~F.col("declares")).alias("usages"), F.count_distinct("file_id").alias("files"))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usages(spark, sf_dir).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("lines"), F.count_if("declares").alias("declarations"))


def usage_order_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.budgeted(_usages(spark, sf_dir)).select("position", "file_id", "line")


def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.snippet_window(T.explode_lines(_docs(spark, sf_dir)), QUESTION, 12, "doc_id")


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of pages outside fenced blocks: fence parity is a running sum."""
    from pyspark.sql import Window

    pages = table(spark, sf_dir, "documents", "doc_id", "kind", "text").where("kind = 'Docs'").select("doc_id", "text")
    ls = T.explode_lines(pages).withColumn("fence", F.col("content").rlike(r"^\s*(?:```|~~~)").cast("int"))
    open_ = F.sum("fence").over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)) % 2
    title = F.regexp_extract("content", r"^#{1,6}[ \t]+(.*?)[#\s]*$", 1)
    out = ls.withColumn("open", open_).where("open = 0 and fence = 0").withColumn("title", title).where("title <> ''")
    return out.select("doc_id", "line", "title")


def comment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of comment lines, folded from two on."""
    ls = T.explode_lines(_docs(spark, sf_dir)).select("doc_id", "line", T.comment_line(F.col("content")).alias("block"))
    return outline.runs(ls, "doc_id", "line", "block").where("block and n >= 2").select("doc_id", F.col("first").alias("first_line"), F.col("last").alias("last_line"))


QUERIES = {f.__name__: f for f in (lines_explode, camel_split, term_frequency, tokenize_terms, document_frequency, query_terms, query_terms_stop, comment_lines, grep_regex, whole_word_usages, literal_usages, quoted_literal, posting_intersection, inside_label, usage_counts, usage_totals, usage_order_budget, snippet_window, headings, comment_runs)}

_GAP = r"[^\p{L}\p{N}_]"
_CUT = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(word, '_', ' '), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{L})([^\p{L} ])', '\1 \2', 'g'), '([^\p{L} ])(\p{L})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')"
_PARTS = f"list_transform(list_filter(string_split({_CUT}, ' '), lambda x: length(x) >= 2 and not regexp_full_match(x, '[0-9]+')), lambda x: lower(x))"
_STOP = ", ".join("'" + w + "'" for w in (*analyze.ENGLISH, *analyze.RUSSIAN))
_COMMENT = rf"regexp_matches({TRIM}, '^(//|/\*|--|\*( |$)|#($|[^\[!id]|i($|[^n])|in($|[^c])|inc($|[^l])|incl($|[^u])|inclu($|[^d])|includ($|[^e])|d($|[^e])|de($|[^f])|def($|[^i])|defi($|[^n])|defin($|[^e])))')"
_DECLARED = "declared as (select file_id, x.line as line, min(x.name) as name from (select file_id, unnest(names) as x from chunks) where x.name is not null and x.line is not null group by all)"
_USAGES = rf"""with {FILES}, chunks as (select chunk_id, max(file_id) as file_id, arg_max(names, coalesce(len(names), -1)) as names from code_chunks where chunk_id is not null group by chunk_id), {_DECLARED},
  texts as (select file_id, arg_min(text, doc_id) as text from documents where file_id is not null and text is not null and text <> '' group by file_id),
  l as (select file_id, unnest(generate_series(1, len(l))) as line, unnest(l) as content from (select file_id, regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n') as l from texts)),
  u as (select l.*, f.path, f.kind, (select max_by(d.name, d.line) from declared d where d.file_id = l.file_id and d.line <= l.line and d.name <> '{SYMBOL}') as inside,
    exists (select 1 from declared d where d.file_id = l.file_id and d.line = l.line and d.name = '{SYMBOL}') as declares
    from l join files f on f.file_id = l.file_id where f.kind <> 'Config' and regexp_matches(content, '(^|{_GAP}){SYMBOL}($|{_GAP})'))"""
_FLAGS = [f"regexp_matches(lower(content), '(^|{_GAP}){t}($|{_GAP})')" for t in QUESTION]
SQL = {
    "lines_explode": f"with {LINES} select doc_id, count(*) as lines, cast(sum(length(content)) as bigint) as chars, max(cast(length(content) as integer)) as longest from lines group by doc_id",
    "camel_split": f"with chunks as (select chunk_id, arg_max(names, coalesce(len(names), -1)) as names from code_chunks where chunk_id is not null group by chunk_id), n as (select distinct x.name as word from (select unnest(names) as x from chunks) where regexp_full_match(x.name, '[A-Za-z0-9_]+')) select word as name, {_PARTS} as parts from n",
    "term_frequency": f"with w as (select doc_id, lower(unnest(regexp_split_to_array(text, '{_GAP}+'))) as term from documents) select doc_id, term, count(*) as tf from w where length(term) >= 2 group by all",
    "tokenize_terms": f"with w as (select doc_id, unnest(regexp_split_to_array(text, '{_GAP}+')) as word from documents), p as (select doc_id, lower(word) as whole, {_PARTS} as ps from w where word <> ''), t as (select doc_id, unnest(case when len(ps) > 1 then list_append(ps, whole) else ps end) as term from p) select term, count(*) as occurrences, count(distinct doc_id) as documents from t group by term",
    "document_frequency": "select term, count(distinct chunk_id) as df from chunk_postings where weight > 0 and term is not null and chunk_id is not null group by term",
    "query_terms": f"""with w as (select query_id, text, list_filter(regexp_split_to_array(text, '{_GAP}+'), lambda x: x <> '') as ws from search_queries),
        l as (select *, list_filter(ws, lambda x: length(x) >= 3) as long from w),
        o as (select query_id, unnest(list_transform(list_filter(ws, lambda x: length(x) >= 2), lambda x: lower(x))) as t, unnest(generate_series(1, len(list_filter(ws, lambda x: length(x) >= 2)))) as k from w),
        f as (select query_id, list(t order by k) as terms from (select query_id, t, min(k) as k from o group by all) group by query_id)
        select l.query_id, coalesce(f.terms, []) as terms, list_sort(list_concat(list_transform(list_filter(long, lambda x: len(long) = 1 or contains(x, '_') or regexp_matches(x, '^.\\P{{Lu}}*\\p{{Lu}}')), lambda x: lower(x)),
          list_transform(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: regexp_replace(x, '^[.#%]+|[,:;{{]+$', '', 'g')), lambda x: contains(x, '-') and regexp_full_match(x, '[\\p{{L}}\\p{{N}}_$-]+')), lambda x: lower(x)))) as identifiers
        from l left join f on f.query_id = l.query_id""",
    "query_terms_stop": f"with q as (select query_id, any_value(text) as text from search_queries group by query_id), w as (select query_id, unnest(regexp_split_to_array(text, '{_GAP}+')) as word from q), p as (select query_id, lower(word) as whole, list_filter({_PARTS}, lambda x: x not in ({_STOP})) as ps from w where word <> ''), t as (select distinct query_id, unnest(case when len(ps) > 1 then list_append(ps, whole) else ps end) as term from p) select query_id, term, cast(count(*) over (partition by query_id) as integer) as n_terms from t",
    "comment_lines": f"with {LINES} select doc_id, count(*) filter ({_COMMENT}) as comments, count(*) as lines from lines group by doc_id",
    "grep_regex": rf"with {LINES} select doc_id, line, content from lines where regexp_matches(content, 'return [a-z]+\(')",
    "whole_word_usages": f"with {LINES} select doc_id, line, content from lines where regexp_matches(content, '(^|{_GAP}){SYMBOL}($|{_GAP})')",
    "literal_usages": f"with {LINES} select doc_id, line, case when length(content) > 60 then substr(content, 1, 60) || '…' else content end as content from lines where contains(content, '{LITERAL}')",
    "quoted_literal": f"""with {LINES} select doc_id, line from lines where regexp_matches(content, '["''`]{LITERAL}|{LITERAL}["''`]')""",
    "posting_intersection": "select file_id from file_postings where term in ('return', 'stack') and weight > 0 group by file_id having count(distinct term) = 2",
    "inside_label": _USAGES + " select file_id, line, inside, declares from u",
    "usage_counts": _USAGES + " select count(*) filter (not declares) as usages, count(distinct file_id) as files from u",
    "usage_totals": _USAGES + " select path, kind, count(*) as lines, count(*) filter (declares) as declarations from u group by all",
    "usage_order_budget": _USAGES + ", c as (select file_id, path, kind, count(*) as n from u group by all), p as (select file_id, row_number() over (order by case when kind in ('Code', 'Config') then 0 when kind = 'Test' then 1 else 2 end, n desc, path, file_id) as place from c), r as (select u.*, place, row_number() over (partition by u.file_id order by declares desc, line) as r from u join p on p.file_id = u.file_id where place <= 40) select * from (select cast(row_number() over (order by place, r) as integer) as position, file_id, line from r where r <= 8) where position <= 40",
    "snippet_window": f"""with {LINES}, b as (select doc_id, line, count(*) over (partition by doc_id) as n, {' | '.join(f"(case when {f} then {1 << i} else 0 end)" for i, f in enumerate(_FLAGS))} as bits from lines),
        w as (select doc_id, line, n, bit_or(bits) over f as seen, sum(bit_count(bits)) over f as hits from b window f as (partition by doc_id order by line rows between current row and 11 following)),
        v as (select *, bit_count(seen) as d, greatest(n - 11, 1) as e from w where line <= greatest(n - 11, 1) and seen <> 0),
        r as (select *, row_number() over (partition by doc_id order by d desc, hits desc, line) as r from v),
        m as (select r.*, least(greatest((select min(b.line) from b where b.doc_id = r.doc_id and b.line between r.line and r.line + 11 and b.bits <> 0) - 2, 1), e) as slid from r where r = 1)
        select m.doc_id, coalesce(v.line, m.line) as first_line, cast(m.d as integer) as distinct_terms, cast(m.hits as bigint) as hits from m left join v on v.doc_id = m.doc_id and v.line = m.slid and v.d = m.d and v.hits = m.hits""",
    "headings": rf"""with {LINES}, d as (select l.*, case when regexp_matches(content, '^\s*(```|~~~)') then 1 else 0 end as fence from lines l join documents d on d.doc_id = l.doc_id where d.kind = 'Docs'),
        o as (select *, sum(fence) over (partition by doc_id order by line) % 2 as open, regexp_extract(content, '^#{{1,6}}[ \t]+(.*?)[#\s]*$', 1) as title from d)
        select doc_id, line, title from o where open = 0 and fence = 0 and title <> ''""",
    "comment_runs": f"with {LINES}, k as (select doc_id, line, {_COMMENT} as c from lines), i as (select doc_id, line, c, row_number() over (partition by doc_id order by line) - row_number() over (partition by doc_id, c order by line) as g from k) select doc_id, min(line) as first_line, max(line) as last_line from i where c group by doc_id, g having count(*) >= 2",
}
