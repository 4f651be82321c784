"""Queries of what an answer shows: usages, outlines, extents, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import declare, evaluate, extent, lookup, outline, rank, usages
from siftwell.plans.files import CHUNKS, FILES, LINES, live_chunks, live_files
from siftwell.plans.lookups import _GAP, SYMBOL
from siftwell.plans.searches import _IDENT
from siftwell.sources import table

BUDGET = 12
SHEETS = r"\.(?:css|scss|less|pcss|postcss)$"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "file_id", "text").where("file_id is not null and text is not null and text <> ''")
    return d.groupBy("file_id").agg(F.min_by("text", "doc_id").alias("text")).join(live_files(spark, sf_dir).select("file_id", "path", "kind"), "file_id")


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.declared_lines(live_chunks(spark, sf_dir).select("file_id", "names"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usages.collected(_texts(spark, sf_dir), _declared(spark, sf_dir), usages.needle(SYMBOL))


def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages of a word, comment lines out, with the declaration each sits in."""
    return _found(spark, sf_dir).select("file_id", "line", "inside", "declares")


def usage_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of them that an answer of a few lines shows, and what it leaves out."""
    return usages.answered(_found(spark, sf_dir), BUDGET).select("role", "place", "file_id", "line", "inside")


def usage_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usages.elsewhere(_found(spark, sf_dir))


def name_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of declarations of one block in files of three declarations or more."""
    return outline.rule_blocks(_declared(spark, sf_dir), 2)


def file_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of every file that has a text."""
    lines = T.explode_lines(_texts(spark, sf_dir).select("file_id", "path", "text"))
    return outline.file_outlines(_declared(spark, sf_dir), lines, F.col("path").rlike(SHEETS))


def section_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extent.section_extents(table(spark, sf_dir, "documents", "doc_id", "kind", "text").where("kind = 'Docs'"), "doc_id")


def declaration_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each declaration of each text of code reaches."""
    docs = table(spark, sf_dir, "documents", "doc_id", "path", "kind", "text").where("kind in ('Code', 'Test')")
    return extent.declaration_extents(docs, declare.declarations(docs, "doc_id"), "doc_id")


def _best_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 best stored lexical hits of each question, with their file and lines."""
    h = table(spark, sf_dir, "search_hits", "query_id", "chunk_id", "channel", "score", "start_line", "end_line").where("channel = 'lexical' and score is not null and not isnan(score)")
    one = h.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.max("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    r = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= rank.LIMIT)
    return r.join(live_chunks(spark, sf_dir).select("chunk_id", "file_id"), "chunk_id")


def span_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extent.span_names(_best_hits(spark, sf_dir), live_chunks(spark, sf_dir))


def asked_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first declaration that the question names, inside each chunk that has one."""
    q, c = table(spark, sf_dir, "search_queries", "query_id", "text").dropDuplicates(["query_id"]), live_chunks(spark, sf_dir)
    hits = rank.name_matches(q, c).join(c.select("chunk_id", "file_id", "start_line", "end_line"), "chunk_id")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))
    return extent.asked_declarations(hits, q, c).select("query_id", "rank", "name", "line")


def probe_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which distinct file of the lexical hits the file of the best dense hit stands."""
    h = table(spark, sf_dir, "search_hits", "query_id", "chunk_id", "channel", "score").where("channel = 'dense' and score is not null and not isnan(score)")
    best = h.groupBy("query_id").agg(F.max_by("chunk_id", F.struct("score", -F.col("chunk_id"))).alias("chunk_id"))
    where = live_chunks(spark, sf_dir).select("chunk_id", "file_id").join(live_files(spark, sf_dir).select("file_id", "path"), "file_id")
    probes = best.join(where, "chunk_id").select("query_id", F.col("path").alias("expected"))
    hits = _best_hits(spark, sf_dir).join(live_files(spark, sf_dir).select("file_id", "path"), "file_id").select("query_id", "rank", "path")
    return evaluate.file_ranks(probes, hits, 20)


def probe_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.evaluated(probe_ranks(spark, sf_dir).select(F.col("query_id").alias("probe_id"), "rank"))


QUERIES = {f.__name__: f for f in (usage_lines, usage_answer, usage_elsewhere, name_blocks, file_outline, section_extents, declaration_extents, span_names, asked_declarations, probe_ranks, probe_recall)}

_WS = r"[\s\x0b\x{85}\p{Z}]"
_TRIMMED = rf"regexp_replace(regexp_replace(content, '^{_WS}+', ''), '{_WS}+$', '')"
_COMMENT = rf"regexp_matches({_TRIMMED}, '^(//|/\*|--|\*( |$)|#($|[^\[!id]|i($|[^n])|in($|[^c])|inc($|[^l])|incl($|[^u])|inclu($|[^d])|includ($|[^e])|d($|[^e])|de($|[^f])|def($|[^i])|defi($|[^n])|defin($|[^e])))')"
_D = "declared as (select file_id, x.line as line, min(x.name) as name from (select file_id, unnest(names) as x from chunks) where x.name is not null and x.line is not null group by all)"
_TEXTS = r"texts as (select file_id, arg_min(text, doc_id) as text from documents where file_id is not null and text is not null and text <> '' group by file_id), l as (select t.file_id, f.path, f.kind, unnest(generate_series(1, len(l))) as line, unnest(l) as content from (select file_id, regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n') as l from texts) t join files f on f.file_id = t.file_id)"
_U = rf"""with {FILES}, {CHUNKS}, {_D}, {_TEXTS},
  u as (select l.*, (select max_by(d.name, d.line) from declared d where d.file_id = l.file_id and d.line <= l.line and d.name <> '{SYMBOL}') as inside,
    exists (select 1 from declared d where d.file_id = l.file_id and d.line = l.line and d.name = '{SYMBOL}') as declares
    from l where kind <> 'Config' and regexp_matches(content, '(^|{_GAP}){SYMBOL}($|{_GAP})') and (kind = 'Docs' or not {_COMMENT}))"""
_HITS = "h as (select query_id, chunk_id, max(score) as score, max(start_line) as start_line, max(end_line) as end_line from search_hits where channel = 'lexical' and score is not null and not isnan(score) group by all), b as (select h.*, c.file_id, row_number() over (partition by query_id order by score desc, h.chunk_id) as rank from h join chunks c on c.chunk_id = h.chunk_id qualify rank <= 8)"
_INSIDE = _HITS + ", i as (select b.query_id, b.rank, c.chunk_id as chunk, unnest(c.names) as x, generate_subscripts(c.names, 1) as ord from b join chunks c on c.file_id = b.file_id and c.start_line >= b.start_line and c.end_line <= b.end_line), n as (select query_id, rank, chunk, ord, x.name as name, x.line as line from i where x.name is not null)"
_KIND = "case when kind in ('Code', 'Config') then 0 when kind = 'Test' then 1 else 2 end"
_BLOCK = r"case when regexp_matches(name, '^(--|\$)') then 'variables' else regexp_extract(name, '^(.*?)(__|--|_|$)', 1) end"
_PROBES = "p as (select query_id, arg_max(chunk_id, (score, -chunk_id)) as chunk_id from search_hits where channel = 'dense' and score is not null and not isnan(score) group by query_id), e as (select p.query_id, f.path as expected from p join chunks c on c.chunk_id = p.chunk_id join files f on f.file_id = c.file_id), d as (select b.query_id, f.path, min(b.rank) as first from b join files f on f.file_id = b.file_id group by all), k as (select *, row_number() over (partition by query_id order by first) as place from d), r as (select e.query_id, cast(min(k.place) as integer) as rank from e left join k on k.query_id = e.query_id and contains(k.path, e.expected) and k.place <= 20 group by e.query_id)"
SQL = {
    "usage_lines": _U + " select file_id, line, inside, declares from u",
    "usage_elsewhere": _U + " , c as (select file_id, path, kind, count(*) as n from u group by all) select cast(coalesce(sum(n), 0) as bigint) as lines, count(*) as files, (select coalesce(list(path order by t, n desc, path), []) from (select path, n, case when kind = 'Test' then 1 else 0 end as t from c order by t, n desc, path limit 3)) as named from c",
    "usage_answer": _U + f""", c as (select file_id, path, kind, count(*) as n, count(*) filter (not declares) as uses from u group by all),
      f as (select *, row_number() over (order by {_KIND}, n desc, path, file_id) as place from c where uses > 0),
      g as (select *, greatest((select greatest({BUDGET} - count(*) filter (declares), 0) from u) - coalesce(sum(least(uses, 8)) over (order by place rows between unbounded preceding and 1 preceding), 0), 0) as room from f),
      s as (select *, least(uses, 8, room) as shown from g),
      a as (select s.place, s.shown, u.file_id, u.line, u.inside, row_number() over (partition by u.file_id order by u.line) as r from u join s on s.file_id = u.file_id where not declares and s.shown > 0)
      select 'declared' as role, 0 as place, file_id, line, null as inside from u where declares
      union all select case when r <= shown then 'shown' else 'also' end, cast(place as integer), file_id, line, case when r <= shown then inside end from a
      union all select 'unshown', cast(place as integer), file_id, uses, null from (select *, row_number() over (order by place) as k from s where shown = 0 and place <= {BUDGET + 10}) where k <= 10""",
    "name_blocks": f"with {CHUNKS}, {_D}, b as (select file_id, line, {_BLOCK} as block from declared where file_id in (select file_id from declared group by file_id having count(*) > 2)), i as (select *, row_number() over (partition by file_id order by line) - row_number() over (partition by file_id, block order by line) as g from b) select file_id, block, min(line) as first, max(line) as last, count(*) as n from i group by file_id, block, g",
    "file_outline": rf"""with {FILES}, {CHUNKS}, {_D}, {_TEXTS}, v as (select *, regexp_matches(name, '^(--|\$)') as variable from declared),
      i as (select *, row_number() over (partition by file_id order by line) - row_number() over (partition by file_id, variable order by line) as g from v),
      r as (select *, case when variable then count(*) over (partition by file_id, variable, g) else 0 end as run, min(line) over (partition by file_id, variable, g) as first, max(line) over (partition by file_id, variable, g) as last from i),
      j as (select r.*, l.content, {_TRIMMED} as t, regexp_extract(content, '^({_WS}*)', 1) as margin, regexp_matches(l.path, '{SHEETS}') as sheet from r join l on l.file_id = r.file_id and l.line = r.line where run < 6 or r.line = first),
      s as (select *, regexp_replace(regexp_replace(case when sheet then regexp_replace(t, '(?s)\{{.*$', '') else t end, '[{{(:]+$', ''), '{_WS}+$', '') as said from j)
      select file_id, line, cast(least(ceil((length(margin) + 3 * (length(margin) - length(replace(margin, chr(9), '')))) / 4.0), 3) as integer) as depth,
        case when run >= 6 then name || ' ... ' || run || ' variables, to line ' || last else case when length(said) > 120 then substr(said, 1, 120) || '…' else said end || case when starts_with(said, '&') then '  = ' || name else '' end end as text from s""",
    "section_extents": rf"""with {LINES}, d as (select l.*, case when regexp_matches(content, '^\s*(```|~~~)') then 1 else 0 end as fence from lines l join documents d on d.doc_id = l.doc_id where d.kind = 'Docs'),
      o as (select *, sum(fence) over (partition by doc_id order by line) % 2 as open from d),
      s as (select *, case when open = 0 and fence = 0 then length(regexp_extract(content, '^\s*(#+) ', 1)) else 0 end as stop, regexp_matches(content, '[^\s\x0b\x{{85}}\p{{Z}}]') as written from o),
      h as (select doc_id, line, regexp_extract(content, '^#{{1,6}}[ \t]+(.*?)[#\s]*$', 1) as title, length(regexp_extract(content, '^(#+)', 1)) as level from s where open = 0 and fence = 0),
      e as (select h.doc_id, h.line, h.title, (select min(s.line) from s where s.doc_id = h.doc_id and s.line > h.line and s.stop between 1 and h.level) as stop from h where title <> '')
      select e.doc_id, e.line, e.title, greatest(coalesce((select max(s.line) from s where s.doc_id = e.doc_id and s.written and s.line < coalesce(e.stop, 1000000000)), e.line), e.line) as last from e""",
    "span_names": f"with {CHUNKS}, {_INSIDE}, k as (select *, row_number() over (partition by query_id, rank order by chunk, ord) as k from n) select query_id, cast(rank as integer) as rank, list(name order by k) as names from k where k <= 8 group by query_id, rank",
    "asked_declarations": rf"""with {CHUNKS}, q as (select query_id, any_value(text) as text from search_queries group by query_id), {_IDENT},
      b as (select d.query_id, c.chunk_id, c.file_id, c.start_line, c.end_line, row_number() over (partition by d.query_id order by c.chunk_id) as rank from decl d join chunks c on c.chunk_id = d.chunk_id), {_INSIDE.removeprefix(_HITS + ", ")},
      w as (select query_id, list_transform(list_concat(list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_$]+'), lambda x: x <> ''), list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: regexp_replace(x, '^[.#%]+|[,:;{{]+$', '', 'g')), lambda x: contains(x, '-') and regexp_full_match(x, '[\p{{L}}\p{{N}}_$-]+'))), lambda x: lower(x)) as words from q)
      select n.query_id, cast(rank as integer) as rank, name, line from n join w on w.query_id = n.query_id where list_contains(words, lower(name)) qualify row_number() over (partition by n.query_id, rank order by chunk, ord) = 1""",
    "probe_ranks": f"with {FILES}, {CHUNKS}, {_HITS}, {_PROBES} select query_id, rank from r",
    "probe_recall": f"with {FILES}, {CHUNKS}, {_HITS}, {_PROBES} select count(*) as probes, " + ", ".join(f"round(avg(case when rank <= {k} then 1 else 0 end), 9) as recall_{k}" for k in (1, 3, 5, 10, 20)) + ", round(avg(coalesce(1.0 / rank, 0)), 9) as mrr from r",
}
