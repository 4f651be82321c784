"""Queries of the search flow, stage by stage. ``*_plain`` and the stages use
unstemmed terms, for which SQL has an equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import plain_words
from siftwell.operators import rank
from siftwell.plans.files import CHUNKS, FILES, live_chunks, live_files
from siftwell.sources import table


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "search_queries", "query_id", "text", "content", "path_filter").dropDuplicates(["query_id"])


def plain_terms(queries: DataFrame) -> DataFrame:
    t = queries.select("query_id", F.array_distinct(plain_words(F.col("text"))).alias("ts"))
    return t.select("query_id", F.size("ts").alias("n_terms"), F.explode("ts").alias("term"))


def _chunk_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.postings_of(table(spark, sf_dir, "chunk_postings"), "chunk_id")


def _file_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.postings_of(table(spark, sf_dir, "file_postings"), "file_id")


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.bm25(plain_terms(_queries(spark, sf_dir)), _chunk_postings(spark, sf_dir), live_chunks(spark, sf_dir).select(F.col("chunk_id").alias("doc"), "length"))


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`_lexical`, of the chunks that a question admits."""
    q = _queries(spark, sf_dir)
    chunks = live_chunks(spark, sf_dir).select(F.col("chunk_id").alias("doc"), "file_id", "length").join(live_files(spark, sf_dir).select("file_id", "kind", "path"), "file_id")
    return rank.bm25(plain_terms(q).join(q.select("query_id", "content", "path_filter"), "query_id"), _chunk_postings(spark, sf_dir), chunks, rank.admits_file())


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lexical(spark, sf_dir)
    return s.select("query_id", F.col("doc").alias("chunk_id"), F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


def bm25_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.channel(_admitted(spark, sf_dir)).withColumnRenamed("doc", "chunk_id")


def file_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rank.bm25(plain_terms(_queries(spark, sf_dir)), _file_postings(spark, sf_dir), live_files(spark, sf_dir).select(F.col("file_id").alias("doc"), "length"))
    return rank.channel(s).withColumnRenamed("doc", "file_id")


def _stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    h = table(spark, sf_dir, "search_hits", "query_id", "chunk_id", "channel", "score").where((F.col("channel") == name) & F.col("score").isNotNull() & ~F.isnan("score"))
    return h.groupBy("query_id", F.col("chunk_id").alias("doc")).agg(F.max("score").alias("score"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored channels, fused by reciprocal rank."""
    got = [(rank.channel(_stored(spark, sf_dir, c)), w) for c, w in (("lexical", 1.0), ("dense", 1.0), ("file", 0.5))]
    return rank.fuse(*got).select("query_id", F.col("doc").alias("chunk_id"), F.round("fused", 9).alias("fused"))


def heading_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.heading_matches(_queries(spark, sf_dir), live_chunks(spark, sf_dir), live_files(spark, sf_dir))


def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.name_matches(_queries(spark, sf_dir), live_chunks(spark, sf_dir))


def _boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c, f = _queries(spark, sf_dir), live_chunks(spark, sf_dir), live_files(spark, sf_dir)
    lexical = _admitted(spark, sf_dir)
    return rank.boosted(rank.fuse((rank.channel(lexical), 1.0)), rank.name_matches(q, c), q, c, f, lexical)


def name_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "declares")


def same_file_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.decayed(_boosted(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


def search_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search over all stored questions, on unstemmed terms."""
    q = _queries(spark, sf_dir)
    return rank.search(q, plain_terms(q), _chunk_postings(spark, sf_dir), _file_postings(spark, sf_dir), live_chunks(spark, sf_dir), live_files(spark, sf_dir))


def search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``search_plain``, with stop words out and terms stemmed."""
    from siftwell.functions.analyze import query_terms

    q = _queries(spark, sf_dir)
    return rank.search(q, query_terms(q), _chunk_postings(spark, sf_dir), _file_postings(spark, sf_dir), live_chunks(spark, sf_dir), live_files(spark, sf_dir))


def present_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an answer shows each hit, on the lexical hits after boosts and decay."""
    from pyspark.sql import Window

    h = rank.decayed(_boosted(spark, sf_dir)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= rank.LIMIT)
    return rank.presented(h)


def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the best stored dense hit of each question ranks in the lexical channel."""
    from pyspark.sql import Window

    want = _stored(spark, sf_dir, "dense").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))).where("r = 1").select("query_id", "doc")
    got = rank.channel(_stored(spark, sf_dir, "lexical"))
    return rank.evaluated(want.join(got, ["query_id", "doc"], "left").select(F.col("query_id").alias("probe_id"), "rank"))


QUERIES = {f.__name__: f for f in (bm25_batch, bm25_channel, file_channel, rrf_fusion, heading_match, name_match, name_boost, same_file_decay, search_plain, search_stemmed, present_policy, recall_mrr)}

_Q = "q as (select query_id, any_value(text) as text, any_value(content) as content, any_value(path_filter) as path_filter from search_queries group by query_id)"
_W = r"list_filter(list_transform(regexp_split_to_array({}, '[^\p{{L}}\p{{N}}_]+'), lambda x: lower(x)), lambda x: length(x) >= 2)"
_QT = f"qt as (select query_id, len(ts) as n_terms, unnest(ts) as term from (select query_id, list_distinct({_W.format('text')}) as ts from q))"


def _bm25(doc: str, postings: str, docs: str, out: str) -> str:
    return f"""{out}_p as (select term, {doc} as doc, max(weight) as weight from {postings} where weight > 0 and term is not null and {doc} is not null group by all),
  {out}_df as (select term, count(*) as df from {out}_p group by term),
  {out}_st as (select count(*) as n_docs, greatest(avg(length), 1) as mean from {docs}),
  {out} as (select query_id, doc, round(s * m / greatest(n, 1), 9) as score, m / greatest(n, 1) as coverage from (
    select t.query_id, p.doc, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * p.weight * 2.2 / (p.weight + 1.2 * (0.25 + 0.75 * d.length / mean))) as s, count(*) as m, max(t.n_terms) as n
    from qt t join {out}_p p on p.term = t.term join {out}_df f on f.term = t.term join {docs} d on d.{doc} = p.doc, {out}_st group by all))"""


_ADMIT = "(case lower(q.content) when 'code' then f.kind in ('Code', 'Test') when 'docs' then f.kind = 'Docs' when 'config' then f.kind = 'Config' else true end and (q.path_filter is null or contains(f.path, q.path_filter)))"
_LEX = f"with {FILES}, {CHUNKS}, {_Q}, {_QT}, " + _bm25("chunk_id", "chunk_postings", "chunks", "lex")
_CHANNEL = f", adm as (select l.query_id, l.doc, l.score from lex l join chunks c on c.chunk_id = l.doc join files f on f.file_id = c.file_id join q on q.query_id = l.query_id where {_ADMIT} and l.score > 0), ch as (select query_id, doc, row_number() over (partition by query_id order by score desc, doc) as rank from adm qualify rank <= 100)"
_STORED = ", ".join(f"{c} as (select query_id, chunk_id as doc, max(score) as score from search_hits where channel = '{c}' and score is not null and not isnan(score) group by all), {c}_r as (select query_id, doc, row_number() over (partition by query_id order by score desc, doc) as rank from {c} where score > 0 qualify rank <= 100)" for c in ("lexical", "dense", "file"))
_IDENT = r"""ident as (select distinct query_id, unnest(list_concat(list_transform(list_filter(long, lambda x: len(long) = 1 or contains(x, '_') or regexp_matches(x, '^.\P{Lu}*\p{Lu}')), lambda x: lower(x)),
  list_transform(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: regexp_replace(x, '^[.#%]+|[,:;{]+$', '', 'g')), lambda x: contains(x, '-') and regexp_full_match(x, '[\p{L}\p{N}_$-]+')), lambda x: lower(x)))) as word
  from (select *, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 3) as long from q)),
  decl as (select distinct i.query_id, n.chunk_id from (select chunk_id, lower(x.name) as word from (select chunk_id, unnest(names) as x from chunks)) n join ident i on i.word = n.word)"""
_BOOST = (
    _LEX + _CHANNEL + ", " + _IDENT + f""", base as (select coalesce(ch.query_id, d.query_id) as query_id, coalesce(ch.doc, d.chunk_id) as chunk_id, round(1.0 / (60 + ch.rank), 12) as fused, d.chunk_id is not null as declares from ch full outer join decl d on d.query_id = ch.query_id and d.chunk_id = ch.doc),
  hits as (select b.query_id, b.chunk_id, c.file_id, b.declares, coalesce(l.coverage, 0) as coverage,
    round((coalesce(fused, 0) + case when declares then 2.0 / 61 else 0 end) * case when f.kind = 'Test' then 0.6 else 1 end * case when not declares and regexp_matches(f.path, '\\.(h|hpp|hh|hxx)$') then 0.8 else 1 end * case when not declares and c.imports then 0.5 else 1 end, 12) as score
    from base b join chunks c on c.chunk_id = b.chunk_id join files f on f.file_id = c.file_id join q on q.query_id = b.query_id left join lex l on l.query_id = b.query_id and l.doc = b.chunk_id where {_ADMIT})"""
)
_DECAY = ", late as (select query_id, chunk_id, coverage, declares, round(score * pow(0.85, row_number() over (partition by query_id, file_id order by score desc, chunk_id) - 1), 12) as score from hits where score > 0)"
SQL = {
    "bm25_batch": _LEX + " select query_id, doc as chunk_id, round(score, 6) as score, round(coverage, 6) as coverage from lex",
    "bm25_channel": _LEX + _CHANNEL + " select query_id, doc as chunk_id, cast(rank as integer) as rank from ch",
    "file_channel": f"with {FILES}, {_Q}, {_QT}, " + _bm25("file_id", "file_postings", "files", "lex") + " select query_id, doc as file_id, cast(row_number() over (partition by query_id order by score desc, doc) as integer) as rank from lex where score > 0 qualify rank <= 100",
    "rrf_fusion": f"with {_STORED}, u as (select query_id, doc, 1.0 / (60 + rank) as p from lexical_r union all select query_id, doc, 1.0 / (60 + rank) from dense_r union all select query_id, doc, 0.5 / (60 + rank) from file_r) select query_id, doc as chunk_id, round(sum(p), 9) as fused from u group by all",
    "name_match": f"with {CHUNKS}, {_Q}, {_IDENT} select query_id, chunk_id from decl",
    "heading_match": f"""with {FILES}, {CHUNKS}, {_Q}, h as (select chunk_id, file_id, name, {_W.format('name')} as words from (select c.chunk_id, c.file_id, x.name as name from (select chunk_id, file_id, unnest(names) as x from chunks) c join files f on f.file_id = c.file_id where f.kind = 'Docs') where name is not null),
      a as (select query_id, {_W.format('text')} as asked from q),
      m as (select query_id, chunk_id, file_id, name from a, h where len(words) > 0 and len(asked) > 0 and list_has_any(words, asked) and (
        (len(asked) = 1 and asked[1] = words[1] and regexp_matches(asked[1], '\\p{{N}}')) or ((len(words) >= 2 or length(words[1]) >= 5) and ((list_has_all(asked, words) and 2 * len(words) > len(asked)) or (list_has_all(words, asked) and 2 * len(asked) >= len(words)))))),
      s as (select query_id, name from m group by all having count(distinct file_id) < 4)
      select distinct m.query_id, m.chunk_id, m.name from m join s on s.query_id = m.query_id and s.name = m.name""",
    "name_boost": _BOOST + " select query_id, chunk_id, round(score, 9) as score, declares from hits where score > 0",
    "same_file_decay": _BOOST + _DECAY + " select query_id, chunk_id, round(score, 9) as score from late",
    "present_policy": _BOOST + _DECAY + """, top as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from late qualify rank <= 8),
      x as (select *, bool_or(rank = 1 and declares) over w and coalesce(max(case when rank = 2 then score end) over w / max(case when rank = 1 then score end) over w, 0) < 0.75 as leads, max(case when rank <= 3 then coverage end) over w as best, bool_or(rank = 1 and declares) over w as fd,
        sum(case when declares and rank > 1 then 1 else 0 end) over (partition by query_id order by rank) as company from top window w as (partition by query_id))
      select query_id, cast(rank as integer) as rank, chunk_id, case when leads then case when rank = 1 then 'Declaration' else 'Skim' end when rank <= 3 then case when best >= 0.5 or fd then 'Snippet' else 'Skim' end when coverage + 1.2e-7 >= 0.6 * best then 'Skim' else 'Heading' end as detail,
        leads or best >= 0.5 or fd as confident from x where not leads or rank = 1 or (declares and company <= 3)""",
    "recall_mrr": f"with {_STORED}, want as (select query_id, doc from dense qualify row_number() over (partition by query_id order by score desc, doc) = 1), g as (select w.query_id, r.rank from want w left join lexical_r r on r.query_id = w.query_id and r.doc = w.doc) select count(*) as probes, "
    + ", ".join(f"round(avg(case when rank <= {k} then 1 else 0 end), 9) as recall_{k}" for k in (1, 3, 5, 10, 20)) + ", round(avg(coalesce(1.0 / rank, 0)), 9) as mrr from g",
}
