"""Queries p1, p3 to p8 and their oracle SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import artefacts, bpe, distinctive, leximin, mixing, splitting, subjects
from siftwell.session import materialise
from siftwell.sources import table

CHANNELS = ("lexical", "dense", "file")
SCORES = (*CHANNELS, "coverage", "declares")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits", "query_id", "chunk_id", "channel", "score", "coverage", "declares")
    return hits.select("query_id", "chunk_id", *[F.when(F.col("channel") == c, F.col("score")).alias(c) for c in CHANNELS], "coverage", "declares")


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ``top_n`` chunks of each query, with rank and percentiles."""
    sizes = table(spark, sf_dir, "search_queries", "query_id", "top_n")
    return leximin.leximin_top(_hits(spark, sf_dir), sizes, "query_id", "chunk_id", SCORES, "top_n")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_ranking(spark, sf_dir).select("query_id", "chunk_id")


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artefacts.artefacts(table(spark, sf_dir, "code_files", "file_id", "path", "kind"), table(spark, sf_dir, "documents", "file_id", "text", "kind"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_reasons(spark, sf_dir).select("file_id")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = distinctive.term_counts(table(spark, sf_dir, "chunk_postings"), "postings", "chunk_id")
    files = distinctive.term_counts(table(spark, sf_dir, "file_postings"), "file_postings", "file_id")
    names = distinctive.name_counts(table(spark, sf_dir, "code_chunks"), "names", "chunk_id")
    return chunks.unionByName(files).unionByName(names)


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best terms of the probed records, with rank."""
    probes = table(spark, sf_dir, "term_probes", "field", "record_id", "n_terms")
    scored = distinctive.distinctiveness(_counts(spark, sf_dir), probes.select("field", F.col("record_id").alias("record")))
    return distinctive.top_terms(scored, probes)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_terms(spark, sf_dir).select("field", "record_id", "term")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized chunks."""
    return splitting.split_oversized(
        table(spark, sf_dir, "code_chunks", "chunk_id", "file_id", "start_line", "end_line"), table(spark, sf_dir, "code_files", "file_id", "kind"),
        table(spark, sf_dir, "documents", "doc_id", "file_id", "text"), table(spark, sf_dir, "chunk_limits"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.block_cuts(p5_pieces(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents", "doc_id", "text"), "text")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(bpe.count_tokens(table(spark, sf_dir, "documents", "doc_id", "source", "text"), "text"), "sized")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    docs, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    mix = materialise(mixing.fair_queue(docs, targets), "mix")
    return mixing.mix_report(docs, targets, mix)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn copies themselves."""
    return mixing.fair_queue(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_report(spark, sf_dir).where("short").select("source")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = subjects.subject_areas(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "subject_labels"))
    return areas.select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per subject, and their code points: the corpus by subject."""
    docs = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    return p8_found(spark, sf_dir).join(docs, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


QUERIES = {f.__name__: f for f in (p1_found, p1_ranking, p3_found, p3_reasons, p4_found, p4_terms, p5_found, p5_pieces, p6_ids, p7_found, p7_report, p7_mix, p8_found, p8_composition)}

_RANKED = """
with one as (
  select query_id, chunk_id,
    max(case when channel = 'lexical' and not isnan(score) then score end) as lexical, max(case when channel = 'dense' and not isnan(score) then score end) as dense,
    max(case when channel = 'file' and not isnan(score) then score end) as file, max(case when not isnan(coverage) then coverage end) as coverage, max(cast(declares as double)) as declares
  from search_hits group by query_id, chunk_id),
filled as (
  select query_id, chunk_id, coalesce(lexical, min(lexical) over w, 0) as lexical, coalesce(dense, min(dense) over w, 0) as dense, coalesce(file, min(file) over w, 0) as file,
    coalesce(coverage, min(coverage) over w, 0) as coverage, coalesce(declares, min(declares) over w, 0) as declares
  from one window w as (partition by query_id)),
shares as (
  select query_id, chunk_id, list_sort([cume_dist() over (partition by query_id order by lexical), cume_dist() over (partition by query_id order by dense), cume_dist() over (partition by query_id order by file),
    cume_dist() over (partition by query_id order by coverage), cume_dist() over (partition by query_id order by declares)]) as v
  from filled),
sizes as (select query_id, max(top_n) as top_n from search_queries group by query_id),
ranked as (select query_id, chunk_id, v, row_number() over (partition by query_id order by v desc, chunk_id) as rank from shares)
"""
_SCORED = """
with counts as (
  select 'postings' as field, chunk_id as record, term, max(weight) as k from chunk_postings where weight > 0 and term is not null and chunk_id is not null group by all
  union all select 'file_postings', file_id, term, max(weight) from file_postings where weight > 0 and term is not null and file_id is not null group by all
  union all select 'names', chunk_id, name, count(*) from (select distinct chunk_id, n.name as name, n.line as line from (select chunk_id, unnest(names) as n from code_chunks)) where name is not null and chunk_id is not null group by all),
totals as (select field, term, sum(k) as total from counts group by all),
grand as (select field, sum(total) as alls from totals group by all),
probes as (select field, record_id, max(n_terms) as n_terms from term_probes group by all),
own as (select c.*, sum(k) over (partition by c.field, c.record) as n from counts c semi join probes p on p.field = c.field and p.record_id = c.record),
tail as (
  select o.field, o.record, o.term, o.k, t.total,
    round(-ln(list_sum(list_transform(generate_series(cast(o.k as bigint), cast(least(o.n, t.total) as bigint)),
      lambda i: exp(lgamma(t.total + 1.0) - lgamma(i + 1.0) - lgamma(t.total - i + 1.0) + lgamma(g.alls - t.total + 1.0) - lgamma(o.n - i + 1.0) - lgamma(g.alls - t.total - o.n + i + 1.0) - lgamma(g.alls + 1.0) + lgamma(o.n + 1.0) + lgamma(g.alls - o.n + 1.0))))), 6) as raw
  from own o join totals t on t.field = o.field and t.term = o.term join grand g on g.field = o.field),
ranked as (
  select t.field, t.record as record_id, t.term, p.n_terms, row_number() over (partition by t.field, t.record order by t.raw desc, t.k desc, t.term) as rank
  from tail t join probes p on p.field = t.field and p.record_id = t.record where t.total > 1 or t.field = 'names')
"""
SQL = {
    "p1_found": _RANKED + "select r.query_id, r.chunk_id from ranked r join sizes s on s.query_id = r.query_id where r.rank <= s.top_n",
    "p1_ranking": _RANKED + "select r.query_id, r.chunk_id, cast(r.rank as integer) as rank, r.v as vector from ranked r join sizes s on s.query_id = r.query_id where r.rank <= s.top_n",
    "p4_found": _SCORED + "select field, record_id, term from ranked where rank <= n_terms",
    "p4_terms": _SCORED + "select field, record_id, term, cast(rank as integer) as rank from ranked where rank <= n_terms",
}
