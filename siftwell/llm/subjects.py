"""Subject areas of documents, by label propagation over a graph of similar
documents.

Equal texts are one node; their documents are members of it. Every node has a
signature: the words that mark it most against all texts. Two nodes are as similar
as the cosine of their signatures, and every node hears all others that share a
word with it, in proportion to that. These pairs are not listed, since they grow with
the square of the texts: the cosine is a sum over words, so for each word the parts of
all nodes that it marks are summed, and a node adds up the sums of its words and takes
off its own share. That is exact, whatever the size of a word's group. Of a cosine,
only words verified to say a subject count for it: those around which, among all nodes
they mark, it is frequent. Hand labels are the seeds. Labels travel until they no
longer change, a node keeping as many subjects as reach it. Seeds are clamped as long
as the graph supports them. What reached a node is then checked against its own words:
a subject counts only if a good part of the text's words, those that the labels of all
nodes verify, dwell on it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import materialise, spread

# Letters only; camel case is cut before an upper-case letter.
_WORDS = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-zа-яёßà-öø-ÿ])(?=[A-ZА-ЯЁÀ-ÖØ-Þ])")
# Words of a signature, the largest share of texts that may have a word of a
# signature, the least similarity of a listed pair.
SIGNATURE, COMMON, LEAST_SIMILARITY = 24, 0.5, 0.1
# A word passes on a subject that is so many times as frequent around it as overall
# (of frequent subjects: a third of the way from that to all), and comes from so many nodes, if labelled nodes are at least this much as frequent
# around it as elsewhere: a single wrong seed labels no group of texts without seeds.
LEAST_LIFT, LEAST_NODES, LEAST_COVER = 3.0, 2, 0.25
# A subject reaches a node with so much of what its words pass on; labels have settled
# when no more than this share of them changes; rounds at most.
LEAST_REACH, SETTLED, ROUNDS = 0.05, 0.005, 8
# A word must occur in so many labelled documents, raise a subject's odds so many
# times, and lie so many standard deviations above chance.
LEAST_DOCS, LEAST_ODDS, LEAST_Z = 3, 2.5, 2.5
LEAST_SHARE, LEAST_DENSITY, LEAST_TOKENS = 0.25, 0.06, 2.0
BROADCAST_WORDS = 200_000


def words(text: str) -> list[str]:
    """Lower-case words of a text; identifiers fall apart at ``_`` and camel case."""
    return _WORDS.findall(_CAMEL.sub(" ", text).lower())


def _lists(column: pa.ListArray) -> tuple[list[int], list, list]:
    """(offsets, first fields, second fields) of a column of lists of pairs."""
    return column.offsets.to_pylist(), column.values.field(0).to_pylist(), column.values.field(1).to_pylist()


def _pairs(rows: list[list[tuple]], names: tuple[str, str], kinds: tuple[pa.DataType, pa.DataType]) -> pa.ListArray:
    """A column of lists of pairs."""
    flat = list(chain.from_iterable(rows))
    fields = [pa.array([t[i] for t in flat], type=k) for i, k in enumerate(kinds)]
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=list(names)))


def document_words(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, words array<struct<w, c>>): a key of each text, and its
    words with their counts, one row per document, without a shuffle. Null texts
    have neither key nor words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(words(t)) if t else Counter() for t in batch.column("text").to_pylist()]
            found = _pairs([list(x.items()) for x in counts], ("w", "c"), (pa.string(), pa.int32()))
            total = pa.array([sum(x.values()) for x in counts], type=pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), total, found], names=["doc_id", "text_key", "n", "words"])

    own = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", F.unhex(F.sha1("text")).alias("text_key"), "text")
    return own.mapInArrow(run, "doc_id long, text_key binary, n int, words array<struct<w string, c int>>")


def _word_subjects(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(w, subject, weight): what each verified word says, from documents
    ``labels`` (doc_id, parts array<struct<subject, part>>), parts adding up to 1.
    A word counts once per document: k documents of the subject among the n that
    have the word, against the subject's share of all labelled documents. Arrays
    here have at most one entry per subject."""
    whole = labels.select(F.explode("parts").alias("p")).groupBy("p.subject").agg(F.count(F.lit(1)).alias("s"), F.sum("p.part").alias("d"))
    priors = whole.agg(F.sum("d").alias("all"), F.map_from_entries(F.collect_list(F.struct("subject", "s"))).alias("sizes"))  # one row
    known = held.join(labels, "doc_id").select("parts", F.explode("words").alias("x")).select(F.col("x.w").alias("w"), F.explode("parts").alias("p"))
    pairs = known.groupBy("w", "p.subject").agg(F.count(F.lit(1)).alias("k"), F.sum("p.part").alias("d"))
    by_word = pairs.groupBy("w").agg(F.sum("d").alias("n"), F.collect_list(F.struct("subject", "k")).alias("x")).where(F.col("n") >= LEAST_DOCS - 0.5).crossJoin(F.broadcast(priors))

    def verified(s):
        prior = F.least(F.element_at(F.col("sizes"), s["subject"]) / F.col("all"), F.lit(1.0))
        expected = F.col("n") * prior
        odds = s["k"] * (1 - prior) >= LEAST_ODDS * (F.col("n") - s["k"]) * prior
        return odds & (s["k"] - expected > LEAST_Z * F.sqrt(expected * (1 - prior)))

    good = by_word.select("w", F.filter("x", verified).alias("x")).where(F.size("x") > 0)
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, s: a + s["k"])
    return good.select("w", total.alias("t"), F.explode("x").alias("s")).select("w", "s.subject", (F.col("s.k") / F.col("t")).alias("weight"))


def _document_subjects(held: DataFrame, lexicon: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, parts array<struct<subject, part>>) of the documents that dwell
    on a subject, ``part`` being its share of the subject words."""
    if n_words <= BROADCAST_WORDS:
        lexicon = F.broadcast(lexicon)
    tokens = held.select("doc_id", "n", F.explode("words").alias("x")).select("doc_id", "n", F.col("x.w").alias("w"), F.col("x.c").alias("c"))
    mass = tokens.join(lexicon, "w").groupBy("doc_id", "n", "subject").agg(F.sum(F.col("c") * F.col("weight")).alias("mass"))
    found = mass.groupBy("doc_id", "n").agg(F.sum("mass").alias("all"), F.collect_list(F.struct("subject", "mass")).alias("x"))
    found = found.where((F.col("all") >= LEAST_DENSITY * F.col("n")) & (F.col("all") >= LEAST_TOKENS))
    parts = F.filter(F.transform("x", lambda s: F.struct(s["subject"].alias("subject"), F.round(s["mass"] / F.col("all"), 9).alias("part"))), lambda s: s["part"] >= LEAST_SHARE)
    return found.select("doc_id", parts.alias("parts")).where(F.size("parts") > 0)


def _rare(held: DataFrame) -> DataFrame:
    """(w, idf) of the words that may mark a text: not of a single text, nor of more
    than ``COMMON`` of the texts."""
    found = held.select(F.explode("words.w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    whole = held.agg(F.count(F.lit(1)).alias("texts"))  # one row
    rare = found.crossJoin(F.broadcast(whole)).where(F.col("df") <= COMMON * F.col("texts"))
    return rare.select("w", F.round(F.log(F.col("texts") / F.col("df")), 6).alias("idf"))


def _signed(marks: list[tuple[float, str]]) -> list[tuple[str, float]]:
    """The first ``SIGNATURE`` of (negative weight, word), heaviest first, with length 1."""
    marks.sort()
    norm = math.sqrt(sum(x * x for x, _ in marks[:SIGNATURE]))
    return [(w, round(-x / norm, 6)) for x, w in marks[:SIGNATURE]]


def signatures(held: DataFrame) -> DataFrame:
    """(doc_id, sig array<struct<w, x>>): the ``SIGNATURE`` words that mark each text
    most, by frequency and rarity, weights of length 1. The words that may do so are
    counted; up to ``BROADCAST_WORDS`` they go to every task, and texts stay where
    they lie; beyond that they are joined by shuffle."""
    rare = materialise(_rare(held), "rare")
    if rare.count() <= BROADCAST_WORDS:
        idf = held.sparkSession.sparkContext.broadcast({r.w: r.idf for r in rare.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = idf.value
            for batch in batches:
                at, w, c = _lists(batch.column("words"))
                marks = [(-round((1 + math.log(n)) * idf_, 6), x) if (idf_ := known.get(x)) else None for x, n in zip(w, c)]
                sigs = [_signed([m for m in marks[a:b] if m]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _pairs(sigs, ("w", "x"), (pa.string(), pa.float64()))], names=["doc_id", "sig"])

        return held.select("doc_id", "words").mapInArrow(run, "doc_id long, sig array<struct<w string, x double>>")
    tokens = held.select("doc_id", F.explode("words").alias("t")).select("doc_id", F.col("t.w").alias("w"), F.col("t.c").alias("c"))
    weighed = tokens.join(rare, "w").select("doc_id", F.struct((-F.round((1 + F.log("c")) * F.col("idf"), 6)).alias("x"), "w").alias("s")).where("s.x < 0")
    top = weighed.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list("s")), 1, SIGNATURE).alias("s"))  # the words of one text
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, t: a + t["x"] * t["x"]))
    return top.select("doc_id", F.transform("s", lambda t: F.struct(t["w"].alias("w"), F.round(-t["x"] / norm, 6).alias("x"))).alias("sig"))


def _tokens(sigs: DataFrame) -> DataFrame:
    """(doc_id, w, x) of signatures."""
    return sigs.select("doc_id", F.explode("sig").alias("t")).select("doc_id", F.col("t.w").alias("w"), F.col("t.x").alias("x"))


def similar(sigs: DataFrame) -> DataFrame:
    """(doc_id, near array<struct<other, cos>>): each node's partners, all whose
    signature has a cosine of ``LEAST_SIMILARITY`` or more with its own. It shows the
    graph; its rows grow with the square of the texts, so :func:`propagated` sums
    over all partners without forming them."""
    tokens = _tokens(sigs)
    others = tokens.select(F.col("doc_id").alias("other"), "w", F.col("x").alias("y"))
    pairs = tokens.join(others, "w").where("doc_id <> other").groupBy("doc_id", "other").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("cos"))
    return pairs.where(F.col("cos") >= LEAST_SIMILARITY).groupBy("doc_id").agg(F.collect_list(F.struct("other", "cos")).alias("near"))


def _shares(rows: DataFrame, key: str, least: float) -> DataFrame:
    """(key, parts array<struct<subject, part>>) of (key, subject, x): the shares of the
    sum, those below ``least`` left out and the others adding up to 1. At most one
    entry per subject."""
    one = rows.groupBy(key).agg(F.sum("x").alias("all"), F.collect_list(F.struct("subject", "x")).alias("s"))
    kept = one.select(key, F.filter(F.transform("s", lambda t: F.struct(t["subject"].alias("subject"), (t["x"] / F.col("all")).alias("part"))), lambda t: t["part"] >= least).alias("s")).where(F.size("s") > 0)
    total = F.aggregate("s", F.lit(0.0), lambda a, t: a + t["part"])
    return kept.select(key, F.transform("s", lambda t: F.struct(t["subject"].alias("subject"), F.round(t["part"] / total, 9).alias("part"))).alias("parts"))


def _passed(sums: DataFrame, whole: DataFrame, overall: DataFrame) -> DataFrame:
    """(w, subject, said): the subjects that each word is verified to pass on, judged
    by all nodes that it marks. ``sums`` (w, subject, said, nodes), ``whole`` (w,
    whole), the same over all nodes, ``overall`` (subject, d)."""
    known = sums.groupBy("w").agg(F.sum("said").alias("known"))
    cover = known.agg(F.sum("known").alias("k")).crossJoin(F.broadcast(whole.agg(F.sum("whole").alias("a")))).select((F.col("k") / F.col("a")).alias("cover"))  # one row
    prior = overall.crossJoin(F.broadcast(overall.agg(F.sum("d").alias("all")))).select("subject", (F.col("d") / F.col("all")).alias("prior"))  # one row per subject
    held = sums.join(known.join(whole, "w"), "w").join(F.broadcast(prior), "subject").crossJoin(F.broadcast(cover))
    heard = (F.col("nodes") >= LEAST_NODES) & (F.col("known") >= LEAST_COVER * F.col("cover") * F.col("whole"))
    return held.where(heard & (F.col("said") >= F.least(LEAST_LIFT * F.col("prior"), (1 + 2 * F.col("prior")) / 3) * F.col("known"))).select("w", "subject", "said")


def _sums(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(w, subject, said, nodes): the weights that a word has in the signatures of all
    nodes of a subject, and how many these are."""
    known = nodes.join(labels, "doc_id").select("sig", F.explode("parts").alias("p")).select("p", F.explode("sig").alias("t"))
    return known.groupBy(F.col("t.w").alias("w"), F.col("p.subject").alias("subject")).agg(F.sum(F.col("t.x") * F.col("p.part")).alias("said"), F.count(F.lit(1)).alias("nodes"))


def _heard(nodes: DataFrame, labels: DataFrame, passed: DataFrame) -> DataFrame:
    """(doc_id, subject, x): the sum, over all other nodes, of their part of the subject
    times the cosine, of which the words that pass on the subject count. It is formed
    word by word, each word standing for all nodes that it marks; what the node
    itself gave to these sums is taken off."""
    met = _tokens(nodes).join(passed, "w").groupBy("doc_id", "subject").agg(F.sum(F.col("x") * F.col("said")).alias("x"), F.sum(F.col("x") * F.col("x")).alias("own"))
    parts = labels.select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.subject", "p.part")
    others = F.round(F.col("x") - F.col("own") * F.coalesce("part", F.lit(0.0)), 6)
    return met.join(parts, ["doc_id", "subject"], "left").select("doc_id", "subject", others.alias("x")).where("x > 0")


def _by_joins(nodes: DataFrame, whole: DataFrame, rounds: int) -> DataFrame:
    """:func:`propagated` by shuffles, for any number of words and subjects."""
    clamped = F.transform("marked", lambda s: F.struct(s.alias("subject"), (1 / F.size("marked")).cast("double").alias("part")))
    seeds = nodes.where("marked is not null").select("doc_id", "marked")
    labels, before = seeds.select("doc_id", clamped.alias("parts")), None
    for _ in range(rounds):
        overall = labels.select(F.explode("parts").alias("p")).groupBy("p.subject").agg(F.sum("p.part").alias("d"))
        passed = _passed(materialise(_sums(nodes, labels), "sums"), whole, overall)
        reached = _shares(_heard(nodes, labels, passed), "doc_id", LEAST_REACH)
        both = reached.join(seeds, "doc_id", "full_outer")
        trusted = F.col("marked").isNotNull() & (F.col("parts").isNull() | F.arrays_overlap("marked", F.col("parts")["subject"]))
        labels = materialise(both.select("doc_id", F.when(trusted, clamped).otherwise(F.col("parts")).alias("parts")), "labels")
        said = labels.select(F.xxhash64("doc_id", F.array_sort(F.col("parts")["subject"])).alias("h"))
        if before is not None:
            same = said.join(before, "h", "left_semi").count()
            if said.count() - same <= SETTLED * max(1, same):
                break
        before = said
    return labels


def _labelled(batch: pa.RecordBatch, vocabulary: pa.Array, subjects: list[str], tables: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of a batch of nodes (doc_id, sig, marked), by the words' sums of all rounds: the
    node, word and weight of each entry of a signature, and the nodes' parts by
    subject after the last round and the one before."""
    sig, marked, n = batch.column("sig"), batch.column("marked"), batch.num_rows
    node = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(sig), 0).to_numpy(zero_copy_only=False))
    flat = sig.flatten()
    word, x = pc.index_in(flat.field(0), value_set=vocabulary).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(marked), 0).to_numpy(zero_copy_only=False)
    seeds = np.zeros((n, len(subjects)))
    seeds[np.repeat(np.arange(n), sizes), pc.index_in(marked.flatten(), value_set=pa.array(subjects, pa.string())).to_numpy(zero_copy_only=False)] = 1.0
    seeds /= np.maximum(sizes, 1)[:, None]
    parts = before = seeds
    for said in tables:
        before, heard = parts, np.zeros_like(seeds)
        for s in range(len(subjects)):
            of_word = said[word, s]
            heard[:, s] = np.bincount(node, x * of_word, n) - parts[:, s] * np.bincount(node, x * x * (of_word > 0), n)
        heard = np.maximum(np.round(heard, 6), 0)
        for least in (LEAST_REACH, 0):
            heard /= np.maximum(heard.sum(1, keepdims=True), 1e-9)
            heard[heard < least] = 0
        trusted = (sizes > 0) & ((heard.sum(1) == 0) | ((heard > 0) & (seeds > 0)).any(1))
        parts = np.where(trusted[:, None], seeds, np.round(heard, 9))
    return node, word, x, parts, before


def _within_tasks(nodes: DataFrame, whole: DataFrame, subjects: list[str], rounds: int) -> DataFrame:
    """:func:`propagated` where the nodes lie, for words and subjects counted few: a
    round only moves the words' sums, from which tasks know all labels again."""
    sc, vocabulary, tables = nodes.sparkSession.sparkContext, sorted(r.w for r in whole.toLocalIterator()), []
    at, of = {w: i for i, w in enumerate(vocabulary)}, {s: i for i, s in enumerate(subjects)}
    kinds = "w string, subject string, said double, nodes long"

    def summed(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, subjects, tables = shared.value
            words_, said = pa.array(vocabulary, pa.string()), np.zeros((len(vocabulary), len(subjects)))
            count, overall, now, same = np.zeros_like(said, dtype=np.int64), np.zeros(len(subjects)), 0, 0
            for batch in batches:
                node, word, x, parts, before = _labelled(batch, words_, subjects, tables)
                for s in range(len(subjects)):
                    part = parts[node, s]
                    said[:, s] += np.bincount(word, x * part, len(vocabulary))
                    count[:, s] += np.bincount(word[part > 0], minlength=len(vocabulary))
                overall += parts.sum(0)
                any_ = (parts > 0).any(1)
                now, same = now + int(any_.sum()), same + int((any_ & ((parts > 0) == (before > 0)).all(1)).sum())
            w, s = np.nonzero(count)
            rows = [*zip([vocabulary[i] for i in w], [subjects[i] for i in s], said[w, s].tolist(), count[w, s].tolist()), *zip([None] * len(subjects), subjects, overall.tolist(), [0] * len(subjects)), (None, None, float(now), same)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.float64(), pa.int64()))], names=["w", "subject", "said", "nodes"])

        return nodes.mapInArrow(run, kinds).groupBy("w", "subject").agg(F.sum("said").alias("said"), F.sum("nodes").alias("nodes"))

    def final(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, subjects, tables = shared.value
            words_ = pa.array(vocabulary, pa.string())
            for batch in batches:
                parts = _labelled(batch, words_, subjects, tables)[3]
                rows = [[(subjects[s], p[s]) for s in np.flatnonzero(p)] for p in parts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _pairs(rows, ("subject", "part"), (pa.string(), pa.float64()))], names=["doc_id", "parts"])

        return nodes.mapInArrow(run, "doc_id long, parts array<struct<subject string, part double>>").where(F.size("parts") > 0)

    for k in range(rounds + 1):
        shared = sc.broadcast((vocabulary, subjects, tables))
        if k == rounds:
            break
        found = materialise(summed(shared), "sums")
        settled = found.where("subject is null").first()
        if k > 1 and settled and settled.said - settled.nodes <= SETTLED * max(1, settled.nodes):
            break
        passed = _passed(found.where("w is not null"), whole, found.where("w is null and subject is not null").select("subject", F.col("said").alias("d")).where("d > 0"))
        table = np.zeros((len(vocabulary), len(subjects)))
        for r in passed.toLocalIterator():
            table[at[r.w], of[r.subject]] = r.said
        tables = [*tables, table]
    return materialise(final(shared), "labels")


def propagated(sigs: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, parts): labels of all nodes that any reach, once they have settled.
    ``seeds`` (doc_id, marked array<string>) are clamped, but for those that share no
    subject with what their partners pass on; without partners they stay. Words times
    subjects are counted; up to ``BROADCAST_WORDS`` nodes stay where they lie."""
    nodes = materialise(sigs.join(seeds, "doc_id", "full_outer"), "marked")
    whole = materialise(_tokens(sigs).groupBy("w").agg(F.sum("x").alias("whole")), "whole")
    subjects = seeds.select(F.explode("marked").alias("subject")).distinct()
    if max(1, whole.count()) * subjects.count() <= BROADCAST_WORDS:
        return _within_tasks(nodes, whole, sorted(r.subject for r in subjects.collect()), max(1, rounds))
    return _by_joins(nodes, whole, max(1, rounds))


def subject_areas(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, subject, share): the areas that a good part of a text dwells on.

    ``docs`` (doc_id, text), ``labels`` (doc_id, subject). An area counts if labels
    reach the text over the graph, and it holds ``LEAST_SHARE`` of the text's
    subject words and these together ``LEAST_DENSITY`` of all its words; so a text
    has none, one or a few. A text whose label by hand the graph supports has
    no other areas. Repeated label rows count once; null labels, and
    labels of unknown documents, not at all. Null, empty and blank texts have no
    area. Of repeated ``doc_id`` rows each is judged and the areas are united.
    Without labels, or with a single subject, nothing can be told apart and there
    are no rows.

    The table of verified words is counted and broadcast only up to
    ``BROADCAST_WORDS`` entries; beyond that it is joined by shuffle.
    """
    every = materialise(document_words(docs.where("doc_id is not null and text is not null")), "words")
    rows = every.select("doc_id", "text_key")
    copies = rows.groupBy("text_key").agg(F.min("doc_id").alias("first"))
    several = rows.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select(F.col("doc_id").alias("first"), F.lit(True).alias("several"))
    node = F.when(F.col("several"), F.xxhash64("text_key")).otherwise(F.col("first"))  # an id with several texts can't stand for one
    nodes = materialise(copies.join(several, "first", "left").select("text_key", "first", node.alias("node")), "node-ids")
    members = materialise(rows.distinct().join(nodes.select("text_key", "node"), "text_key").select(F.col("doc_id").alias("member"), F.col("node").alias("doc_id")), "members")
    held = every.join(nodes.withColumnRenamed("first", "doc_id"), ["doc_id", "text_key"]).select(F.col("node").alias("doc_id"), "n", "words")
    held = held.dropDuplicates(["doc_id"]) if every.count() > members.count() else held
    held = materialise(held, "nodes")
    marks = labels.where("doc_id is not null and subject is not null").select(F.col("doc_id").cast("long").alias("member"), "subject").join(members, "member")
    seeds = materialise(marks.groupBy("doc_id").agg(F.collect_set("subject").alias("marked")), "seeds")  # the subjects of one text
    sigs = materialise(signatures(held), "signatures")
    reached = propagated(sigs, seeds, rounds)
    lexicon = materialise(_word_subjects(held, reached), "lexicon")
    dwelt = _document_subjects(held, lexicon, lexicon.count()).select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.subject", F.col("p.part").alias("share"))
    over_graph = reached.select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.subject")
    found = dwelt.join(over_graph, ["doc_id", "subject"])
    return found.join(members, "doc_id").groupBy(F.col("member").alias("doc_id"), "subject").agg(F.max("share").alias("share"))
