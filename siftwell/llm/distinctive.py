"""How distinctive a term is per record, by hypergeometric enrichment.

With N occurrences in a field, K of them of the term, and n in the record, the
chance of k or more of the term in the record is the upper tail of the
hypergeometric distribution. Its negative natural logarithm, adjusted for the
false discovery rate over all scored terms of the field, is the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.ordered import join_counted, running, top_per_group
from siftwell.session import materialise


def _correction(x: np.ndarray) -> np.ndarray:
    """Of Stirling's series for ln x! at x > 0, beyond (x + 1/2) ln x - x + ln(2 pi)/2."""
    x = np.maximum(x, 1.0)
    x2 = x * x
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x2)) / x2) / x2) / x


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series after shifting x to 16 or more."""
    x = np.asarray(x, dtype=float)
    steps = np.maximum(0, 16 - np.floor(x)).astype(int)
    product = np.zeros_like(x)
    for i in range(16):
        product += np.where(i < steps, np.log(x + np.minimum(i, steps)), 0.0)
    y = x + steps
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + _correction(y) - product


def log_falling(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """ln of x (x-1) ... (x-m+1) for 0 <= m <= x, without the loss of digits that
    subtracting two log-gammas of a large x brings."""
    x, m = np.asarray(x, dtype=float), np.asarray(m, dtype=float)
    rest = np.maximum(x - m, 0.0)
    small = rest < 64
    with np.errstate(divide="ignore", invalid="ignore"):
        far = m * np.log(np.maximum(x, 1)) - (rest + 0.5) * np.log1p(np.where(small, 0.0, -m / np.maximum(x, 1))) - m + _correction(x) - _correction(rest)
    return np.where(small, log_gamma(x + 1) - log_gamma(rest + 1), far)


def log_upper_tail(k: np.ndarray, n: np.ndarray, K: np.ndarray, N: np.ndarray) -> np.ndarray:  # noqa: N803
    """ln P(X >= k) for k of n drawn from N with K marked: exact, vectorised.

    The tail is summed from the log-gamma form of its first term by the ratio of
    neighbouring terms; where k lies below the mean, the lower tail is summed and
    subtracted instead. Impossible inputs (k > n, k > K) give -inf.
    """
    k, n, K, N = (np.asarray(v, dtype=float) for v in (k, n, K, N))  # noqa: N806
    out = np.zeros_like(k)
    out[(k > n) | (k > K)] = -np.inf
    up = (k > 0) & (k <= n) & (k <= K) & (k > n * K / np.maximum(N, 1))
    down = (k > 0) & (k <= n) & (k <= K) & ~up

    def log_pmf(x, n, K, N):  # noqa: N803
        return log_falling(n, x) - log_gamma(x + 1) + log_falling(K, x) + log_falling(N - K, n - x) - log_falling(N, n)

    for rows, step in ((up, 1), (down, -1)):
        if not rows.any():
            continue
        a, n_, k_, m_ = k[rows] - (step < 0), n[rows], K[rows], N[rows]
        least = np.maximum(0.0, n_ + k_ - m_)
        start = np.where(a >= least, log_pmf(np.maximum(a, least), n_, k_, m_), -np.inf)
        total, term, x = np.ones_like(a), np.ones_like(a), a.copy()
        live = np.isfinite(start)
        while live.any():
            i = np.flatnonzero(live)
            with np.errstate(divide="ignore", invalid="ignore"):
                if step > 0:
                    ratio = (k_[i] - x[i]) * (n_[i] - x[i]) / ((x[i] + 1) * (m_[i] - k_[i] - n_[i] + x[i] + 1))
                else:
                    ratio = x[i] * (m_[i] - k_[i] - n_[i] + x[i]) / ((k_[i] - x[i] + 1) * (n_[i] - x[i] + 1))
            term[i] *= np.maximum(np.nan_to_num(ratio), 0.0)
            total[i] += term[i]
            x[i] += step
            live[i] = term[i] > total[i] * 1e-17
        log_sum = start + np.log(total)
        out[rows] = log_sum if step > 0 else np.log1p(-np.minimum(np.exp(log_sum), 1 - 1e-16))
    return np.minimum(out, 0.0)


def term_counts(postings: DataFrame, field: str, record: str, weight: str | None = "weight") -> DataFrame:
    """(field, record, term, k): a field's distinct term counts per record.

    Repeated rows count once (the largest weight, should they differ). Rows with
    a null, zero or negative weight, a null term or a null record are void.
    """
    k = F.col(weight) if weight else F.lit(1)
    rows = postings.select(F.col(record).cast("long").alias("record"), "term", k.cast("long").alias("k"))
    rows = rows.where(F.col("record").isNotNull() & F.col("term").isNotNull() & (F.col("k") > 0))
    return rows.groupBy("record", "term").agg(F.max("k").alias("k")).select(F.lit(field).alias("field"), "record", "term", "k")


def name_counts(chunks: DataFrame, field: str, record: str) -> DataFrame:
    """As :func:`term_counts`, of the names in ``names``, as written. A name
    counts once per line; null lists, entries and names are passed over."""
    names = chunks.select(F.col(record).alias("record"), F.explode("names").alias("x")).select("record", F.col("x.name").alias("term"), F.col("x.line").alias("line"))
    counts = names.where(F.col("term").isNotNull()).distinct().groupBy("record", "term").agg(F.count(F.lit(1)).alias("k"))
    return counts.where(F.col("record").isNotNull()).select(F.lit(field).alias("field"), F.col("record").cast("long").alias("record"), "term", "k")


def distinctiveness(counts: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(field, record, term, k, total, raw, score) of the terms of ``records``.

    ``counts`` (field, record, term, k) covers the whole collection, and every
    total is taken over it; ``records`` (field, record) narrows only what is
    scored. ``raw`` is -ln P(X >= k), ``score`` the same after the adjustment of
    Benjamini and Hochberg over all scored rows of the field: ln m - ln rank is
    taken off, and kept monotone. Both are rounded to 9 digits. An empty table
    gives no rows. Counts, totals and raw scores are written once, since several
    stages read them; terms that very many records hold are joined apart.
    """
    counts = materialise(counts, "counts")
    totals = materialise(counts.groupBy("field", "term").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("held")), "totals")
    grand = totals.groupBy("field").agg(F.sum("total").alias("all"))
    if records is None:
        own = counts
    else:
        r = records.select("field", F.col("record").cast("long").alias("record")).distinct()
        own = materialise(counts.join(r, ["field", "record"], "left_semi"), "own")
    sizes = own.groupBy("field", "record").agg(F.sum("k").alias("n"))
    named = join_counted(own, totals, ["field", "term"], "held", counts.count())
    rows = named.join(sizes, ["field", "record"]).join(grand, "field")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = -log_upper_tail(pdf["k"].to_numpy(), pdf["n"].to_numpy(), pdf["total"].to_numpy(), pdf["all"].to_numpy())
            yield pdf[["field", "record", "term", "k", "total"]].assign(raw=np.round(raw, 9) + 0.0)

    scored = materialise(rows.mapInPandas(score, "field string, record long, term string, k long, total long, raw double").withColumn("one", F.lit(1).cast("long")), "scored")
    order = [F.col("record"), F.col("term")]
    ranked = running(scored, ["field"], [F.desc("raw"), *order], "one", "place")
    tests = ranked.groupBy("field").agg(F.count(F.lit(1)).alias("m"))
    adjusted = ranked.join(tests, "field").withColumn("adjusted", F.col("raw") - F.log("m") + F.log("place"))
    kept = running(adjusted, ["field"], [F.asc("raw"), *[o.desc() for o in order]], "adjusted", "score", how="max")
    return kept.select("field", "record", "term", "k", "total", "raw", F.round(F.greatest("score", F.lit(0.0)), 9).alias("score"))


def top_terms(scored: DataFrame, probes: DataFrame, named: tuple[str, ...] = ("names",)) -> DataFrame:
    """(field, record_id, term, rank): each probe's ``n_terms`` best terms.

    A term that occurs once in the whole collection says nothing unless its
    field is one of ``named``. Order: score, raw score, count, then term.
    Repeated probes count once, with the largest ``n_terms``.
    """
    wanted = probes.groupBy("field", F.col("record_id").cast("long").alias("record")).agg(F.max("n_terms").alias("_n")).where(F.col("_n") > 0)
    most = wanted.agg(F.max("_n")).first()[0] or 0
    fit = scored.where((F.col("total") > 1) | F.col("field").isin(*named)).join(wanted, ["field", "record"])
    top = top_per_group(fit, ["field", "record"], [F.desc("score"), F.desc("raw"), F.desc("k"), F.asc("term")], "_n", most)
    return top.select("field", F.col("record").alias("record_id"), "term", "rank")
