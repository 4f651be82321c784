import math
import random
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from siftwell.llm import distinctive as D
from siftwell.llm.leximin import leximin_top

HITS = "q long, c long, a double, b double, flag boolean, g string, k long, v double, rank long, n int"
SIZES = "q long, n int, rank int"


def plain(rows, sizes):
    """Brute force from the definition."""
    items = {}
    for q, c, *s in rows:
        best = items.setdefault((q, c), [None] * 3)
        for i, x in enumerate(s[:3]):
            x = None if x is None or x != x else float(x)
            best[i] = x if best[i] is None else best[i] if x is None else max(best[i], x)
    out = set()
    for q, n in sizes:
        group = {c: v for (qq, c), v in items.items() if qq == q}
        vectors = {}
        for c, v in group.items():
            p = []
            for i in range(3):
                known = [x[i] for x in group.values() if x[i] is not None]
                low = min(known, default=0.0)
                full = [low if x[i] is None else x[i] for x in group.values()]
                mine = low if v[i] is None else v[i]
                p.append(sum(x <= mine for x in full) / len(full))
            vectors[c] = sorted(p)
        order = sorted(group, key=lambda c: ([-x for x in vectors[c]], c))
        out |= {(q, c) for c in order[: n or 0]}
    return out


@pytest.mark.parametrize("hot", [1, 300, 10**6])
def test_leximin_equals_brute_force_with_a_hot_group(spark, monkeypatch, hot):
    monkeypatch.setattr("siftwell.llm.leximin.HOT_ROWS", hot)
    rng = random.Random(5)
    value = lambda: rng.choice([None, math.nan, 1e9, -5.0, rng.random(), rng.random()])
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(120), value(), value(), rng.choice([None, True, False])) for _ in range(900)]
    rows += rows[:200]
    sizes = [(1, 9), (2, 4), (3, None), (7, 5)]
    rows += [(None, c, 0.5, None, None) for c in range(3)]
    df = spark.createDataFrame([(*r, "x", 1, 1.0, 1, 1) for r in rows], HITS)
    got = {(r.q, r.c) for r in leximin_top(df, spark.createDataFrame([(*s, 0) for s in sizes], SIZES), "q", "c", ["a", "b", "flag"], "n").collect()}
    assert got == plain(rows, sizes)


def test_leximin_does_not_mask_a_weak_score_and_handles_nothing(spark):
    df = spark.createDataFrame([(1, 1, 9.0, 1.0, True), (1, 2, 5.0, 5.0, True), (1, 3, 1.0, 9.0, True), (1, 4, None, None, None)], "q long, c long, a double, b double, flag boolean")
    sizes = spark.createDataFrame([(1, 1), (1, 2)], "q long, n int")
    assert [r.c for r in leximin_top(df, sizes, "q", "c", ["a", "b", "flag"], "n").orderBy("rank").collect()] == [2, 1]
    assert leximin_top(df.limit(0), sizes, "q", "c", ["a", "b", "flag"], "n").count() == 0
    assert leximin_top(df, sizes.limit(0), "q", "c", ["a", "b", "flag"], "n").count() == 0


def exact(k, n, K, N):
    return float(sum(Fraction(comb(K, i) * comb(N - K, n - i), comb(N, n)) for i in range(k, min(n, K) + 1)))


def test_upper_tail_is_exact():
    rng = random.Random(1)
    cases = []
    for _ in range(400):
        N = rng.choice([5, 30, 400, 5000])
        K, n = rng.randint(1, N), rng.randint(1, min(N, 60))
        cases.append((rng.randint(max(0, n + K - N), min(n, K)), n, K, N))
    got = D.log_upper_tail(*map(np.array, zip(*cases)))
    want = np.array([math.log(exact(*c)) for c in cases])
    assert np.allclose(got, want, rtol=1e-9, atol=1e-11)


def test_log_gamma_and_large_collections():
    x = np.array([0.5, 1, 2, 3.7, 20, 1e6, 1e12])
    assert np.allclose(D.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)
    k, n, K, N = 3, 40, 5, 10**15
    want = sum(math.log(a) for a in (comb(K, k), comb(n, k), math.factorial(k))) + math.log(1) - k * math.log(N)
    assert abs(D.log_upper_tail([k], [n], [K], [N])[0] - want) < 1e-6
    assert D.log_upper_tail([3], [2], [5], [10])[0] == -np.inf and D.log_upper_tail([0], [2], [5], [10])[0] == 0


POST = "term string, chunk_id long, file_id long, weight int, field string, k int, total int"


def test_terms_of_probes(spark):
    rows = [(f"w{i % 7}", c, 1, 1 + i % 2, "f", 9, 9) for c in range(40) for i in range(5)]
    rows += [("mark", 3, 1, 9, "f", 9, 9)] * 3 + [("mark", 5, 1, 1, "f", 9, 9), ("solo", 3, 1, 1, "f", 9, 9), ("void", 3, 1, 0, "f", 9, 9), ("nil", 3, 1, None, "f", 9, 9), (None, 3, 1, 5, "f", 9, 9), ("x", None, 1, 5, "f", 9, 9)]
    counts = D.term_counts(spark.createDataFrame(rows, POST), "postings", "chunk_id")
    chunks = spark.createDataFrame([(3, [("Open", 1), ("open", 2), (None, 3)]), (3, [("Open", 1), ("open", 2), (None, 3)]), (4, None), (5, []), (6, [("open", 1), None])], "chunk_id long, names array<struct<name string, line int>>")
    both = counts.unionByName(D.name_counts(chunks, "names", "chunk_id"))
    probes = spark.createDataFrame([("postings", 3, 1), ("postings", 3, 2), ("names", 3, 1), ("names", 99, 1), ("postings", 5, 0)], "field string, record_id long, n_terms int")
    scored = D.distinctiveness(both, probes.withColumnRenamed("record_id", "record"))
    top = {(r.field, r.record_id, r.rank): r.term for r in D.top_terms(scored, probes).collect()}
    assert top[("postings", 3, 1)] == "mark" and top[("names", 3, 1)] == "Open" and len(top) == 3
    assert "solo" not in top.values()
    one = scored.where("term = 'mark' and record = 3").first()
    n = counts.where("record = 3").agg({"k": "sum"}).first()[0]
    N = counts.agg({"k": "sum"}).first()[0]
    assert abs(one.raw + math.log(exact(9, n, 10, N))) < 1e-6 and one.score <= one.raw


def test_adjustment_is_benjamini_hochberg(spark):
    rng = random.Random(2)
    counts = spark.createDataFrame([("f", r, f"t{rng.randrange(30)}-{i % 5}", rng.randint(1, 9)) for r in range(30) for i in range(12)], "field string, record long, term string, k long").groupBy("field", "record", "term").agg({"k": "max"}).withColumnRenamed("max(k)", "k")
    rows = D.distinctiveness(counts).collect()
    p = sorted((math.exp(-r.raw), r.record, r.term) for r in rows)
    adjusted, best = {}, 1.0
    for i in range(len(p), 0, -1):
        best = min(best, p[i - 1][0] * len(p) / i)
        adjusted[p[i - 1][1:]] = best
    assert all(abs(r.score + math.log(adjusted[(r.record, r.term)])) < 1e-6 for r in rows)


def test_no_terms(spark):
    empty = spark.createDataFrame([], "field string, record long, term string, k long")
    assert D.distinctiveness(empty).count() == 0
    assert D.term_counts(spark.createDataFrame([], POST), "f", "chunk_id").count() == 0
