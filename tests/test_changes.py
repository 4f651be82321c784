import datetime as dt
import os
import random

import pytest

from siftwell.operators.changes import ChangeCapture

WALKS = "walk_id long, root_id long, checkout_id long, started_at timestamp, finished_at timestamp, status string, path string"
RECORDS = "record_id long, walk_id long, checkout_id long, path string, hash string, stamp struct<mtime_s long, mtime_ns int, bytes long>, seen_at timestamp, change string"
T0 = dt.datetime(2026, 1, 1)


def walk(i, checkout=1, status="done", at=None):
    return i, 1, checkout, T0 + dt.timedelta(days=i if at is None else at), None, status, "clash"


def record(i, w, path, hash_, stamp=(1, 1, 1), seen=0):
    return i, w, 1, path, hash_, stamp, T0 + dt.timedelta(seconds=seen) if seen is not None else None, "clash"


def expected(walks, records):
    """Plain Python version of the definition."""
    out = set()
    for checkout in {w[2] for w in walks}:
        done = sorted((w for w in walks if w[2] == checkout and w[5] == "done"), key=lambda w: (w[3], w[0]))
        sides = []
        for w in done:
            one = {}
            for r in records:
                if r[1] == w[0]:
                    p = r[3].replace("\\", "/").removeprefix("./") if r[3] is not None else None
                    key = (r[6] or dt.datetime.min, r[0])
                    if p not in one or key > one[p][0]:
                        one[p] = (key, r)
            sides.append({p: r for p, (_, r) in one.items()})
        for then, now in zip(sides, sides[1:]):
            for p, r in now.items():
                o = then.get(p)
                if o is None:
                    out.add(r[0])
                elif r[4] is not None and o[4] is not None:
                    out |= {r[0]} if r[4] != o[4] else set()
                elif None not in r[5][:2] and None not in o[5][:2]:
                    out |= {r[0]} if r[5] != o[5] else set()
                else:
                    out.add(r[0])
    return out


@pytest.fixture
def log(spark, tmp_path):
    def make(walks, records, name="state"):
        frames = spark.createDataFrame(walks, WALKS), spark.createDataFrame(records, RECORDS)
        return ChangeCapture(spark, f"file://{tmp_path}/{name}"), *frames

    return make


def ids(capture):
    rows = [r.record_id for r in capture.result().collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_log(seed, n=300):
    rng = random.Random(seed)
    walks = [walk(i, rng.choice([1, 1, 2]), rng.choice(["done", "done", "failed", None]), rng.choice([i, 20 - i])) for i in range(1, 9)]
    walks.append(walks[0])
    stamp = lambda: (rng.choice([None, 1, 2]), rng.choice([1, 1, None]), rng.choice([1, 2, None]))
    path = lambda: rng.choice(["a", "./a", "d\\b", "d/b", "./c", "c", "é ü/x", None])
    records = [record(i, rng.randint(1, 9), path(), rng.choice(["h1", "h2", None]), stamp(), rng.choice([None, 0, 1, 1, 99999])) for i in range(n)]
    return walks, records


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(log, seed):
    walks, records = some_log(seed)
    capture, w, r = log(walks, records)
    assert capture.run(w, r) == [1]
    assert ids(capture) == expected(walks, records)
    assert capture.run(w, r) == []


def test_runs_continue_replay_and_take_late_rows(log, spark):
    walks, records = some_log(5)
    capture, w, r = log(walks[:5], [x for x in records if x[0] % 3])
    batch = capture.plan(spark.createDataFrame(walks[:5], WALKS), r)
    capture.process(batch, r)  # a run that dies before its commit
    assert ids(capture) == set()
    assert capture.run(w, r) == [1]
    assert ids(capture) == expected(walks[:5], [x for x in records if x[0] % 3])
    all_w, all_r = spark.createDataFrame(walks, WALKS), spark.createDataFrame(records, RECORDS)
    assert capture.run(all_w, all_r) == [2]
    assert ids(capture) == expected(walks, records)


def test_only_new_walks_are_planned(log, spark):
    walks = [walk(1), walk(2), walk(3)]
    records = [record(i * 10 + w, w, f"p{i}", f"h{i}{w if i == 1 else ''}") for i in range(3) for w in (1, 2, 3)]
    capture, w, r = log(walks[:2], [x for x in records if x[1] < 3])
    capture.run(w, r)
    capture.run(spark.createDataFrame(walks, WALKS), spark.createDataFrame(records, RECORDS))
    second = spark.read.parquet(capture.folder.path("plans", "batch=2"))
    assert [x.walk_id for x in second.collect()] == [3]
    assert ids(capture) == {12, 13}


def test_a_run_reads_only_the_new_walk_and_the_one_before(spark, tmp_path):
    """One file per walk; files of walks that no longer matter are spoilt."""
    walks, path = [walk(i) for i in range(1, 6)], f"{tmp_path}/log with space"
    records = [record(10 * w + i, w, f"p{i}", f"h{i}{w if i == 1 else ''}") for w in range(1, 6) for i in range(3)]
    capture = ChangeCapture(spark, f"file://{tmp_path}/state")

    def store(n):
        spark.createDataFrame([x for x in records if x[1] == n], RECORDS).coalesce(1).write.mode("append").parquet(path)
        return spark.read.schema(RECORDS).parquet(path)

    store(1)
    log_, at = store(2), lambda n: spark.createDataFrame(walks[:n], WALKS)
    assert capture.run(at(2), log_) == [1] and ids(capture) == {21}
    first = [f for f in os.listdir(path) if f.endswith(".parquet") and spark.read.parquet(f"{path}/{f}").first().walk_id == 1]
    log_ = store(3)
    with open(f"{path}/{first[0]}", "wb") as f:
        f.write(b"spoilt")
    assert capture.run(at(3), log_) == [2] and ids(capture) == {21, 31}
    late = [record(90, 3, "p9", "h9")]  # changes walk 3 and what follows it
    records += late
    spark.createDataFrame(late, RECORDS).coalesce(1).write.mode("append").parquet(path)
    assert capture.run(at(4), store(4)) == [3] and ids(capture) == {21, 31, 90, 41}
    before = sorted(map(tuple, capture.result().collect()))
    capture.compact()
    capture.sweep()
    assert sorted(map(tuple, capture.result().collect())) == before and capture.folder.names("sink") == list(capture.manifest.live())
    assert capture.run(at(4), spark.read.schema(RECORDS).parquet(path)) == []
    assert capture.run(at(5), store(5)) == [4] and ids(capture) == {21, 31, 90, 41, 51}


def test_many_batches_are_merged(log, spark, monkeypatch):
    monkeypatch.setattr("siftwell.operators.changes.MAX_SEGMENTS", 2)
    walks, records = some_log(6)
    records = [(*x[:1], 1 + k % 8, *x[2:]) for k, x in enumerate(records)]
    capture, w, r = log(walks[:1], records)
    for n in range(1, 4):
        capture.run(spark.createDataFrame([walk(i) for i in range(1, n + 2)], WALKS), r)
    assert len(capture.manifest.live()) <= 2
    capture.compact()
    assert len(capture.manifest.live()) == 1 and ids(capture) == expected([walk(i) for i in range(1, 5)], records)


def test_empty_tables(log):
    capture, w, r = log([], [])
    assert capture.run(w, r) == [] and ids(capture) == set()
    capture, w, r = log([walk(1), walk(2)], [], "other")
    capture.run(w, r)
    assert ids(capture) == set()
