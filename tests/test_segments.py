"""Manifests, the live table and the index store: crashes, replays, refreshes."""

import pytest
from pyspark.sql import functions as F

from siftwell.operators import segments
from siftwell.operators.manifest import Folder, Manifest
from siftwell.operators.segments import IndexStore, chunk_weights, file_weights
from siftwell.streaming.upkeep import STATE, LiveTable, overflows

TREE = "path string, kind string, indexed boolean, stamp struct<mtime_s long, mtime_ns int, bytes long>, hash string, text string"


def tree(spark, files, now=100):
    return spark.createDataFrame([(p, "Code", t is not None, (m, 0, len(t or "")), f"h{t}", t) for p, (t, m) in files.items()], TREE)


def fn(name, lines=12):
    return f"def {name}():\n" + "    x += 1\n" * lines + "\n"


class Crash(Exception):
    pass


def crashing_at(monkeypatch, n):
    """Lets the ``n``-th change to the folder fail."""
    left = [n]
    for name in ("move", "drop", "write_text", "mark"):
        real = getattr(Folder, name)

        def step(self, *a, _real=real):
            left[0] -= 1
            if left[0] == 0:
                raise Crash
            return _real(self, *a)

        monkeypatch.setattr(Folder, name, step)


def test_manifest_survives_a_torn_file(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m.live() == {}
    m.replace({"a": {}})
    m.replace({"a": {}, "b": {"last": 1}})
    m.folder.write_text('{"format": 1, "segm', "manifests", 3)
    assert list(m.live()) == ["a", "b"]
    m.folder.write_text('{"format": 99, "segments": {}}', "manifests", 4)
    m.folder.write_text("x", "segments", "stray", "f")
    assert list(m.live()) == ["a", "b"] and m.sweep() == 1


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), STATE)


def test_a_replay_after_compaction_loses_nothing(spark, tmp_path, rows):
    live = LiveTable(spark, f"file://{tmp_path}/live")
    first, second = rows_of(spark, ("a", 1, "h", False), ("b", 2, "h", False)), rows_of(spark, ("c", 3, "h", False), ("b", 4, None, True))
    live._upsert(first, 0)
    live._upsert(second, 1)
    assert live.compact() and not live.compact() and live.sweep() == 2
    live._upsert(second, 1)
    assert [r[0] for r in rows(live.read())] == ["a", "c"]
    live._upsert(rows_of(spark, ("b", 3, "late", False)), 2)
    assert [r[0] for r in rows(live.read())] == ["a", "c"]  # the deletion was kept
    assert live.repair(spark.createDataFrame([("a", "h"), ("d", "h")], "path string, hash string"), 9) == 2
    assert [r[0] for r in rows(live.read())] == ["a", "d"]


@pytest.mark.parametrize("step", (1, 2, 3, 5))
def test_a_crash_at_any_step_loses_nothing(spark, tmp_path, rows, monkeypatch, step):
    live = LiveTable(spark, f"file://{tmp_path}/live")
    live._upsert(rows_of(spark, ("a", 1, "h", False)), 0)
    live._upsert(rows_of(spark, ("b", 2, "h", False)), 1)
    with monkeypatch.context() as m:
        crashing_at(m, step)
        try:
            live.compact()
            live.sweep()
            live._upsert(rows_of(spark, ("c", 3, "h", False)), 2)
        except Crash:
            pass
    assert [r[0] for r in rows(live.read())][:2] == ["a", "b"]
    live._upsert(rows_of(spark, ("c", 3, "h", False)), 2)
    live.compact()
    assert [r[0] for r in rows(live.read())] == ["a", "b", "c"]


def test_overflow(spark):
    few = rows_of(spark, ("a", 1, "h", False))
    assert not overflows(few) and overflows(few, 0) and overflows(rows_of(spark, ("x/.gitignore", 1, None, False))) and overflows(rows_of(spark, (".", 1, None, False)))


def contents(store, rows):
    return rows(store.files().select("path", "hash")), rows(store.chunks()), rows(store.postings())


def test_incremental_equals_rebuilt(spark, tmp_path, rows):
    states = [
        {"src/a.py": (fn("one") + fn("two"), 1), "src/b.py": (fn("three"), 1), "c.py": (None, 1)},
        {"src/a.py": (fn("one") + fn("four"), 2), "src/b.py": (fn("three"), 1), "d.py": ("", 2)},
        {"src/a.py": (fn("one") + fn("four"), 2), "d.py": (fn("five"), 3)},
    ]
    store = IndexStore(spark, f"file://{tmp_path}/kept")
    store.build(tree(spark, states[0]), 100, batches=2)
    assert store.build(tree(spark, states[0]), 100, batches=2) == 0
    for i, files in enumerate(states):
        store.refresh(tree(spark, files), 100 + i)
        assert not store.refresh(tree(spark, files), 100 + i)
        again = IndexStore(spark, f"file://{tmp_path}/new{i}")
        again.append(tree(spark, files), 100)
        assert contents(store, rows) == contents(again, rows)
    before = contents(store, rows)
    assert len(store.manifest.live()) == 4 and store.shares().first().dead_share > 0.25
    assert store.compact() and len(store.manifest.live()) == 1 and store.manifest.sweep() == 4
    assert contents(store, rows) == before and store.shares().first().dead_share == 0


def test_racy_edits_and_gone_files(spark, tmp_path, rows):
    store = IndexStore(spark, f"file://{tmp_path}/s")
    old = tree(spark, {"a.py": ("x = 1", 99), "b.py": ("y = 1", 50)})
    store.append(old, 100)
    same_stamp = tree(spark, {"a.py": ("x = 2", 99), "b.py": ("y = 2", 50)})
    assert rows(store.changes(same_stamp)) == [("a.py", "racy")]
    assert store.refresh(same_stamp, 100) and rows(store.files().select("path", "hash")) == [("a.py", "hx = 2"), ("b.py", "hy = 1")]
    assert rows(store.changes(old.limit(0))) == [("a.py", "gone"), ("b.py", "gone")]
    other = IndexStore(spark, f"file://{tmp_path}/o")
    asked = spark.createDataFrame([("a.py", "hx = 2", "Code"), ("a.py", "hx = 1", "Code"), ("z.py", "hy = 1", "Code"), ("b.py", "hy = 1", "Test"), ("b.py", None, "Code")], "path string, hash string, kind string")
    assert rows(other.borrow(asked, store)) == [("a.py", "hx = 2")]


def test_a_path_counts_once_per_file(spark, tmp_path, rows):
    store = IndexStore(spark, f"file://{tmp_path}/s")
    store.append(tree(spark, {"cart/total.py": (fn("open_cart") + fn("shut_total"), 1)}), 100)
    p = store.postings()
    assert store.chunks().count() == 2
    total = lambda d: {tuple(r)[:-1]: r["weight"] for r in d.where(F.col("term") == "total").collect()}
    assert total(chunk_weights(p)) == {("cart/total.py", 0, "total"): 2, ("cart/total.py", 1, "total"): 1 + 3 + 2}
    assert total(file_weights(p)) == {("cart/total.py", "total"): 6}
    assert store.vectors() is None
    (name,) = store.manifest.live()
    v = store.chunks().select("path", "ord", F.array(F.lit(1.0)).alias("vector"))
    with pytest.raises(ValueError):
        store.attach_vectors(name, v.limit(1))
    store.attach_vectors(name, v)
    assert store.vectors().count() == 2


def test_nothing_to_index(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/s")
    assert store.files().count() == 0 and store.chunks().count() == 0 and not store.compact() and not store.refresh(tree(spark, {"a.py": ("x", 1)}).limit(0), 1)
    store.append(tree(spark, {"a.py": (None, 1), "b.py": ("", 1), "c.py": ("x" * 300_000, 1)}), 10)
    assert store.files().count() == 3 and store.chunks().count() == 1
    assert segments.chunk_bodies(spark.createDataFrame([(None, "x")], "path string, text string")).count() == 0
