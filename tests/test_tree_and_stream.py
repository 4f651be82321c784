import os

from siftwell.sources import tree
from siftwell.streaming.upkeep import LiveTable


def fill(root, files):
    for path, body in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(body)


def test_walk(spark, tmp_path):
    fill(tmp_path, {"pkg/__init__.py": b"", "_x/a.py": b"a\r\n", ".hidden/a.py": b"a", "node_modules/a.js": b"a", "src/a.min.js": b"a", "src/big.py": b"x" * (1 << 20), "src/over.py": b"x" * ((1 << 20) + 1), "src/bad.py": b"\xff\xfe", "src/skip/b.py": b"b", "src/keep.log.py": b"c", "top.md": b"# T\n", ".gitignore": b"skip/\n*.log.py\n!keep.log.py\n"})
    tree.register(spark)
    df = spark.read.format("tree").option("path", str(tmp_path)).load()
    got = {r.path: r for r in df.collect()}
    assert sorted(got) == ["_x/a.py", "pkg/__init__.py", "src/bad.py", "src/big.py", "src/keep.log.py", "top.md"]
    assert not got["src/bad.py"].indexed and got["src/bad.py"].text is None and not got["src/big.py"].indexed
    assert got["_x/a.py"].text == "a\r\n" and got["_x/a.py"].stamp.bytes == 3 and len(got["top.md"].hash) == 32
    some = spark.read.format("tree").option("path", str(tmp_path)).option("paths", '["src/bad.py", "_x"]').load()
    assert sorted(r.path for r in some.collect()) == ["_x/a.py", "src/bad.py"]
    assert tree.holds_more_than(spark, str(tmp_path), 5) and not tree.holds_more_than(spark, str(tmp_path), 6)


def test_stream_upserts_and_compacts(spark, tmp_path):
    schema = "path string, seq long, hash string, gone boolean"
    live = LiveTable(spark, f"file://{tmp_path}/live")
    assert live.read().count() == 0
    steps = [[("a", 1, "h1", False), ("b", 2, "h2", None), ("a", 3, "h3", False)], [("b", 4, None, True), ("c", 5, "h5", False)], [("a", 6, "h6", False), (None, 7, "x", False)]]
    for i, step in enumerate(steps):
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).awaitTermination(60)
        assert len(live.segments()) == i + 1
    want = {("a", 6, "h6"), ("c", 5, "h5")}
    assert {tuple(r) for r in live.read().collect()} == want
    live.compact()
    assert len(live.segments()) == 1 and {tuple(r) for r in live.read().collect()} == want
