"""Trees asked through the tools, roots, access, stores, requests."""

import json
import os

import pytest
from pyspark.sql import functions as F

from siftwell.__main__ import evaluated
from siftwell.front import answers, roots
from siftwell.front.corpus import Corpus
from siftwell.front.settings import Settings, prune, standing
from siftwell.front.tools import Engine, answer, serve
from siftwell.operators import extent, outline, usages
from siftwell.operators.manifest import Folder, Manifest
from siftwell.operators.rank import documented

CART = """// a cart
export class Cart {
  items = [];

  /** adds one */
  put(item) {
    this.items.push(item);
    track("cart.put");
  }
}

export function openCart(name) {
  // openCart is mentioned here only
  return new Cart(name);
}
"""
FILES = {
    "src/cart/cart.ts": CART,
    "src/cart/shelf.ts": 'import { openCart } from "./cart";\n\nexport const useShelf = () => {\n' + "".join(f"  openCart({i});\n" for i in range(12)) + "};\n",
    "src/main.ts": 'import { openCart } from "./cart/cart";\nopenCart("a");\nimport { Q } from "cart.put";\n',
    "tests/cart.test.ts": "openCart(1);\n" * 3,
    "docs/guide.md": "# Opening carts\n\nCall openCart first.\n\n```\n# not a heading\n```\n\n## Packing rules\n\nPack it.\n",
    "theme/vars.css": ":root {\n" + "".join(f"  --gap-{i}: {i}px;\n" for i in range(7)) + "}\n.card__top {\n}\n",
    "settings.json": '{"openCart": 1}\n',
    "node_modules/x/cart.ts": CART,
}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for path, body in FILES.items():
        os.makedirs((root / path).parent, exist_ok=True)
        (root / path).write_text(body)
    return Corpus(spark, str(root), f"file://{tmp_path_factory.mktemp('stores')}/shop", now=10**9)


def test_search(shop):
    out = answers.search(shop, "openCart")
    assert out.startswith("src/cart/cart.ts:12-15\n") and "   12| export function openCart(name) {" in out and "across 5 files" in out and "node_modules" not in out
    page = answers.search(shop, "packing rules")
    assert page.startswith("A document has a section by that name:") and "docs/guide.md:9-11" in page and "# not" not in page
    assert "No matches under `docs/`" in answers.search(shop, "useShelf", path="docs/")
    assert "Nothing in the code is named `zebraHouse`" in answers.search(shop, "zebraHouse") or "No matches" in answers.search(shop, "zebraHouse")


def test_usages(shop):
    out = answers.usages_of(shop, "openCart", limit=12)
    assert out.startswith("`openCart`: 1 declaration, 19 other lines in 5 files\n") and "src/cart/cart.ts:12  export function openCart(name) {" in out
    assert "     5  [useShelf] openCart(1);" in out and "also lines 11, 12, 13, 14, 15" in out and "also lines 2, 3" in out and "Not shown (pass `path` to see): docs/guide.md (1)" in out
    assert "settings.json" not in out and "mentioned" not in out
    quoted = answers.usages_of(shop, "cart.put")
    assert "Found as text" in quoted and "src/main.ts" in quoted
    assert answers.usages_of(shop, "Cart::openCart").startswith("`Cart::openCart` read as the identifier `openCart`.")
    assert answers.usages_of(shop, "openCart", path="theme").startswith("Nothing for `openCart` under `theme`, but 20 lines in 5 files elsewhere: src/cart/shelf.ts, src/cart/cart.ts, src/main.ts, ...") or "elsewhere" in answers.usages_of(shop, "openCart", path="theme")
    assert "has `nowhere` in its path" in answers.usages_of(shop, "openCart", path="nowhere")
    assert answers.usages_of(shop, "zebra").startswith("No whole-word occurrences of `zebra`") and answers.usages_of(shop, "no such text here").startswith("No occurrences of")
    assert answers.usages_of(shop, " ") == "`symbol` is empty."


def test_grep(shop):
    out = answers.grep(shop, r"open[A-Z]\w+\(\d")
    assert "`/open[A-Z]\\w+\\(\\d/`: 15 lines in 2 files" in out and "also lines" in out
    assert "not a regular expression" in answers.grep(shop, "(") and "look-around" in answers.grep(shop, "(?=x)") and answers.grep(shop, "zzz").startswith("No line matches")


def test_outline(shop):
    out = answers.outline_of(shop, "src/cart/cart.ts")
    assert out == "src/cart/cart.ts  (15 lines)\n     2  export class Cart\n     6    put(item)\n    12  export function openCart(name)\n"
    assert answers.outline_of(shop, "cart.ts").startswith("src/cart/cart.ts") and "matches 3 files" in answers.outline_of(shop, "cart")
    assert "--gap-0 ... 7 variables, to line 8" in answers.outline_of(shop, "theme/vars.css")
    top = answers.outline_of(shop)
    assert top.startswith("./  (1 files here, 4 directories)\n  docs/  (1 files)\n") and "settings.json  (1 lines)" in top
    assert "  cart.ts  (15 lines)  Cart, put, openCart" in answers.outline_of(shop, "./src/cart/")
    near = answers.outline_of(shop, "src/cart/carts.ts")
    assert "Closest names:\n  src/cart/cart.ts" in near and "`src/cart` exists and holds 2 files" in near


def test_index_follows_the_tree(spark, shop, tmp_path):
    segments = len(shop.store.manifest.live())
    again = Corpus(spark, shop.root, shop.store.manifest.folder.root, now=10**9)
    assert len(again.store.manifest.live()) <= segments + 1 and again.files.count() == shop.files.count() == 7
    empty = Corpus(spark, str(tmp_path), f"file://{tmp_path}/store")
    for said in (answers.search(empty, "x"), answers.usages_of(empty, "x"), answers.grep(empty, "x"), answers.outline_of(empty)):
        assert said.startswith("Nothing is indexed")


def test_probes(shop, tmp_path):
    (tmp_path / "p.tsv").write_text("openCart\tsrc/cart/cart.ts\topenCart(name)\n\nuseShelf\tshelf.ts\nlonely\nzebra\tnowhere.ts\tx\n")
    out = evaluated(shop, f"file://{tmp_path}/p.tsv", 5)
    assert "file  3 probes  R@1 0.667" in out and "span  2 probes  R@1 0.500" in out


def test_documented_asks_pages_only_where_code_declares_nothing(spark, rows):
    q = spark.createDataFrame([(1, "a", "code", None), (2, "b", "code", None), (3, "c", "all", None), (4, "d", "code", None)], "query_id long, text string, content string, path_filter string")
    hits = {"code": [(1, 1, True), (2, 1, False), (4, 1, False)], "all": [(3, 1, False)], "docs": [(2, 1, True), (4, 1, False)]}

    def search(asked):
        found = [(qid, c, k, d) for c, hs in hits.items() for qid, k, d in hs]
        return spark.createDataFrame(found, "query_id long, c string, rank int, declares boolean").join(asked.select("query_id", F.col("content").alias("c")), ["query_id", "c"])

    assert rows(documented(q, search).select("query_id", "c", "from_page")) == [(1, "code", False), (2, "docs", True), (3, "all", False), (4, "code", False)]


@pytest.mark.parametrize("asked,kind,said", [("open", "word", "open"), ("Session::open", "word", "open"), ("a->b", "word", "b"), ("App\\Cart", "word", "Cart"), ("$x", "word", "x"), ("/api/users", "text", "/api/users"), ("a b", "text", "a b"), ("..", "text", ".."), ("a:b", "text", "a:b"), ("été.x", "word", "x"), (".card-top", "text", ".card-top")])
def test_needles(asked, kind, said):
    n = usages.needle(asked)
    assert (n.kind, n.said) == (kind, said)


def test_pruning_words():
    assert usages.pruning_words(usages.needle("a::open_cart")) == "open_cart" and usages.pruning_words(usages.needle("is not a cart")) == "not a" and usages.pruning_words(usages.needle("not one")) is None


def test_extents(spark, rows):
    rust = ["use x;", "/// opens", "#[inline]", "fn open(", "    a: u8,", ") {", "    go();", "}", "", "fn shut() {}"]
    assert extent.declaration_extent(rust, 4) == (2, 8) and extent.declaration_extent(rust, 10) == (10, 10)
    c = ["int x;", "typedef struct {", "  int a;", "", "} cart_t;"]
    assert extent.declaration_extent(c, 5) == (2, 5)
    py = ["class A:", "    # about b", "    def b(self):", "        x = 1", "", "        return x", "    def c(self):", "        pass"]
    assert extent.declaration_extent(py, 3) == (2, 6) and extent.declaration_extent(py, 1) == (1, 8) and extent.declaration_extent(["end"], 1) == (1, 1)
    texts = spark.createDataFrame([(1, "\n".join(py)), (2, None)], "k int, text string")
    at = spark.createDataFrame([(1, 3), (1, 3), (1, 99), (2, 1), (1, None)], "k int, line int")
    assert rows(extent.declaration_extents(texts, at, "k")) == [(1, 3, 2, 6)]
    page = "# A\nx\n## B\n```\n# no\n```\ny\n\n# C\n"
    assert rows(extent.section_extents(spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, text string"), "k")) == [(1, 1, "A", 7), (1, 3, "B", 7), (1, 9, "C", 9)]


def test_rule_blocks(spark, rows):
    declared = spark.createDataFrame([(1, i, n) for i, n in enumerate(["--a", "$b", "card", "card__x", "card--y", "menu_z", "card"], 1)] + [(2, 1, "x")], "file_id int, line int, name string")
    assert rows(outline.rule_blocks(declared, 3).select("block", "first", "last", "n")) == [("card", 3, 5, 3), ("card", 7, 7, 1), ("menu", 6, 6, 1), ("variables", 1, 2, 2)]
    assert outline.rule_blocks(declared).count() == 0


def repo(path):
    (path / ".git").mkdir(parents=True)
    return path


def test_roots(tmp_path):
    home, other = repo(tmp_path / "a"), repo(tmp_path / "b")
    (home / "src").mkdir()
    (home / "src/x.py").write_text("")
    nested = repo(home / "lib")
    assert roots.resolve(home) == roots.Root(home, None, False) and roots.resolve(home, path=" src\\x ") == roots.Root(home, "src/x", False)
    assert roots.resolve(home, "../b") == roots.Root(other, None, True) and roots.resolve(home, "src", "x.py") == roots.Root(home, "src/x.py", False)
    assert roots.resolve(home, path=str(home / "src/x.py")) == roots.Root(home, "src/x.py", False) and roots.resolve(home, path=str(other / "q/z")) == roots.Root(other, "q/z", True)
    assert roots.resolve(home, path=str(nested / "m")) == roots.Root(nested, "m", True)
    for bad in ({"root": "nowhere"}, {"root": "/"}, {"path": "/nowhere/at/all"}):
        with pytest.raises(ValueError):
            roots.resolve(home, **bad)
    tree = tmp_path / "w"
    tree.mkdir()
    entry = home / ".git/worktrees/w"
    entry.mkdir(parents=True)
    (entry / "gitdir").write_text(f"{tree}/.git\n")
    (entry / "HEAD").write_text("ref: refs/heads/feature\n")
    (entry / "commondir").write_text("../..\n")
    (tree / ".git").write_text(f"gitdir: {entry}\n")
    assert roots.worktrees(home) == [roots.Worktree(tree, "feature")] and roots.repository(tree) == home and roots.repository(tree / ".git") == home
    assert "feature" in roots.heading(home, roots.resolve(home)) and roots.heading(home, roots.resolve(home, "../b")).startswith("in ")
    assert len(roots.store_name(home)) == 16 != roots.store_name(other)
    s = Settings(tmp_path / "conf/s.json")
    assert s.allows(home, home / "src") and s.allows(home, tree) and not s.allows(home, other)
    assert s.grant(home, other) and not s.grant(home, other) and s.allows(home, other) and s.allows(tree, other) and "access add" in s.refusal(home, tmp_path)
    s.days = 5
    s.save()
    s = Settings(tmp_path / "conf/s.json")
    assert s.granted(home) == [other] and s.days == 5 and s.revoke(home, other) and not s.revoke(home) and not s.allows(home, other)
    (tmp_path / "conf/s.json").write_text("[]")
    with pytest.raises(ValueError):
        Settings(tmp_path / "conf/s.json")


def test_stores_are_pruned(spark, tmp_path):
    stores = Folder(spark, f"file://{tmp_path}/stores")
    for name in ("a", "b", "c"):
        Manifest(spark, stores.path(name)).replace({})
    stores.write_text('{"format": 0, "segments": {}}', "b", "manifests", "9")
    stores.write_text("x", "d", "f")
    now = stores.age_and_size("a")[0]
    assert [standing(stores, x, now) for x in "abcd"] == ["current", "outdated", "current", "current"] and standing(stores, "d", now + 7200) == "left_aside"
    assert prune(stores, 30, now)[0] == 1 and stores.names() == ["a", "c", "d"]
    assert prune(stores, None, now + 10**7)[0] == 1 and prune(stores, 30, now + 10**7)[0] == 2 and stores.names() == []


def test_requests(spark, shop, tmp_path):
    home = repo(tmp_path / "home")
    opened = []
    engine = Engine(spark, home, Settings(tmp_path / "s.json"), most=2, open_=lambda s, root, kept: opened.append(root) or shop)
    said = [json.loads(x) for x in serve(engine, [
        "not json", '{"method": "ping"}', '{"id": 1, "method": "initialize", "params": {"protocolVersion": "x"}}', '{"id": 2, "method": "ping"}', '{"id": 3, "method": "tools/list"}', '{"id": 4, "method": "no"}',
        json.dumps({"id": 5, "method": "tools/call", "params": {"name": "outline", "arguments": {"path": "src/cart"}}}), json.dumps({"id": 6, "method": "tools/call", "params": {"name": "nope"}}),
        json.dumps({"id": 7, "method": "tools/call", "params": {"name": "usages", "arguments": {}}}), json.dumps({"id": 8, "method": "tools/call", "params": {"name": "grep", "arguments": {"pattern": "x", "root": str(tmp_path)}}}),
    ])]
    assert [x["id"] for x in said] == list(range(1, 9)) and said[0]["result"]["protocolVersion"] == "x" and [t["name"] for t in said[2]["result"]["tools"]] == ["search", "usages", "grep", "outline"]
    assert said[3]["error"]["code"] == -32601 and said[4]["result"]["content"][0]["text"].startswith("src/cart/  (2 files here") and said[5]["result"]["isError"] and "required" in said[6]["result"]["content"][0]["text"]
    assert said[7]["result"]["isError"] and "not been given access" in said[7]["result"]["content"][0]["text"]
    for name in ("a", "b", "c"):
        engine.corpus(tmp_path / name)
    assert list(engine.opened) == [home, tmp_path / "c"] and opened[0] == str(home)
    with pytest.raises(ValueError):
        answer(shop, "search", {"query": " "}, None)
    assert "1 line in" in answer(shop, "grep", {"pattern": "class Cart", "limit": -3}, None)
