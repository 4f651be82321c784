import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.operators.chunker import chunk_spans, spans, text_lines
from siftwell.operators.declare import chunk_declarations, declarations, declared_name, names_in
from siftwell.operators.rank import HIT, evaluated, presented, settle, settled


def test_lines():
    assert text_lines("a\r\nb\n") == ["a", "b"] and text_lines("") == [] and text_lines("\n") == [""]


def test_comment_stays_with_its_function():
    body = ["    x += 1"] * 11
    code = ["# first", "def a():", *body, "", "# second", "def b():", *body]
    assert spans(code) == [(1, 13), (15, 27)]


def test_long_block_is_cut_by_members():
    code = ["import a", "", "class A:"] + [line for k in range(6) for line in (f"    def m{k}(self):", *["        pass"] * 18, "")]
    got = spans(code)
    assert [a for a, _ in got] == [1, 3, 24, 44, 64, 84, 104] and all(b - a <= 20 for a, b in got)


def test_windows_overlap():
    assert spans(["x"] * 130) == [(1, 60), (51, 110), (101, 130)]


def test_every_written_line_is_in_a_chunk():
    rng = random.Random(7)
    for _ in range(60):
        lines = [" " * rng.choice([0, 0, 4, 8]) + rng.choice(["x", "}", "", "def f():", "end"]) for _ in range(rng.randint(0, 300))]
        covered = {i for a, b in spans(lines) for i in range(a, b + 1)}
        assert all(i in covered for i, x in enumerate(lines, 1) if x.strip())


def test_chunk_spans_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  \n "), (4, "a"), (None, "a")], "id long, text string")
    assert [tuple(r) for r in chunk_spans(docs, "id").collect()] == [(4, 0, 1, 1)]
    assert chunk_spans(docs.limit(0), "id").count() == 0


@pytest.mark.parametrize(
    "line,following,name",
    [
        ("pub fn open_cart(x: u32) -> bool {", None, "open_cart"), ("struct cart {", None, "cart"), ("struct cart *next;", None, None), ("} cart_t;", None, "cart_t"),
        ("#define MAX_CARTS 3", None, "MAX_CARTS"), ("export default class Cart extends Box {", None, "Cart"), ("func (c *Cart) Open(x int) error {", None, "Open"),
        ("    public function total(): int {", None, "total"), ("async def load(x):", None, "load"), ("static int total(struct cart *c) {", None, "total"),
        ("static int total(struct cart *c)", "{", "total"), ("if (x) {", None, None), ("    const local = 3;", None, None), ("const handler = (x) => {", None, "handler"),
        ("    MAX_SIZE = 3,", None, "MAX_SIZE"), ("// fn nothing() {", None, None), ("return open(x) {", None, None), ("    render() {", None, "render"), ("main() {", None, None),
        ("pub(crate) fn open(self) {", None, "open"), ('extern "C" fn total(x: i32) {', None, "total"), ("impl<T> Cart<T> {", None, "Cart"), ("macro_rules! carts {", None, "carts"), ("export const useCart = (k: string) => {", None, "useCart"), ("const v$ = useIt(a, b)", None, "v$"),
        ("describe('cart', () => {", None, None), ("    CART_OPEN,  /* no more */", None, "CART_OPEN"), ("    CARTS = of(a, b)", None, None), ("    OK", None, None), ("____ = 1", None, None), ("LIMIT = 3  # (a note)", None, "LIMIT"), ("} else if (ready(x)) {", None, None),
        ("  async onOpen({ cart }): Promise<void> {", None, "onOpen"), ("        $f = function () use ($u) {", None, None), ("template<T> struct_of(int x) {", None, "struct_of"), ("open_cart(ctx_t *c, int n)", "{", "open_cart"), ("class {", None, None), ("", None, None), ("   ", "{", None),
        ("interface Cart {", None, "Cart"), ("type Cart struct {", None, None), ("type Cart = Box;", None, "Cart"), ("int total(int x);", None, None),
    ],
)
def test_declared_names(line, following, name):
    assert declared_name(line, following) == name


def test_names_by_syntax():
    sheet = [":root {", "  --gap: 2px;", "}", ".card {", "  &__title {", "    color: red;", "  }", "}", "@keyframes spin {", "  from {", "  }", "}"]
    assert names_in("a.scss", sheet) == [("root", 1), ("--gap", 2), ("card", 4), ("card__title", 5), ("spin", 9)]
    assert names_in("a.vue", ["<script>", "function go() {", "}", "</script>", "<style>", ".box {", "}", "</style>"]) == [("go", 2), ("box", 6)]
    assert names_in("a.html", ['<main id="top">', '{{ define "page" }}']) == [("top", 1), ("page", 2)]
    assert names_in("a.md", ["# One #", "```", "# not", "```", "#no", "## Two"]) == [("One", 1), ("Two", 6)]
    wrapped = ["static int find(struct ctx *c,", "                struct node *n) {", "}"]
    assert names_in("a.c", wrapped) == [("find", 1)] and names_in("a.c", ["static int find(struct ctx *c,", "    int n);"]) == []
    assert len(names_in("a.md", ["# x"] * 200)) == 96


def test_rules_pages_and_components():
    sheet = ["$gap: 8px;", "  $inner: 1px;", "@mixin cut($n) {", "}", ".box {", "  &__top {", "    font: {", "    }", "    &--on {", "    }", "  }", "  &:hover {", "    .box__icon, .b {", "    }", "  }", "  @media (x) {", "    &__body {", "    }", "  }", "}", ".chip { padding: 0 8px; }", "*:focus {", "}", "#head > nav {", "/* .no { */", "a: b; .c {"]
    assert names_in("a.scss", sheet) == [("$gap", 1), ("cut", 3), ("box", 5), ("box__top", 6), ("box__top--on", 9), ("box__icon", 13), ("box__body", 17), ("chip", 21), ("*", 22), ("head", 24)]
    assert names_in("a.vue", ["<template>", '<p id="x">', "</template>", "<script>", "const open = ref(1)", "</script>"]) == [("open", 5)]
    assert names_in("a.html", ["<script>", "function boot() {", "</script>", "{% block content %}", '<a id="1x">']) == [("boot", 2), ("content", 4)]
    assert names_in("a.md", [" # in", "####### seven", "#\ttab ##", "# "]) == [("tab", 3)]


def test_long_lines_cost_their_length_only():
    for line in ("a" * 10**6 + " {", "f" * 10**6 + "(x) {", "int " * 200_000 + "f(int x) {", "<" * 10**5 + ">" * 10**5 + "f(x) {", "A_" * 10**5, "static " * 10**5 + "x", "pub(" * 10**5):
        began = time.perf_counter()
        declared_name(line)
        assert time.perf_counter() - began < 1


def brute_spans(lines):
    """The survey's rules, line by line."""
    blank = [not x.strip() for x in lines]
    closer = [bool(x.strip()) and (x.strip()[0] in "})]" or x.strip() == "end") for x in lines]
    width = [sum(4 if c == "\t" else 1 for c in x[: len(x) - len(x.lstrip())]) for x in lines]

    def trim(a, b):
        rows = [i for i in range(a, b) if not blank[i]]
        return (rows[0], rows[-1] + 1) if rows else (a, a)

    def cut(a, b, level):
        a, b = trim(a, b)
        if a >= b:
            return []
        base = min([width[i] for i in range(a, b) if not blank[i] and not closer[i]], default=0)
        opens = [a] + [i for i in range(a + 1, b) if not blank[i] and not closer[i] and width[i] == base and (blank[i - 1] or (closer[i - 1] and width[i - 1] <= base))]
        units = [u for u in (trim(x, y) for x, y in zip(opens, opens[1:] + [b])) if u[0] < u[1]]
        if len(units) == 1:
            return [(a, b)] if b - a <= 80 else [(s, min(s + 60, b)) for s in range(a, b, 50) if s == a or s + 10 < b]
        out, small = [], []
        for u in [*units, None]:
            big = u is not None and u[1] - u[0] > 80 and level < 4
            if (u is None or big) and small:
                tail = (small[0][0], small[-1][1])
                if u is None and tail[1] - tail[0] < 6 and out and out[-1][1] <= tail[0] and out[-1][1] - out[-1][0] < 80:
                    out[-1] = (out[-1][0], tail[1])
                else:
                    out.append(tail)
                small = []
            if big:
                inner = cut(u[0] + 1, u[1], level + 1)
                out += [(u[0], inner[0][1]), *inner[1:]] if inner else [u]
            elif u is not None:
                small.append(u)
                if u[1] - small[0][0] >= 12:
                    out.append((small[0][0], u[1]))
                    small = []
        return out

    return [(a + 1, b) for a, b in cut(0, len(lines), 0)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 0, 0, 2, 4, 8]), st.sampled_from(["x", "x = 1", "}", "", "", "def f():", "end", "\ty"])), max_size=260))
def test_chunks_equal_brute_force(parts):
    lines = [" " * n + x for n, x in parts]
    assert spans(lines) == brute_spans(lines)


def test_names_are_counted_and_limited_in_each_chunk(spark):
    body = ["    x += 1"] * 12
    twice = "\n".join(["def init():", *body, "", "def init():", *body])
    long = "\n".join(f"def f{i}():\n" + "\n".join(body) + "\n" for i in range(120))
    docs = spark.createDataFrame([(1, "a.py", twice), (2, None, long), (3, "a.py", None), (4, "a.py", "")], "id long, path string, text string")
    assert [tuple(r) for r in declarations(docs, "id").where("id <> 2").orderBy("ord").collect()] == [(1, 0, "init", 1), (1, 1, "init", 15)]
    assert [r.name for r in declarations(docs, "id").where("id = 2").orderBy("ord").collect()] == [f"f{i}" for i in range(120)]
    assert [tuple(r) for r in chunk_declarations(docs, "id").where("id = 1").orderBy("ord").collect()] == [(1, 0, "init", 1), (1, 1, "init", 15)]


def hit(chunk, score, start, end, file=1, coverage=0.0, declares=False):
    return {"query_id": 1, "chunk_id": chunk, "file_id": file, "score": score, "start_line": start, "end_line": end, "coverage": coverage, "declares": declares}


def test_neighbours_join_in_rank_order():
    out = settle([hit(1, 0.9, 10, 20), hit(2, 0.8, 40, 50), hit(3, 0.7, 22, 38, coverage=0.5), hit(4, 0.6, 1, 5, file=2)], set())
    assert [(h["chunk_id"], h["start_line"], h["end_line"], h["coverage"]) for h in out] == [(1, 10, 50, 0.5), (4, 1, 5, 0.0)]
    assert len(settle([hit(1, 0.9, 1, 80), hit(2, 0.8, 81, 160)], set())) == 2


def test_an_opening_yields_to_the_body():
    out = settle([hit(1, 1.0, 1, 5), hit(2, 0.8, 90, 99)], {1})
    assert [(h["chunk_id"], h["score"]) for h in out] == [(2, 1.0), (1, 0.8)]
    assert settle([hit(1, 1.0, 1, 5), hit(2, 0.6, 90, 99)], {1})[0]["chunk_id"] == 1
    assert settle([], set()) == []


def test_a_hot_file_hides_no_hit_of_others(spark):
    rng = random.Random(3)
    hits = [hit(c, 0.05, 1 + 200 * c, 50 + 200 * c, declares=True) for c in range(1200)] + [hit(c, round(0.05 - rng.random() / 50, 6), 1 + 30 * (c % 9), 30 + 30 * (c % 9), file=2 + c // 9 % 5, declares=c % 2 > 0) for c in range(1200, 1245)]
    hits += [hit(c, round(0.01 + rng.choice([0.0, 0.01, rng.random() / 50]), 6), 1 + 90 * (c % 60), 80 + 90 * (c % 60), file=c // 60) | {"query_id": 2} for c in range(3000, 3300)]
    want = []
    for q in (1, 2):
        seen, out = {}, []
        for h in sorted(settle([x for x in hits if x["query_id"] == q], set()), key=lambda x: (-x["score"], x["chunk_id"])):
            k = seen[h["file_id"]] = seen.get(h["file_id"], -1) + 1
            out.append((-round(h["score"] * 0.85**k, 12), h["chunk_id"], h["start_line"], h["end_line"]))
        want += [(q, i, c, a, b) for i, (_, c, a, b) in enumerate(sorted(out)[:8], 1)]
    chunks = spark.createDataFrame([(h["chunk_id"], h["file_id"], h["start_line"], 9.0, None) for h in hits], "chunk_id long, file_id long, start_line int, length double, names array<struct<name string, line int>>")
    files = spark.createDataFrame([(f, 10.0) for f in {h["file_id"] for h in hits}], "file_id long, length double")
    names = [x.split()[0] for x in HIT.split(", ")]
    got = settled(spark.createDataFrame([tuple(h[n] for n in names) for h in hits], HIT), chunks, files).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.chunk_id, r.start_line, r.end_line) for r in got] == want
    assert {r.file_id for r in got if r.query_id == 1} > {1}


def test_presentation(spark, rows):
    cols = "query_id long, rank int, chunk_id long, score double, coverage double, declares boolean"
    clear = [(1, 1, 1, 1.0, 0.2, True), (1, 2, 2, 0.5, 0.9, False), (1, 3, 3, 0.4, 0.1, True)]
    open_ = [(2, 1, 4, 1.0, 0.6, False), (2, 2, 5, 0.9, 0.1, False), (2, 3, 6, 0.8, 0.1, False), (2, 4, 7, 0.7, 0.5, False), (2, 5, 8, 0.6, 0.1, False)]
    got = rows(presented(spark.createDataFrame(clear + open_, cols)).select("query_id", "rank", "detail", "confident"))
    assert got == [(1, 1, "Declaration", True), (1, 3, "Skim", True), *[(2, i, d, True) for i, d in enumerate(("Snippet", "Snippet", "Snippet", "Skim", "Heading"), 1)]]


def test_recall(spark):
    r = evaluated(spark.createDataFrame([(1, 1), (2, 4), (3, None)], "probe_id long, rank int")).first()
    assert (r.probes, round(r.recall_1, 3), round(r.recall_5, 3), round(r.mrr, 4)) == (3, 0.333, 0.667, 0.4167)
