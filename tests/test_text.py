import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions.analyze import index_terms, query_terms
from siftwell.functions.paths import normal_path
from siftwell.functions.stem import english, russian, stem
from siftwell.operators import lookup
from siftwell.operators.classify import admits, is_junk, kind_of, minified, mostly_imports, reads_as_tests


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s"))).first()[0]


def test_lines(spark):
    assert one(spark, "a\r\nb c\n\n", T.lines) == ["a", "b c", ""]
    assert one(spark, "", T.lines) == [] and one(spark, None, T.lines) is None and one(spark, "\n", T.lines) == [""]


def test_parts_and_terms(spark):
    assert one(spark, "cleanup_assets HTTPServer2 x 42", T.terms) == ["cleanup", "assets", "cleanup_assets", "http", "server", "httpserver2"]
    assert one(spark, "кодОшибки", T.terms) == ["код", "ошибки", "кодошибки"]
    assert one(spark, "how is HTTPServer .btn-primary, done", T.identifier_words) == ["httpserver", "btn-primary"]


@pytest.mark.parametrize("word,want", [("generously", "generous"), ("hopping", "hop"), ("hoped", "hope"), ("cries", "cri"), ("relational", "relat"), ("controll", "control"), ("skies", "sky"), ("y", "y"), ("by", "by")])
def test_english(word, want):
    assert english(word) == want


@pytest.mark.parametrize("word,want", [("важная", "важн"), ("вагонов", "вагон"), ("валялась", "валя"), ("красивейший", "красив"), ("одиночество", "одиночеств")])
def test_russian(word, want):
    assert russian(word) == want and stem(word) == want


def test_query_terms_drop_grammar(spark):
    q = spark.createDataFrame([(1, "how does the prepared_assets cleanup run"), (2, None), (3, "")], "query_id long, text string")
    got = {(r.query_id, r.term, r.n_terms) for r in query_terms(q).collect()}
    assert got == {(1, "prepar", 5), (1, "asset", 5), (1, "prepared_assets", 5), (1, "cleanup", 5), (1, "run", 5)}
    t = {(r.term, r.tf) for r in index_terms(q, "query_id").where("query_id = 1").collect()}
    assert ("prepar", 1) in t and ("the", 1) in t


def test_whole_word_quoted_comment(spark):
    has = lambda s, f: one(spark, s, f)
    assert has("call(foo)", lambda c: T.whole_word(c, "foo")) and not has("foo_bar", lambda c: T.whole_word(c, "foo")) and not has("éfoo", lambda c: T.whole_word(c, "foo"))
    assert has("x = 'a.b'", lambda c: T.quoted(c, "a.b")) and not has("x = a.b", lambda c: T.quoted(c, "a.b"))
    assert [has(s, T.comment_line) for s in ("// a", "  # a", "#include <a>", "#[test]", "* a", "*a", "-- a")] == [True, True, False, False, True, False, True]


def test_paths_and_kinds(spark):
    assert [one(spark, p, normal_path) for p in (".\\a\\b", "./a//b/", "/a/./b", None)] == ["a/b", "a/b", "a/b", None]
    kinds = {"src/a.rs": "Code", "tests/a.rs": "Test", "a_test.go": "Test", "A.MD": "Docs", "x.toml": "Config", "x.bin": None, ".env": None, "specs.py": "Code"}
    assert {p: one(spark, p, kind_of) for p in kinds} == kinds
    assert [one(spark, p, is_junk) for p in ("vendor/a.js", "vendor.js", "a.min.js", "go.sum")] == [True, False, True, True]
    assert one(spark, "Test", lambda k: admits(F.lit("code"), k)) and not one(spark, None, lambda k: admits(F.lit("code"), k))


def test_text_kinds(spark):
    docs = spark.createDataFrame([(1, "x" * 5000), (2, "a\nb"), (3, None), (4, ""), (5, "\n".join(["y" * 500] * 9 + ["z"] * 1))], "id long, text string")
    assert {r.id: r.minified for r in minified(docs, "id").collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    tests = spark.createDataFrame([(1, "\n".join(["  assert(x)"] * 6)), (2, "assert.a\nb"), (3, None)], "id long, text string")
    assert {r.id: r.tests for r in reads_as_tests(tests, "id").collect()} == {1: True, 2: False}
    imports = spark.createDataFrame([(1, 'import a\nimport (\n"x/y"\n)\nb()'), (2, "a()\nimport b")], "id long, text string")
    assert {r.id: r.imports for r in mostly_imports(imports, "id").collect()} == {1: True, 2: False}


def test_regex_dialect(spark):
    assert lookup.java_regex(r"(?P<x>a)[[:alpha:]]\p{Greek}") == r"(?<x>a)[\p{IsAlphabetic}]\p{IsGreek}"
    for bad in ("(?=a)", r"(a)\1"):
        with pytest.raises(ValueError):
            lookup.java_regex(bad)
    docs = spark.createDataFrame([(1, "one\r\nx two\n")], "id long, text string")
    with pytest.raises(ValueError):
        lookup.grep(docs, "(", "id")
    assert [tuple(r) for r in lookup.grep(docs, "e$", "id").collect()] == [(1, 1, "one")]


def test_enclosing_declaration(spark, rows):
    lines = spark.createDataFrame([(1, 2, "foo"), (1, 5, "def foo"), (1, 6, "foo()")], "file_id long, line int, content string")
    decl = spark.createDataFrame([(1, 1, "bar"), (1, 5, "foo")], "file_id long, line int, name string")
    assert rows(lookup.with_enclosing(lines, decl, "foo").select("line", "inside", "declares")) == [(2, "bar", False), (5, "bar", True), (6, "bar", False)]


def test_snippet_window(spark):
    text = [(1, i, c) for i, c in enumerate(["a", "x", "b", "x", "a b", "x", "x"], 1)]
    ls = spark.createDataFrame(text, "id long, line int, content string")
    assert tuple(lookup.snippet_window(ls, ["a", "b"], 3, "id").first()) == (1, 3, 2, 3)
