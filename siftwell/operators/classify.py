"""What a file is, by its path and by its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import explode_lines, trim

# Kinds by extension; folders and names of tests and of junk; marks of assertions; openings of imports.
CODE = (
    "astro bash c cc cjs clj cpp cs css cxx dart ex exs go graphql h hpp hs htm html java js jsx kt kts less lua m mjs ml mm pcss php pl postcss proto ps1 py r rb rs sass scala scss sh sql styl svelte swift ts tsx vue zig"
).split()
DOCS = "adoc md mdx rst txt".split()
CONFIG = "cfg conf env ini json toml xml yaml yml".split()
TEST_FOLDERS = "__mocks__ __tests__ benches cypress e2e factories fixtures migrations mocks playwright seeders spec specs stories test testdata tests".split()
JUNK_FOLDERS = "__pycache__ bower_components dist node_modules target third-party third_party vendor vendored".split()
JUNK_NAMES = "Cargo.lock Gemfile.lock bun.lock composer.lock go.sum package-lock.json pnpm-lock.yaml poetry.lock uv.lock yarn.lock".split()
ASSERTIONS = ("->assert", "@Test", "FAIL:", "PASS:", "assert(", "assert.", "assertEquals(", "assertTrue(", "assert_eq!(", "describe(", "expect(", "it(", "self.assert", "t.Error", "t.Fatal", "t.Run(", "test(")
IMPORTS = ("#include", "<?php", "declare(", "from ", "import ", "import(", "namespace ", "package ", "pub use ", "require(", "use ", "using ")
MAX_FILE_BYTES, MINIFIED_BYTES, LONG_LINE = 1 << 20, 4096, 400


def _folders(path: Column) -> Column:
    p = F.split(path, "/")
    return F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _among(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(_folders(path), F.array(*map(F.lit, names)))


def is_junk(path: Column) -> Column:
    name = file_name(path)
    return _among(path, JUNK_FOLDERS) | name.isin(*JUNK_NAMES) | name.endswith(".map") | name.endswith(".snap") | name.contains(".min.")


def is_test_path(path: Column) -> Column:
    name = file_name(path)
    return _among(path, TEST_FOLDERS) | name.startswith("test_") | name.contains("_test.") | name.contains(".test.") | name.contains(".spec.")


def kind_of(path: Column) -> Column:
    """Code, Test, Docs or Config by extension and folder; null is none of them.
    A name that is all extension (``.env``) has none."""
    ext = F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))
    return (
        F.when(ext.isin(*CODE), F.when(is_test_path(path), F.lit("Test")).otherwise(F.lit("Code")))
        .when(ext.isin(*DOCS), F.lit("Docs"))
        .when(ext.isin(*CONFIG), F.lit("Config"))
    )


def admits(content: Column, kind: Column) -> Column:
    """Whether a question about ``content`` (code, docs, config, all) wants a kind."""
    c = F.lower(content)
    return F.coalesce(
        F.when(c == "code", kind.isin("Code", "Test")).when(c == "docs", kind == "Docs").when(c == "config", kind == "Config").otherwise(F.lit(True)),
        F.lit(False),
    )


def minified(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, lines, minified): over 4096 bytes, over 400 bytes a line on average,
    and under 8 lines, or the longest run of lines over 400 bytes is more than
    half. Runs are found by gaps and islands."""
    ls = explode_lines(docs.select(key, text), text).withColumn("long", F.octet_length("content") > LONG_LINE)
    order = Window.partitionBy(key).orderBy("line")
    kinds = Window.partitionBy(key, "long").orderBy("line")
    runs = ls.where("content is not null").withColumn("island", F.row_number().over(order) - F.row_number().over(kinds)).where("long").groupBy(key, "island").agg(F.count(F.lit(1)).alias("run"))
    longest = runs.groupBy(key).agg(F.max("run").alias("longest"))
    sizes = docs.select(key, F.octet_length(text).alias("bytes"), F.greatest(F.size(_line_array(text)), F.lit(1)).alias("lines"))
    out = sizes.join(longest, key, "left").withColumn("longest", F.coalesce("longest", F.lit(0)))
    big = (F.col("bytes") > MINIFIED_BYTES) & (F.floor(F.col("bytes") / F.col("lines")) > LONG_LINE)
    return out.select(key, "lines", F.coalesce(big & ((F.col("lines") < 8) | (F.col("longest") * 2 > F.col("lines"))), F.lit(False)).alias("minified"))


def _line_array(text: str) -> Column:
    from siftwell.functions.text import lines

    return F.coalesce(lines(F.col(text)), F.array().cast("array<string>"))


def _quote(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in s)


def reads_as_tests(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, checking, written, tests): lines with an assertion at their start,
    or after a space or ``(``; six of them and 5 % of the written lines make tests."""
    ls = explode_lines(docs.select(key, text), text).where(trim(F.col("content")) != "")
    mark = rf"^(?U)\s*(?:{'|'.join(map(_quote, ASSERTIONS))})|[ (](?:{'|'.join(map(_quote, ASSERTIONS))})"
    counts = ls.groupBy(key).agg(F.count_if(F.col("content").rlike(mark)).alias("checking"), F.count(F.lit(1)).alias("written"))
    return counts.withColumn("tests", (F.col("checking") >= 6) & (F.col("checking") * 100 >= F.col("written") * 5))


def import_line(content: Column) -> Column:
    line = trim(content)
    quoted = line.startswith('"') & F.regexp_replace(line, ",+$", "").endswith('"')
    aliased = line.endswith('"') & (F.size(F.split(line, r"(?U)\s+")) == 2) & line.contains("/")
    opened = line.rlike(rf"^(?:{'|'.join(map(_quote, IMPORTS))})")
    return quoted | aliased | opened | (line.contains("require(") & line.startswith("const "))


def mostly_imports(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, importing, written, imports): at least three fifths of the written
    lines, those of a lone bracket aside, import something."""
    ls = explode_lines(docs.select(key, text), text).withColumn("t", trim(F.col("content"))).where("t not in ('', '(', ')')")
    counts = ls.groupBy(key).agg(F.count_if(import_line(F.col("t"))).alias("importing"), F.count(F.lit(1)).alias("written"))
    return counts.withColumn("imports", F.col("importing") * 5 >= F.col("written") * 3)
