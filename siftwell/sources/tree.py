"""A source tree as a Spark data source (``spark.read.format("tree")``).

One input partition per top-level entry. Hidden names, ignored paths, junk,
unknown kinds and files over 1 MiB are left out; files that aren't UTF-8, or
look minified, are listed with ``indexed`` false and no text. Options: ``path``
the root, ``paths`` a JSON list of relative paths that narrows the walk to them
and what is below them, ``text`` = ``false`` for a listing without contents.

The folder must be visible to all executors.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwell.operators.classify import CODE, CONFIG, DOCS, JUNK_FOLDERS, JUNK_NAMES, LONG_LINE, MAX_FILE_BYTES, MINIFIED_BYTES, TEST_FOLDERS

SCHEMA = "path string, kind string, indexed boolean, stamp struct<mtime_s long, mtime_ns int, bytes long>, hash string, text string"
IGNORE_FILES = (".gitignore", ".ignore")


class Ignore:
    """The rules of one ignore file, relative to its folder; the last match wins."""

    def __init__(self, text: str) -> None:
        self.rules: list[tuple[re.Pattern[str], bool, bool]] = []
        for line in text.splitlines():
            line = line.rstrip() if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            folder = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + self._regex(line.lstrip("/"))), folder, keep))

    @staticmethod
    def _regex(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            if glob.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif glob.startswith("**", i):
                out, i = out + ".*", i + 2
            elif glob[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif glob[i] == "?":
                out, i = out + "[^/]", i + 1
            elif glob[i] == "[" and "]" in glob[i + 2 :]:
                j = glob.index("]", i + 2)
                out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]", j + 1
            elif glob[i] == "\\" and i + 1 < len(glob):
                out, i = out + re.escape(glob[i + 1]), i + 2
            else:
                out, i = out + re.escape(glob[i]), i + 1
        return out

    def verdict(self, path: str, folder: bool) -> bool | None:
        out = None
        for rule, only_folders, keep in self.rules:
            if (folder or not only_folders) and rule.fullmatch(path):
                out = not keep
        return out


def kind_of(path: str) -> str | None:
    folders, name = path.split("/")[:-1], path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    ext = ext.lower() if stem and dot else ""
    if ext in CODE:
        test = bool(set(folders) & set(TEST_FOLDERS)) or name.startswith("test_") or any(m in name for m in ("_test.", ".test.", ".spec."))
        return "Test" if test else "Code"
    return "Docs" if ext in DOCS else "Config" if ext in CONFIG else None


def is_junk(path: str) -> bool:
    folders, name = path.split("/")[:-1], path.rsplit("/", 1)[-1]
    return bool(set(folders) & set(JUNK_FOLDERS)) or name in JUNK_NAMES or name.endswith((".map", ".snap")) or ".min." in name


def is_minified(text: str) -> bool:
    lines = re.split(r"\r?\n", text.removesuffix("\n")) if text else []
    sizes, n = [len(x.encode()) for x in lines], max(1, len(lines))
    if len(text.encode()) <= MINIFIED_BYTES or len(text.encode()) // n <= LONG_LINE:
        return False
    run = longest = 0
    for s in sizes:
        run = run + 1 if s > LONG_LINE else 0
        longest = max(longest, run)
    return n < 8 or 2 * longest > n


def walk(root: str, top: str | None = None, only: list[str] | None = None) -> Iterator[tuple[str, str]]:
    """(relative path, absolute path) of what a walk keeps, sorted within folders.
    ``top`` narrows it to one entry of the root, ``only`` to some paths."""

    def wanted(rel: str, folder: bool) -> bool:
        return not only or any(rel == p or rel.startswith(p + "/") or (folder and p.startswith(rel + "/")) for p in only)

    def visit(folder: str, rel: str, rules: list[tuple[str, Ignore]]) -> Iterator[tuple[str, str]]:
        rules = [*rules]
        for name in IGNORE_FILES:
            at = os.path.join(folder, name)
            if os.path.isfile(at):
                with open(at, encoding="utf-8", errors="replace") as f:
                    rules.append((rel, Ignore(f.read())))
        for e in sorted(os.scandir(folder), key=lambda e: e.name):
            path = f"{rel}{e.name}"
            if e.name.startswith(".") or (top is not None and not rel and e.name != top):
                continue
            is_folder = e.is_dir(follow_symlinks=False)
            verdict = None
            for base, rule in rules:
                v = rule.verdict(path[len(base) :], is_folder)
                verdict = verdict if v is None else v
            if verdict or not wanted(path, is_folder):
                continue
            if is_folder:
                yield from visit(e.path, path + "/", rules)
            elif e.is_file(follow_symlinks=False) and kind_of(path) and not is_junk(path) and e.stat().st_size <= MAX_FILE_BYTES:
                yield path, e.path

    yield from visit(root, "", [])


def read_file(path: str, at: str, text: bool = True) -> tuple:
    stat = os.stat(at)
    stamp = (stat.st_mtime_ns // 10**9, stat.st_mtime_ns % 10**9, stat.st_size)
    if not text:
        return path, kind_of(path), None, stamp, None, None
    with open(at, "rb") as f:
        data = f.read()
    try:
        body: str | None = data.decode("utf-8")
    except UnicodeDecodeError:
        body = None
    if body is not None and is_minified(body):
        body = None
    return path, kind_of(path), body is not None, stamp, hashlib.sha256(data).hexdigest()[:32], body


class _Top(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.only, self.text = options["path"], json.loads(options.get("paths", "null")), options.get("text", "true") != "false"

    def partitions(self) -> list[InputPartition]:
        return [_Top(n) for n in sorted(os.listdir(self.root)) if not n.startswith(".")] or [_Top("")]

    def read(self, partition: _Top) -> Iterator[tuple]:
        for path, at in walk(self.root, partition.name, self.only):
            yield read_file(path, at, self.text)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)


def holds_more_than(spark: SparkSession, root: str, limit: int) -> bool:
    """Whether a tree has more than ``limit`` files, looking no further."""
    return spark.read.format("tree").option("path", root).option("text", "false").load().limit(limit + 1).count() > limit
