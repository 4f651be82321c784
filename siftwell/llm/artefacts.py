"""Telling files that nobody wrote by hand: generated, minified, third-party
copies, and data stored as code.

The text is lexed, its code is emitted again in a canonical layout, and the
original layout is compared with that: extreme expansion marks minified text,
perfect uniformity generated text, dominance of literals data. Two supporting
kinds of evidence are reported apart: the path, which names lock files, source
maps, snapshots and the folders of third-party and generated code, and comments
at the head and the end of a text that say where it comes from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.session import spread

# Folder and file names by what they say of a file.
THIRD_PARTY_FOLDERS = ("_vendor", "bower_components", "extern", "external", "externals", "jspm_packages", "node_modules", "pods", "site-packages", "third-party", "third_party", "thirdparty", "vendor", "vendored")
GENERATED_FOLDERS = ("__generated__", "__pycache__", "__snapshots__", "dist", "gen", "generated")
LOCK_FILES = ("bun.lockb", "cargo.lock", "composer.lock", "flake.lock", "gemfile.lock", "go.sum", "npm-shrinkwrap.json", "package-lock.json", "packages.lock.json", "pipfile.lock", "pnpm-lock.yaml", "poetry.lock", "pubspec.lock", "uv.lock", "yarn.lock")
GENERATED_NAMES = r"(?:^zz_generated\.|[._-](?:generated|gen|g|pb|pb2|pb2_grpc|designer|autogen)\.[a-z]+$|_pb2(?:_grpc)?\.pyi?$|\.pb\.(?:go|cc|h)$)"

_GENERATED = re.compile(
    r"@generated\b|<auto-?generated|\bauto(?:matically|matisch)?[ -]?generated\b(?!.*\bby hand since)|\b(?:code|machine)[ -]generated\b|\bfile (?:was|is|has been) generated\b"
    r"|\bgenerated (?:by|from) .*\b(?:do not|don't) (?:edit|modify|change)|\b(?:produced|emitted|written) by .*\b(?:overwritten|source of truth|see the template|do not edit)"
    r"|\bend of the output of\b|\bdatei wurde .*\b(?:erzeugt|generiert)|\bgenerado autom[áa]ticamente|\bсоздан[оаы]? автоматически|\bсгенерирован"
    r"|\bg[ée]n[ée]r[ée]e? automatiquement|\bgerado automaticamente|\bgenerato automaticamente|自动生成|自動生成",
    re.I,
)
_THIRD_PARTY = re.compile(
    r"\b(?:bundled|embedded|vendored|verbatim|unmodified|unchanged) copy\b|\b(?:taken|copied|imported) (?:verbatim|unchanged|unmodified)\b|\bvendored from\b|\bdo not patch (?:it )?here\b",
    re.I,
)
_BY_HAND = re.compile(r"\b(?:maintained|kept|kept up|written) by hand\b", re.I)
_COMMENT_LINE = re.compile(r"\s*(?:\ufeff)?(?://|/\*|\*|#|--|<!--|;|%|\"\"\"|''')")
_MARKDOWN_COMMENT = re.compile(r"\s*(?:\ufeff)?<!--")
CLOSING_LINES = 2  # of code, that may close a text below its end note

# The lexer: comments and literals in one pass, so that neither opens inside the other.
_LEX = re.compile(
    r"(?P<comment>/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|(?<![:\w])//[^\n]*|^[ \t]*(?:#(?!\[|include|define)|--(?!>))[^\n]*)"
    r"|(?P<literal>\"\"\".*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"|(?<![&<\w])'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)",
    re.S | re.M,
)
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)\w?")
_WORD = re.compile(r"[^\W\d]\w*")
_SPACE = re.compile(r"\s+")
_PLACEHOLDER = re.compile(r'"s*"')
_TOKEN = re.compile(r"\"s*\"|[\w.$]+|\s+|.", re.S)
_BRACKETS = {"(": ")", "[": "]", "{": "}"}
WIDTH = 120  # of the canonical layout
# Lines of the canonical layout per original line; share of literals in the code; literals per different word.
EXPANSION, LITERALS, LITERALS_PER_WORD = 6, 0.4, 20
REPEATS = 3  # of a block, without a single exception


def lexed(text: str) -> tuple[str, int, int, int]:
    """(code, literal characters, literals, longest literal) of a text: the code
    without comments, each literal replaced by as many marks in quotes. Literals
    keep their length and lose their line ends."""
    chars = longest = count = 0

    def reduced(m: re.Match[str]) -> str:
        nonlocal chars, longest, count
        if m.lastgroup == "comment":
            return " "
        n = m.end() - m.start()
        chars, longest, count = chars + n, max(longest, n), count + 1
        return '"' + "s" * (n - 2) + '"'

    code = _LEX.sub(reduced, text)
    return code, chars, count, longest


def canonical(line: str) -> list[str]:
    """One line of lexed code in the canonical layout. What fits the width stays.
    Else there is a break after each ``;`` and after each closing brace; a bracket
    pair that doesn't fit is opened, with a line per element; neighbouring tags
    are parted."""
    line = line.strip()
    if len(line) <= WIDTH:
        return [line] if line else []
    tokens = _TOKEN.findall(line)
    at, partner, open_ = [0], {}, []
    for i, t in enumerate(tokens):
        at.append(at[-1] + len(t))
        if t in _BRACKETS:
            open_.append(i)
        elif open_ and t == _BRACKETS[tokens[open_[-1]]]:
            partner[open_.pop()] = i
    out, now, ends, i = [], [], [], 0

    def emit() -> None:
        if written := "".join(now).strip():
            out.append("  " * len(ends) + written)
        now.clear()

    while i < len(tokens):
        t = tokens[i]
        close = partner.get(i)
        if close is not None and at[close] - at[i] <= WIDTH:
            now.append("".join(tokens[i : close + 1]))
            if t == "{" and tokens[close + 1 : close + 2] not in ([","], [";"], [")"]):
                emit()
            i = close + 1
            continue
        if ends and i == ends[-1]:
            emit()
            ends.pop()
            now.append(t)
            if t == "}":
                emit()
        else:
            now.append(t)
            if close is not None:
                emit()
                ends.append(close)
            elif t == ";" or (t == "," and ends) or (t == ">" and tokens[i + 1 : i + 2] == ["<"]):
                emit()
        i += 1
    emit()
    return out


def stamped(shapes: list[str]) -> bool:
    """Whether the line shapes are one block of two lines or more, repeated
    ``REPEATS`` times or more from the first line to the last."""
    n = len(shapes)
    if n < 2 * REPEATS or len(set(shapes)) * REPEATS > n or len(set(shapes)) < 2:
        return False
    border = [0] * n
    for i in range(1, n):
        k = border[i - 1]
        while k and shapes[i] != shapes[k]:
            k = border[k - 1]
        border[i] = k + (shapes[i] == shapes[k])
    period = n - border[-1]
    return period > 1 and n % period == 0 and n // period >= REPEATS


def layout(text: str) -> dict[str, float]:
    """What the comparison of a text with its canonical layout says: ``expansion``
    (canonical lines per written line of code), ``uniform`` (the layout is the
    canonical one to the last space, and made of one repeated block), ``literal``
    (share of literals in the code's characters), ``per_word`` (literals per
    different word of code), ``long`` (share of the longest literal, if it exceeds the width)."""
    code, chars, count, longest = lexed(text)
    lines = [x for x in code.split("\n") if x.strip()]
    laid = [y for x in lines for y in canonical(x)]
    numbers = _NUMBER.findall(code)
    words = len(set(_WORD.findall(_NUMBER.sub(" ", _PLACEHOLDER.sub(" ", code)))))
    size = max(1, len(_SPACE.sub("", code)))
    literal = (chars + sum(map(len, numbers))) / size
    canonical_ = len(laid) == len(lines) and not any(x != x.rstrip() or "\t" in x.lstrip("\t") for x in text.replace("\r", "").split("\n"))
    shapes = [x.strip() for x in _NUMBER.sub("0", _WORD.sub("a", code)).split("\n") if x.strip()] if canonical_ else []
    return {"expansion": len(laid) / max(1, len(lines)), "uniform": stamped(shapes), "literal": literal, "per_word": (count + len(numbers)) / max(1, words), "long": longest / size if longest > WIDTH else 0.0}


def layout_reason(text: str, kind: str | None) -> str | None:
    """'data', 'minified', 'generated' or None, by layout alone. Settings hold
    literals and like sections by nature, so of them only expansion counts."""
    m = layout(text)
    if kind != "Config":
        if m["long"] >= LITERALS or (m["literal"] >= LITERALS and m["per_word"] >= LITERALS_PER_WORD):
            return "data"
        if m["uniform"]:
            return "generated"
    return "minified" if m["expansion"] >= EXPANSION else None


def path_reason(path: Column) -> Column:
    """'third_party', 'generated', 'minified', 'locked' or null, by path alone.
    Folder and file names are compared whole and without case, so that a folder
    *about* such files (``vendor_portal``) doesn't count. A null path says nothing."""
    parts = F.split(F.lower(F.translate(path, "\\", "/")), "/")
    folders, name = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)
    named = lambda names: F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    return (
        F.when(name.isin(*LOCK_FILES) | name.endswith(".map") | name.endswith(".snap"), "locked")
        .when(name.rlike(r"[.-]min\."), "minified")
        .when(named(THIRD_PARTY_FOLDERS) | name.rlike(r"-\d+\.\d+\.\d+[^/]*\.(?:js|mjs|cjs|css)$"), "third_party")
        .when(named(GENERATED_FOLDERS) | name.rlike(GENERATED_NAMES), "generated")
    )


def comment_reason(text: str, kind: str | None) -> str | None:
    """'generated', 'third_party' or None: what the comments that open the text, and
    those that close it, say of where it comes from."""
    lines = text.split("\n")
    comment = _MARKDOWN_COMMENT if kind == "Docs" else _COMMENT_LINE
    head = []
    for x in lines:
        if x.strip() and not comment.match(x):
            break
        head.append(x)
    tail = []
    for i, x in enumerate(y for y in reversed(lines) if y.strip()):
        if comment.match(x):
            tail.append(x)
        elif i >= CLOSING_LINES:
            break
    for x in (*head, *reversed(tail)):
        if not _BY_HAND.search(x):
            if _GENERATED.search(x):
                return "generated"
            if _THIRD_PARTY.search(x):
                return "third_party"
    return None


def text_reason(text: str | None, kind: str | None) -> tuple[str, str] | None:
    """(reason, evidence) of a text that isn't hand-written, or None. Null and blank
    texts say nothing; prose (kind Docs) has no layout of code and is judged by
    its comments only."""
    if not text or not text.strip():
        return None
    if kind != "Docs" and (reason := layout_reason(text, kind)):
        return reason, "layout"
    reason = comment_reason(text, kind)
    return (reason, "comment") if reason else None


def artefacts(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, reason, evidence) of the files that nobody wrote by hand.

    ``files`` (file_id, path, kind), ``texts`` (file_id, text, kind). A file
    counts if any of its rows or texts gives a reason; evidence of the layout goes
    before that of comments, and both before the path's; of several reasons the
    alphabetically first is kept. A text
    is judged under the kind of its own row. Files without text are judged by
    path. Null file ids give no rows; other columns are ignored; an empty table
    gives no rows.

    Texts are judged where they are read and never shuffled: only ids and
    reasons travel.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(f, r[1] == "comment", *r) for f, t, k in zip(pdf["file_id"], pdf["text"], pdf["kind"]) if (r := text_reason(t, k))]
            yield pd.DataFrame(found, columns=["file_id", "rank", "reason", "evidence"]).astype({"rank": "int32"})

    by_path = files.select("file_id", F.lit(2).alias("rank"), path_reason(F.col("path")).alias("reason"), F.lit("path").alias("evidence")).where("file_id is not null and reason is not null")
    known = files.select("file_id").where("file_id is not null").distinct()
    own = spread(texts.select("file_id", "text", "kind").where("file_id is not null and text is not null"))
    by_text = own.mapInPandas(judge, "file_id long, rank int, reason string, evidence string").join(known, "file_id", "left_semi")
    best = by_path.unionByName(by_text).groupBy("file_id").agg(F.min(F.struct("rank", "reason", "evidence")).alias("x"))
    return best.select("file_id", "x.reason", "x.evidence")
