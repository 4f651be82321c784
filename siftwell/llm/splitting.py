"""Splitting oversized items at natural boundaries, with overlap.

Every line gets a boundary strength: how natural a cut before it is. A
sparse-table range-maximum index over the strengths answers, for each piece, the
strongest cut in the window of permissible lengths; ties go to the right. The
next piece then steps back by the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 100  # strengths from here on are block starts; a shallower block is stronger
_LINES = re.compile(r"\r?\n")
_COMMENT = re.compile(r"\s*(?://|/\*|\*/|\*(?:\s|$)|#(?!\[|!\[|include|define|if|endif|pragma|undef)|--|;;|<!--|@\w|#!?\[)")
_HEADING = re.compile(r"#{1,6}(?:[ \t]|$)")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_SECTION = re.compile(r"\[{1,2}[^\[\]]+\]{1,2}\s*(?:[#;].*)?$")
_KEY = re.compile(r"""(["']?)[^\s"'#:=\[\]{}][^"':=]*\1\s*[:=]\s*(?:[{\[|>&!].*|#.*)?$""")
# Words that open a declaration, and words that open a statement.
_OPENERS = (
    "abstract", "async", "class", "const", "def", "default", "enum", "export", "extern", "final", "fn", "fun", "func", "function", "impl", "inline", "interface",
    "internal", "mod", "module", "namespace", "object", "override", "private", "protected", "pub", "public", "record", "sealed", "static", "struct", "sub", "trait", "type", "union", "unsafe", "virtual",
)
_STATEMENTS = (
    "assert", "await", "break", "case", "catch", "continue", "default", "defer", "del", "delete", "do", "elif", "else", "except", "finally", "for", "foreach", "go", "goto", "if", "import",
    "include", "let", "loop", "match", "new", "package", "print", "raise", "require", "return", "select", "switch", "throw", "try", "until", "use", "using", "var", "when", "while", "with", "yield",
)
_OPENER = re.compile(rf"(?:{'|'.join(_OPENERS)})\b")
_STATEMENT = re.compile(rf"(?:{'|'.join(_STATEMENTS)})\b")
_KEYWORD_DECLARATION = re.compile(r"(?:[\w()]+\s+)*(?:class|def|enum|fn|fun|func|function|impl|interface|mod|module|namespace|object|record|struct|sub|trait|union)\b")
_CALLABLE = re.compile(r"[\w$<>\[\],.:?*&~ ]*[\w$>\])*&]\s*\([^;]*\)?[^;=]*\{?\s*$|[\w$<>\[\],.:?*&~ ]*[\w$]\s*\([^;]*$")


class RangeMaximum:
    """Sparse table over ``values``: the position of the largest value in a
    window, the rightmost of equals, in constant time after n log n work."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.values = np.asarray(values)
        self.rows = [np.arange(n)]
        width = 1
        while 2 * width <= n:
            left, right = self.rows[-1][: n - 2 * width + 1], self.rows[-1][width : n - width + 1]
            self.rows.append(np.where(self.values[right] >= self.values[left], right, left))
            width *= 2

    def query(self, low: int, high: int) -> int:
        """Position of the maximum within ``low``..``high``, both included."""
        row = (high - low + 1).bit_length() - 1
        a, b = int(self.rows[row][low]), int(self.rows[row][high - (1 << row) + 1])
        return b if self.values[b] >= self.values[a] else a


def _indent(line: str) -> int:
    n = 0
    for ch in line:
        if ch == " ":
            n += 1
        elif ch == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def _declares(line: str) -> bool:
    text = line.strip()
    if _STATEMENT.match(text) and not _OPENER.match(text):
        return False
    if _KEYWORD_DECLARATION.match(text):
        return not text.endswith((";", ","))
    if text.endswith(("{", "(", ",", ")")) and "(" in text and "=" not in text.split("(")[0] and _CALLABLE.match(text):
        return text.endswith("{") and len(text.split("(")[0].split()) > 1
    return bool(_OPENER.match(text)) and text.endswith(("{", "(", ":"))


def strengths(lines: list[str], kind: str | None) -> np.ndarray:
    """Per line the strength of a cut before it: ``BLOCK`` and more at the start
    of a block (comments right above belong to it), 2 and more after a blank
    line, 0 within a paragraph, -1 inside a fenced block. Deeper lines are weaker."""
    n = len(lines)
    out = np.zeros(n, dtype=np.int64)
    indents = [_indent(x) for x in lines]
    fenced = False
    for i, line in enumerate(lines):
        blank = not line.strip()
        if kind == "Docs" and _FENCE.match(line):
            out[i] = -1 if fenced else (2 if i and not lines[i - 1].strip() else 0)
            fenced = not fenced
            continue
        if fenced:
            out[i] = -1
            continue
        if blank:
            continue
        if i and not lines[i - 1].strip():
            out[i] = max(2, 20 - indents[i])
        start = None
        if kind == "Docs":
            m = _HEADING.match(line)
            if m:
                start = BLOCK + 10 - line.count("#", 0, m.end())
        elif kind == "Config":
            if _SECTION.match(line):
                start = BLOCK + 10
            elif not _COMMENT.match(line) and _KEY.match(line.strip()) and _opens(lines, indents, i):
                start = BLOCK + 9 - min(9, indents[i] // 2)
        elif not _COMMENT.match(line) and _declares(line):
            start = BLOCK + 10 - min(10, (indents[i] + 1) // 2)
        if start is not None:
            top = i
            if kind != "Docs":
                while top and lines[top - 1].strip() and _COMMENT.match(lines[top - 1]) and indents[top - 1] == indents[i]:
                    top -= 1
            out[top] = max(out[top], start)
    return out


def _opens(lines: list[str], indents: list[int], i: int) -> bool:
    for k in range(i + 1, len(lines)):
        if lines[k].strip():
            return indents[k] > indents[i]
    return False


def cuts(strength: np.ndarray, most: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces (first, own, last, strength) of lines 0..n-1: ``own`` is where a
    piece's text begins after its overlap, and equals ``first`` in piece 0. A
    piece has at most ``most`` lines, overlap included; the overlap is clamped
    below ``most`` so that every piece moves on."""
    n, most = len(strength), max(1, most)
    overlap = min(max(0, overlap), most - 1)
    if n <= most:
        return [(0, 0, n - 1, 0)] if n else []
    index, pieces, own, first, found = RangeMaximum(strength), [], 0, 0, 0
    while n - first > most:
        cut = index.query(own + 1, first + most)
        pieces.append((first, own, cut - 1, found))
        found = int(strength[cut])
        first, own = max(first, cut - overlap), cut
    pieces.append((first, own, n - 1, found))
    return pieces


PIECES = "chunk_id long, piece int, start_line int, own_line int, end_line int, strength int"


def split_oversized(chunks: DataFrame, files: DataFrame, texts: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every chunk longer than the limit of its file's kind:
    (chunk_id, piece, start_line, own_line, end_line, strength), file lines.

    ``chunks`` (chunk_id, file_id, start_line, end_line), ``files`` (file_id,
    kind), ``texts`` (doc_id, file_id, text), ``limits`` (kind, max_lines,
    overlap_lines). Repeated chunk rows count once (the widest span). A file's
    kind is its largest non-null one; no kind or no limit means no splitting. Of
    several texts of a file the one with the lowest doc_id that isn't empty
    counts; without a text, or beyond its end, lines have no boundaries and are
    cut by length alone. Null ids or lines, and spans that end before they start, give no
    rows. ``strength`` is that of the cut a piece begins at, 0 for piece 0.

    Only oversized chunks meet texts, and only their lines travel on.
    """
    c = chunks.select("chunk_id", "file_id", "start_line", "end_line").where("chunk_id is not null and start_line >= 1 and end_line >= start_line")
    least = limits.agg(F.min("max_lines")).first()[0]
    c = c.where(F.col("end_line") - F.col("start_line") + 1 > (least if least is not None else 2**31 - 1))
    c = c.groupBy("chunk_id").agg(F.max(F.struct(F.col("end_line") - F.col("start_line"), "file_id", "start_line", "end_line")).alias("x")).select("chunk_id", "x.file_id", "x.start_line", "x.end_line")
    kinds = files.where("file_id is not null and kind is not null").select("file_id", "kind").join(c.select("file_id").distinct(), "file_id", "left_semi").groupBy("file_id").agg(F.max("kind").alias("kind"))
    rules = limits.where("kind is not null and max_lines > 0").groupBy("kind").agg(F.min("max_lines").alias("most"), F.max(F.coalesce("overlap_lines", F.lit(0))).alias("overlap"))
    over = c.join(kinds, "file_id").join(rules, "kind").where(F.col("end_line") - F.col("start_line") + 1 > F.col("most"))
    own = texts.select("doc_id", "file_id", "text").where("file_id is not null and text is not null and text <> ''")
    own = own.join(over.select("file_id").distinct(), "file_id", "left_semi").groupBy("file_id").agg(F.min_by("text", "doc_id").alias("text"))
    lines = F.slice(F.split("text", "\r?\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    rows = over.join(own, "file_id", "left").select("chunk_id", "kind", "start_line", "end_line", "most", "overlap", F.array_join(lines, "\n").alias("body"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                n = int(r.end_line) - int(r.start_line) + 1
                known = _LINES.split(r.body)[:n] if isinstance(r.body, str) else []
                s = np.zeros(n, dtype=np.int64)
                s[: len(known)] = strengths(known, r.kind)
                for k, (first, begin, last, strength) in enumerate(cuts(s, int(r.most), int(r.overlap))):
                    out.append((r.chunk_id, k, first + r.start_line, begin + r.start_line, last + r.start_line, strength))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PIECES.split(", ")])

    return rows.mapInPandas(pieces, PIECES)


def block_cuts(pieces: DataFrame) -> DataFrame:
    """(chunk_id, cut_line) of the chunks whose every cut fell between blocks."""
    whole = pieces.where("piece > 0").groupBy("chunk_id").agg(F.min("strength").alias("least"), F.collect_list("own_line").alias("cut"))
    return whole.where(F.col("least") >= BLOCK).select("chunk_id", F.explode("cut").alias("cut_line"))
