"""Cutting a text into chunks along its indentation.

A *block* opens at the base indentation after a blank line or after a closing
line. Small blocks are packed into chunks of 12 lines or more; a block over 80
lines is cut again one level deeper, four levels at most; what falls into no
blocks is cut into overlapping windows of 60 lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from siftwell.session import spread

MIN_LINES, MAX_LINES, WINDOW, STRIDE, MAX_DEPTH = 12, 80, 60, 50, 4
_BREAK = re.compile(r"\r?\n")
_NEVER = 1 << 30


def text_lines(text: str) -> list[str]:
    """Lines of a text; a last line end opens no line, empty text has none."""
    if not text:
        return []
    out = _BREAK.split(text)
    return out[:-1] if out[-1] == "" else out


class Layout:
    """What the cut needs of a text, as arrays over its lines: ``depth`` of the
    lines that can open a block (others lie beyond any base), ``needs`` the least
    base at which the line above lets a block open, and for each place the next
    and the last written line."""

    def __init__(self, lines: list[str]) -> None:
        n = len(lines)
        depth, needs = np.full(n + 1, _NEVER), np.full(n + 1, _NEVER)
        written = np.zeros(n, dtype=bool)
        above = _NEVER
        for i, line in enumerate(lines):
            body = line.lstrip()
            needs[i] = above
            if not body:
                above = -1
                continue
            written[i] = True
            margin = line[: len(line) - len(body)]
            width = len(margin) + 3 * margin.count("\t")
            closes = body[0] in "})]" or (body[0] == "e" and body.rstrip() == "end")
            above = width if closes else _NEVER
            if not closes:
                depth[i] = width
        at = np.where(written, np.arange(n), n)
        self.depth, self.needs = depth[:n], needs[:n]
        self.next = np.minimum.accumulate(at[::-1])[::-1] if n else at
        self.last = np.maximum.accumulate(np.where(written, np.arange(n), -1)) if n else at

    def blocks(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the blocks in lines lo..hi-1, without blank edges."""
        depth = self.depth[lo:hi]
        base = depth.min()
        opens = (depth == base) & (self.needs[lo:hi] <= base) if base < _NEVER else np.zeros(hi - lo, dtype=bool)
        opens[0] = True
        at = lo + np.flatnonzero(opens)
        starts, ends = self.next[at], self.last[np.append(at[1:], hi) - 1] + 1
        kept = starts < ends
        return starts[kept], ends[kept]


def _windows(lo: int, hi: int) -> list[tuple[int, int]]:
    if hi - lo <= MAX_LINES:
        return [(lo, hi)]
    return [(s, min(s + WINDOW, hi)) for s in range(lo, hi - WINDOW + STRIDE, STRIDE)]


def _cut(layout: Layout, lo: int, hi: int, level: int) -> list[tuple[int, int]]:
    starts, ends = layout.blocks(lo, hi)
    if len(starts) == 0:
        return []
    if len(starts) == 1:
        return _windows(int(starts[0]), int(ends[0]))
    large = np.flatnonzero(ends - starts > MAX_LINES) if level < MAX_DEPTH else np.empty(0, dtype=int)
    out: list[tuple[int, int]] = []
    for k, stop in zip(np.append(-1, large), np.append(large, len(starts))):
        if k >= 0:  # a large block, then the small ones up to the next
            inner = _cut(layout, int(starts[k]) + 1, int(ends[k]), level + 1) or [(0, int(ends[k]))]
            out += [(int(starts[k]), inner[0][1]), *inner[1:]]
        k += 1
        while k < stop:
            full = k + int(np.searchsorted(ends[k:stop], starts[k] + MIN_LINES))
            chunk = int(starts[k]), int(ends[min(full, stop - 1)])
            short = full >= len(starts) and chunk[1] - chunk[0] < MIN_LINES // 2
            if short and out and out[-1][1] <= chunk[0] and out[-1][1] - out[-1][0] < MAX_LINES:
                out[-1] = out[-1][0], chunk[1]
            else:
                out.append(chunk)
            k = full + 1
    return out


def spans(lines: list[str]) -> list[tuple[int, int]]:
    """Chunks of ``lines`` as (first, last) line numbers from 1, both included."""
    return [(a + 1, b) for a, b in _cut(Layout(lines), 0, len(lines), 0)] if lines else []


def chunk_spans(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ord, start_line, end_line): the chunks of each text, in order.
    Null and blank texts have none."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, ord int, start_line int, end_line int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, a, b) for k, t in zip(pdf[key], pdf[text]) if isinstance(t, str) for i, (a, b) in enumerate(spans(text_lines(t)))]
            yield pd.DataFrame(out, columns=[key, "ord", "start_line", "end_line"])

    return spread(docs.where(f"{key} is not null and {text} is not null").select(key, text)).mapInPandas(run, schema)
