"""Encoding text with a public byte-level BPE vocabulary.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token
that is itself a vocabulary entry; a pre-token that is not is merged with a heap
over a linked list of its bytes. The vocabulary file is a parameter; its size is
fixed, which bounds what is broadcast. Each worker also remembers the pre-tokens
it has met, up to a fixed number, so a repeated word costs one dictionary
look-up; the memory never changes a result.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from siftwell.session import spread

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pre-token pattern that byte-level BPE vocabularies of this family share.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRE = regex.compile(PATTERN)
# The same split for the faster library, which has no \p: equal wherever _UNSURE characters are absent.
_FAST = re.compile(r" ?[^\W\d_]+|'(?:[sdmt]|ll|ve|re)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# White space and numerals on which the two libraries, or their classes, need not agree.
_UNSURE = frozenset("\x1c\x1d\x1e\x1f\x85\u180e") | {c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "N"}
REMEMBERED = 300_000


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens by id from a ``token-in-base64 rank`` file with ranks 0..n-1."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash over fixed keys, by hash and displace: each of n
    keys gets its own slot of n. Keys fall into buckets; buckets are placed
    largest first, each with the first displacement that hits free slots only."""

    def __init__(self, keys: Sequence[bytes]) -> None:
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(set(h.tolist())) != n:
            raise ValueError("keys must differ")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.slots = np.full(n, -1, dtype=np.int64)
        used = bytearray(n)
        free = 0
        for b in sorted(range(self.buckets), key=lambda b: starts[b] - starts[b + 1]):
            members = order[starts[b] : starts[b + 1]]
            if not len(members):
                break
            a = [(int(h[m]) >> 20) % n for m in members]
            if len(members) == 1:  # a single key takes the next free slot
                while used[free]:
                    free += 1
                self.shift[b], slots = -1 - free, [free]
            else:
                step = [1 + (int(h[m]) >> 44) % (n - 1) for m in members]
                d = 0
                while True:
                    slots = [(x + (d >> 8) * y + (d & 255) * 7919) % n for x, y in zip(a, step)]
                    if len(set(slots)) == len(slots) and not any(used[s] for s in slots):
                        break
                    d += 1
                self.shift[b] = d
            for m, s in zip(members, slots):
                used[s] = 1
                self.slots[s] = m
        self.shift, self.slots = self.shift.tolist(), self.slots.tolist()

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        if d < 0:
            return -1 - d
        return ((h >> 20) % self.n + (d >> 8) * (1 + (h >> 44) % (self.n - 1)) + (d & 255) * 7919) % self.n


class Encoder:
    """Byte-level BPE over ``tokens`` (by id; the id is also the merge rank)."""

    def __init__(self, tokens: Sequence[bytes]) -> None:
        self.hash = PerfectHash(tokens)
        self.keys = [tokens[i] for i in self.hash.slots]
        self.ids = self.hash.slots
        self.words, self.ranks = _Memory(self.word), _Memory(self.lookup)

    def __reduce__(self):
        return _revive, (self.hash, self.keys)

    def lookup(self, token: bytes) -> int:
        """The id of a vocabulary entry, or -1."""
        s = self.hash.slot(token)
        return self.ids[s] if self.keys[s] == token else -1

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary: repeatedly merge the
        neighbours whose union has the lowest rank, the leftmost of equals."""
        n, ranks = len(token), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks[token[i : i + 2]]) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if end[i] != middle or end[middle] != stop:
                continue
            end[i], after[i] = stop, after[middle]
            end[middle] = -1
            j = after[i]
            if j < n:
                before[j] = i
                if (rank := ranks[token[i : end[j]]]) >= 0:
                    heapq.heappush(heap, (rank, i, stop, end[j]))
            j = before[i]
            if j >= 0 and (rank := ranks[token[j:stop]]) >= 0:
                heapq.heappush(heap, (rank, j, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : end[i]]])
            i = after[i]
        return out

    def word(self, token: str) -> tuple[int, ...]:
        """Ids of one pre-token: the perfect hash first, then the merge."""
        b = token.encode("utf-8")
        i = self.lookup(b)
        return (i,) if i >= 0 else tuple(self.merge(b))

    def words_of(self, text: str | None) -> Iterator[tuple[int, ...]]:
        """Ids of the text, pre-token by pre-token."""
        if not text:
            return iter(())
        split = _FAST if _UNSURE.isdisjoint(text) else _PRE
        return map(self.words.__getitem__, split.findall(text))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.words_of(text)))


class _Memory(dict):
    """Results by text, emptied when full; long texts aren't kept."""

    def __init__(self, compute: Callable) -> None:
        self.compute = compute

    def __missing__(self, key):
        made = self.compute(key)
        if len(key) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = made
        return made


def _revive(hash_: PerfectHash, keys: list[bytes]) -> Encoder:
    e = Encoder.__new__(Encoder)
    e.hash, e.keys, e.ids = hash_, keys, hash_.slots
    e.words, e.ranks = _Memory(e.word), _Memory(e.lookup)
    return e


_built: dict[str, Encoder] = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    return os.path.join(TOKENIZERS, name)


def _shared_encoder(spark: SparkSession, path: str):
    if path not in _built:
        _built[path] = Encoder(read_vocabulary(path))
    return spark.sparkContext.broadcast(_built[path])


def _mapped(df: DataFrame, text: str, out: str, path: str, count: bool) -> DataFrame:
    rest = [f for f in df.schema.fields if f.name not in (text, out)]
    kind = T.LongType() if count else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*rest, T.StructField(out, kind, False)])
    shared = _shared_encoder(df.sparkSession, path)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            texts = batch.column(text)
            keep = [batch.column(f.name) for f in rest]
            if count:
                made = pa.array([sum(map(len, encoder.words_of(t.as_py()))) for t in texts], type=pa.int64())
                yield pa.RecordBatch.from_arrays([*keep, made], names=names)
                continue
            at, step = 0, 256
            while at < len(texts):  # small batches: ids take far more room than text
                rows = [np.fromiter(chain.from_iterable(encoder.words_of(t.as_py())), dtype=np.int32) for t in texts.slice(at, step)]
                offsets = np.zeros(len(rows) + 1, dtype=np.int32)
                np.cumsum([len(r) for r in rows], out=offsets[1:])
                values = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([*[k.slice(at, step) for k in keep], made], names=names)
                at += step

    return spread(df).mapInArrow(run, schema)


def encode_column(df: DataFrame, text: str, out: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``text`` replaced by ``out``, its token ids (array<int>)
    without special tokens, whose spellings count as ordinary text. A column that is
    already named ``out`` is replaced. Null and
    empty texts give an empty list; other columns pass unchanged. One narrow
    pass, no shuffle. ``path`` is a vocabulary file of ranks."""
    return _mapped(df, text, out, path or vocabulary_path(), False)


def count_tokens(df: DataFrame, text: str, out: str = "tokens", path: str | None = None) -> DataFrame:
    """As :func:`encode_column`, but ``out`` is the number of tokens (long)."""
    return _mapped(df, text, out, path or vocabulary_path(), True)
