"""Whole-batch numpy work on text columns: words, spans, rolling hashes.

A word is a run of characters other than space, tab and the four line controls (``[^\\x20\\x09-\\x0D]+``). All functions
work on the UTF-8 bytes of an Arrow string column, so one call serves thousands of documents without a loop per word.
Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BLOCK = 1 << 18
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (two multiply-xorshift rounds)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


NEAR = 64
_TABLES: dict[int, np.ndarray] = {}


def place_table(seed: int) -> np.ndarray:
    """A random 64-bit value for each (place below ``NEAR``, byte)."""
    if seed not in _TABLES:
        _TABLES[seed] = mix(np.arange(NEAR << 8, dtype=U) + salt(seed))
    return _TABLES[seed]


def salt(seed: int) -> np.uint64:
    return mix(np.array([(seed + 1) << 48], dtype=U))[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each ``data[start:end]``; spans are sorted and disjoint, and hashed in blocks of bounded size.

    Every byte counts with a value mixed from itself and its place, so no byte patterns cancel as they do in polynomials
    modulo a power of two.
    """
    table = place_table(seed)
    out = np.empty(len(start), dtype=U)
    k = 0
    while k < len(start):
        j = max(int(np.searchsorted(end, start[k] + BLOCK, "right")), k + 1)
        seg = data[start[k] : end[j - 1]]
        s, e = start[k:j] - start[k], end[k:j] - start[k]
        begin = np.zeros(len(seg), dtype=np.int64)
        begin[s[e > s]] = s[e > s]
        cell = ((np.arange(len(seg)) - np.maximum.accumulate(begin)) << 8) | seg
        far = np.flatnonzero(cell >= len(table))
        value = table[np.minimum(cell, len(table) - 1)]
        value[far] = mix(cell[far].astype(U) + salt(seed))
        run = np.zeros(len(seg) + 1, dtype=U)
        np.cumsum(value, out=run[1:])
        out[k:j] = run[e] - run[s]
        k = j
    return mix(out ^ ((end - start).astype(U) * U(0x9E3779B97F4A7C15)))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbours from their hashes; order matters."""
    return mix(a * U(0x9E3779B97F4A7C15) + b)


def rolling(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each ``k`` consecutive items of ``h``; length ``len(h) - k + 1`` (empty when shorter).

    Windows are put together from mixed halves, quarters and so on, so a window costs as many steps as ``k`` has bits.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U)
    level, width, done, at = mix(h ^ salt(seed)), 1, None, 0
    while True:
        if k & width:
            part = level[at : at + n]
            done = part if done is None else joined(done, part)
            at += width
        if at == k:
            return done
        level = joined(level[:-width], level[width:])
        width *= 2


def sequences(h: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each ``h[first[i]:first[i + 1]]``, sequences of any length."""
    size = np.diff(first)
    place = np.arange(len(h)) - np.repeat(first[:-1], size)
    run = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(mix(h ^ mix(place.astype(U) + salt(seed))), out=run[1:])
    return mix((run[first[1:]] - run[first[:-1]]) + size.astype(U))


class Flat:
    """Bytes and word spans of a slice of texts laid end to end; ``spaces`` marks the bytes between words."""

    def __init__(self, column: pa.Array, spaces: np.ndarray = SPACE):
        column = column.fill_null("") if column.null_count else column
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        n = len(column)
        bufs = column.buffers()
        off = np.frombuffer(bufs[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
        self.n = n
        self.data = data[off[0] : off[-1]]
        self.off = off - off[0]
        gap = spaces[self.data]
        cut = np.zeros(len(self.data) + 1, dtype=bool)
        cut[self.off] = True
        word = ~gap
        first, last = word.copy(), word.copy()
        first[1:] &= gap[:-1] | cut[1:-1]
        last[:-1] &= gap[1:] | cut[1:-1]
        self.word = word
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.off)  # words of text i: first[i] to first[i + 1]
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)

    def words(self, seed: int) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, seed)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of true bytes of each text."""
        run = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=run[1:])
        return run[self.off[1:]] - run[self.off[:-1]]

    def inside(self, k: int) -> np.ndarray:
        """For each window of ``k`` words: whether it lies within one text."""
        n = len(self.doc) - k + 1
        return self.doc[:n] == self.doc[k - 1 :] if n > 0 else np.empty(0, dtype=bool)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of at most ``limit`` bytes of text (a longer text comes alone): bounds numpy memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        size = np.frombuffer(text.buffers()[1], dtype=np.int64 if pa.types.is_large_string(text.type) else np.int32)
        ends = size[text.offset : text.offset + len(text) + 1].astype(np.int64)
        k = 0
        while k < len(text):
            j = max(int(np.searchsorted(ends, ends[k] + limit, "right")) - 1, k + 1)
            yield batch.slice(k, j - k)
            k = j


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python workers in batches of at most ``rows``: buffers on both sides grow with the texts in a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def get(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
