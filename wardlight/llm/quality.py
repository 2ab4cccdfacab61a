"""Quality rules: gradient-boosted trees over whole-text statistics, with monotonic constraints on chosen ones.

The base rules reject texts of fewer than 50 words and texts where more than half of the words lie in a repeated
three-word window. What passes is scored by boosted trees (``boosting``) fitted to the ``quality`` labels. The score can
only fall with the shares of symbols, repeated words, repeated lines and capitals, so no document is saved by more of them.

The trees are fitted on the driver from at most ``sample`` labelled rows (those with the smallest hash of their id); every
document is counted and scored in full. Defined results: a null text has no words and fails the base rules; without
usable labels the trees keep everything; a document labelled twice counts twice; null ids and null labels are not used
for fitting; other columns do not matter and are passed through by ``quality_filter``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.boosting import Trees, constant, fit
from wardlight.llm.text import Flat, get, mix, rolling, slices, span_hashes

SAMPLE = 20_000
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbol_share", "repeat_share", "dup_line_share", "upper_share", "digit_share", "punct_share", "word_length", "log_words", "line_words", "bang_share"]
MONOTONE = np.array([-1, -1, -1, -1, 0, 0, 0, 0, 0, -1])


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


LEAD = np.ones(256, dtype=bool)
LEAD[0x80:0xC0] = False
IS_SYMBOL, IS_UPPER, IS_LOWER = table(SYMBOLS), table(bytes(range(65, 91))), table(bytes(range(97, 123)))
IS_DIGIT, IS_PUNCT, IS_BANG = table(b"0123456789"), table(b".,;:'\"()-?"), table(b"!")


def repeats(key: np.ndarray) -> np.ndarray:
    """True at every item of ``key`` that equals another item."""
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(key), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit


def measure(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts (texts x COUNTS, whole numbers) and features (texts x FEATURES) of a slice of texts."""
    flat = Flat(column)
    data, off = flat.data, flat.off
    h = flat.words(1)
    chars = flat.per_text(flat.word & LEAD[data])
    symbols = flat.per_text(IS_SYMBOL[data])

    # lines: cut at \n and at text ends; a line counts when it holds a word
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    stop = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate((off[:-1], stop + 1)))
    begin = begin[begin < len(data)]
    finish = np.concatenate((begin[1:], [len(data)]))[: len(begin)]
    finish = finish - ((finish > begin) & (data[np.maximum(finish - 1, 0)] == 10))
    holds = np.searchsorted(flat.start, finish) > np.searchsorted(flat.start, begin)
    begin, finish = begin[holds], finish[holds]
    owner = np.searchsorted(off, begin, "right") - 1
    key = np.unique(span_hashes(data, begin, finish, 3) ^ mix(owner.astype(np.uint64)), return_index=True)[1]
    n_lines = np.bincount(owner, minlength=flat.n)
    dup_lines = n_lines - np.bincount(owner[key], minlength=flat.n)

    # words inside three-word windows that occur twice or more in their text
    hit = np.zeros(len(h), dtype=bool)
    w = rolling(h, 3, 4)
    at = np.flatnonzero(flat.inside(3)) if len(w) else np.empty(0, dtype=np.int64)
    at = at[repeats(w[at] ^ mix(flat.doc[at].astype(np.uint64)))] if len(at) else at
    for k in range(3):
        hit[at + k] = True
    repeated = np.bincount(flat.doc[hit], minlength=flat.n)

    counts = np.stack([flat.counts, chars, symbols, dup_lines, repeated], axis=1).astype(np.int64)
    n, c = np.maximum(flat.counts, 1), np.maximum(chars, 1)
    upper, lower = flat.per_text(IS_UPPER[data]), flat.per_text(IS_LOWER[data])
    feature = np.stack([
        symbols / c, repeated / n, dup_lines / np.maximum(n_lines, 1), upper / np.maximum(upper + lower, 1), flat.per_text(IS_DIGIT[data]) / c,
        flat.per_text(IS_PUNCT[data]) / c, chars / n, np.log1p(flat.counts), flat.counts / np.maximum(n_lines, 1), flat.per_text(IS_BANG[data]) / c,
    ], axis=1)
    return counts, feature


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Trees:
    """Trees fitted to the labelled documents that pass the base rules; the sample is bounded, so is the broadcast of its ids."""
    some = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("_y"))
    some = some.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(some), "_id")

    def features(batches):
        for part in slices(batches, "_t"):
            counts, x = measure(get(part, "_t"))
            use = np.flatnonzero(~base_failed(counts))
            columns = [pa.array(x[use, k]) for k in range(x.shape[1])]
            yield pa.record_batch([get(part, "_y").take(pa.array(use)), *columns], ["_y", *FEATURES])

    got = rows.select("_t", "_y").mapInArrow(features, "_y int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow().to_pandas()
    got = got.sort_values(["_y", *FEATURES])  # the order of tasks must not matter
    y = (got["_y"].to_numpy() > 0).astype(float)
    return fit(got[FEATURES].to_numpy(), y, MONOTONE) if len(y) else constant(1.0)


def quality_rules(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, the counts, ``base_failed``, ``score`` (log-odds of good) and ``kept``."""

    def score(batches):
        for part in slices(batches, "_t"):
            counts, x = measure(get(part, "_t"))
            bad, odds = base_failed(counts), model.score(x)
            columns = [pa.array(counts[:, k]) for k in range(counts.shape[1])]
            yield pa.record_batch([get(part, "_id"), *columns, pa.array(bad), pa.array(odds), pa.array(~bad & (odds >= 0))], ["_id", *COUNTS, "base_failed", "score", "kept"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = f"_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return rows.mapInArrow(score, out).withColumnRenamed("_id", id_col)


def quality_filter(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; a row-local filter without a join."""

    def passing(batches):
        for part in slices(batches, text_col):
            counts, x = measure(get(part, text_col))
            yield part.filter(pa.array(~base_failed(counts) & (model.score(x) >= 0)))

    return docs.mapInArrow(passing, docs.schema)
