"""Substring dedup: a merged count-min sketch finds the windows that may repeat, an exact second pass groups only these.

A window is ``window`` consecutive words of one document. Sketching every window would need a counter per word of the
corpus, so the sketch counts anchors: the anchor of a window is the smallest hash among its grams of ``window // 2``
words. Equal windows have equal anchors, so the number of documents holding an anchor is never less than the number
holding the window, and the sketch, which never undercounts, overestimates it again: no repeated window is lost.
Neighbouring windows share anchors, which leaves about one anchor for 13 windows.

1. Each task counts its anchors (once per document) in the cells of a ``depth x 2**bits`` sketch, of which it keeps the
   cells it met; the sketches are summed cell by cell in a shuffle. Cells reached by two documents become a bitmap of
   ``depth * 2**bits`` bits (16 MB with the defaults), the only thing that is broadcast. More cells filter better; fewer cost only time, never results.
2. Windows whose cells are all set are grouped exactly by a 96-bit hash of their words to find the first document that
   holds them. Copies in later documents become removals.

Defined results: null or wordless texts keep nothing and lose nothing; documents shorter than a window lose nothing;
rows with a null id are kept whole and do not count as earlier documents; repeated rows of one id never remove each
other; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.text import Flat, get, mix, rolling, signed, slices
from wardlight.session import written

WINDOW = 50
BITS = 26
DEPTH = 2
TOUCHED = 26


def anchors(flat: Flat, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hash of every window, and which windows lie within one document."""
    gram = (window + 1) // 2
    g = rolling(h, gram, 11)
    width = window - gram + 1
    if len(g) < width:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
    low = g[: len(g) - width + 1].copy()
    for k in range(1, width):
        np.minimum(low, g[k : k + len(low)], out=low)
    return mix(low), flat.inside(window)


def cells(anchor: np.ndarray, bits: int, depth: int) -> list[np.ndarray]:
    """One cell per sketch row; rows use different bits of the hash, mixed again beyond the second."""
    out, mask = [], np.uint64((1 << bits) - 1)
    for d in range(depth):
        out.append(((anchor >> np.uint64(32 * (d % 2))) & mask).astype(np.int64) + (d << bits))
        if d % 2:
            anchor = mix(anchor + np.uint64(d))
    return out


def sketch(docs: DataFrame, window: int, bits: int, depth: int) -> DataFrame:
    """Cells (counted from 0) whose merged count is two documents or more."""

    def merged(held):
        at, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
        return at, np.minimum(n, 2)

    def count(batches):
        held, size = [], 0  # cells, each as often as it was counted, twice at most after a merge
        for part in slices(batches, "_t"):
            flat = Flat(get(part, "_t"))
            a, ok = anchors(flat, flat.words(1), window)
            a, doc = a[ok], flat.doc[: len(ok)][ok]
            if not len(a):
                continue
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
            a, doc = a[new], doc[new]
            a = a[np.unique(a ^ mix(doc.astype(np.uint64)), return_index=True)[1]]
            held += cells(a, bits, depth)
            size += depth * len(a)
            if size > 2_000_000:
                held = [np.repeat(*merged(held))]
                size = len(held[0]) // 2
        at, n = merged(held)
        for k in range(0, len(at), 100_000):
            yield pa.record_batch([pa.array(at[k : k + 100_000]), pa.array(n[k : k + 100_000].astype(np.int32))], ["cell", "n"])

    return docs.select("_t").mapInArrow(count, "cell long, n int").groupBy("cell").agg(F.sum("n").alias("n")).filter("n >= 2").select("cell")


def bitmap(hot: DataFrame, size: int) -> np.ndarray:
    """The cells (0 to ``size`` - 1) as one packed bit array; its length depends on ``size`` only."""
    at = F.col("cell") + 1
    rows = hot.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
    out = np.zeros((max(1, size >> 15), 4096), dtype=np.uint8)
    for k, m in rows.toLocalIterator():
        out[k - 1, : len(m)] = np.frombuffer(m, dtype=np.uint8)
    return out.reshape(-1)


def is_set(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return ((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(bool)


def candidates(docs: DataFrame, window: int, bits: int, depth: int) -> DataFrame:
    """(a, b, _id, _k, pos): hashes and places of the windows that the sketch cannot rule out."""
    spark = docs.sparkSession
    seen = spark.sparkContext.broadcast(bitmap(sketch(docs, window, bits, depth), depth << bits))

    def emit(batches):
        hot = seen.value
        for part in slices(batches, "_t"):
            flat = Flat(get(part, "_t"))
            h = flat.words(1)
            a, ok = anchors(flat, h, window)
            at = np.flatnonzero(ok)
            for cell in cells(a[at], bits, depth) if len(at) else []:
                ok[at[~is_set(hot, cell)]] = False
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            one = rolling(h, window, 12)[at]
            two = (rolling(flat.words(2), window, 13)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            doc = pa.array(flat.doc[at])
            pos = pa.array((at - flat.first[flat.doc[at]]).astype(np.int32))
            yield pa.record_batch([signed(one), pa.array(two), get(part, "_id").take(doc), get(part, "_k").take(doc), pos], ["a", "b", "_id", "_k", "pos"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(emit, f"a long, b int, _id {kind}, _k long, pos int")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bits: int = BITS, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed`` and ``text``, the kept words joined by one space."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).withColumn("_k", F.xxhash64("_t"))
    wins = candidates(rows.filter("_id is not null and _t is not null"), window, bits, depth)
    first = wins.groupBy("a", "b").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).filter("lo < hi").drop("hi")
    first = written(first, "first")  # a plain table on this side lets adaptive execution split a hot window of the other
    gone = written(wins.join(first, ["a", "b"]).filter("_id > lo").groupBy("_id", "_k").agg(F.collect_set("pos").alias("pos")), "gone")

    # a bitmap of fixed size tells most untouched documents, which then skip the join and its shuffle of texts
    cell = F.pmod(F.xxhash64("_id", "_k"), F.lit(1 << TOUCHED))
    seen = docs.sparkSession.sparkContext.broadcast(bitmap(gone.select(cell.alias("cell")), 1 << TOUCHED))

    @F.pandas_udf("boolean")
    def touched(at: pd.Series) -> pd.Series:
        return pd.Series(is_set(seen.value, at.to_numpy()))

    marked = rows.withColumn("_touched", touched(cell))
    same = marked.filter(~F.col("_touched")).select("_id", "_t", F.lit(None).cast("array<int>").alias("pos"))
    both = marked.filter("_touched").join(gone.hint("shuffle_hash"), ["_id", "_k"], "left").select("_id", "_t", "pos").union(same)

    def cut(batches):
        for part in slices(batches, "_t"):
            n, lost, kept = [], [], []
            for text, pos in zip(get(part, "_t").to_pylist(), get(part, "pos")):
                words = (text or "").encode().split()
                n.append(len(words))
                lost.append(0)
                if pos.is_valid:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    at = pos.values.to_numpy()
                    edge[at] += 1
                    edge[at + window] -= 1
                    stay = np.cumsum(edge)[:-1] == 0
                    lost[-1] = len(words) - int(stay.sum())
                    words = [words[k] for k in np.flatnonzero(stay)]
                kept.append(b" ".join(words).decode())
            yield pa.record_batch([get(part, "_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], ["_id", "n_words", "n_removed", "text"])

    kind = rows.schema["_id"].dataType.simpleString()
    return both.mapInArrow(cut, f"_id {kind}, n_words long, n_removed long, text string").withColumnRenamed("_id", id_col)
