"""Best-fit packing by minimum bin slack: each bin takes the fullest combination of the lengths that are left.

1. Documents are tokenized once; pieces (at most ``limit`` tokens) are written as a narrow table that also numbers the
   pieces of each length inside the task that made them.
2. Only the number of pieces of each length matters for a plan, a table of at most ``limit`` rows. For each bin the
   longest piece left is fixed, a bitset subset-sum over the available lengths (with their multiplicities) finds the
   fullest feasible rest, and the combination is removed as often as its lengths allow. A round uses up at least one
   length, so the plan has a few thousand rounds at most, for any number of documents.
3. Pieces of one length are interchangeable: a piece's rank among them (its number in its task plus the pieces of the
   tasks before) picks the round, the bin and the place. A length that a third of all pieces share is spread over the
   tasks that made it; nothing is sorted or gathered.

Defined results: a null or empty text is the end token alone; documents that repeat an id are packed each; an empty table
gives no
rows; other columns do not matter. Word parts are tokenized apart, where the tokenizer splits in any case, and
remembered by a 64-bit hash, up to ``REMEMBER`` parts a worker.
"""

from __future__ import annotations

import os
import unicodedata
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.text import Flat, get, slices, span_hashes
from wardlight.session import written

LIMIT = 2048
END = 0
REMEMBER = 800_000


LETTER, DIGIT, MARK = 1, 2, 3  # 0: not to be cut beside
CLASS = np.zeros(0x540, dtype=np.uint8)
for _c in range(0x530):  # letters of long-settled blocks only; everything else stays whole and is left to the tokenizer
    if unicodedata.category(chr(_c))[0] == "L" and len(chr(_c).lower()) == 1:
        CLASS[_c] = LETTER
CLASS[0x30:0x3A] = DIGIT
CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = MARK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def parts_of(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Data in lower case and the places of word parts that the tokenizer splits in any case: letters, single digits, marks.

    The last array tells which parts are one unit to the tokenizer. A cut is made only between characters of known classes. Words with an apostrophe are not cut beside it, and words
    that hold ``<|`` (special tokens begin so) are neither cut nor lowered.
    """
    data = flat.data
    n = len(data)
    if not n:
        return data, flat.start, flat.end, np.empty(0, dtype=bool)
    nxt = np.append(data[1:], np.uint8(0))
    two = (data >= 0xC2) & (data <= 0xD4)
    cls = CLASS[np.where(data < 0x80, data, 0)]
    cls[two] = CLASS[np.minimum(((data[two].astype(np.int32) & 0x1F) << 6) | (nxt[two] & 0x3F), 0x53F)]
    tail = (data & 0xC0) == 0x80
    after = np.flatnonzero(tail)
    cls[after] = cls[after - 1]  # second bytes; third and fourth follow a lead of class 0
    deep = after[1:][np.diff(after) == 1]
    cls[deep] = 0
    whole = np.zeros(n, dtype=bool)
    for at in np.flatnonzero((data == 0x3C) & (nxt == 0x7C)):
        w = int(np.searchsorted(flat.start, at, "right")) - 1
        whole[flat.start[w] : flat.end[w]] = True
    cls[whole] = 0
    cut = np.zeros(n, dtype=bool)
    cut[1:] = (cls[1:] != 0) & (cls[:-1] != 0) & ~tail[1:] & flat.word[1:] & flat.word[:-1] & ((cls[1:] != cls[:-1]) | (cls[1:] == DIGIT))
    first, last = cut.copy(), np.append(cut[1:], False)
    first[flat.start] = True
    last[flat.end - 1] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    odd = np.concatenate(([0], np.cumsum(cls == 0)))
    return np.where(whole, data, LOWER[data]), start, end, odd[start] == odd[end]


class Coder:
    """Token ids of whole texts, each followed by the end token, with a bounded memory of word parts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        """Empty memory: sorted hashes of parts, and where their ids lie in one array."""
        self.keys = np.empty(0, dtype=np.uint64)
        self.at, self.size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
        self.store, self.used = np.empty(1 << 16, dtype="<u4"), 0

    def ids_of(self, words: list[bytes], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the parts, number of ids of each, all ids; parts of one unit share texts, where the unit's number
        tells their ids apart."""
        plain, rest = np.flatnonzero(unit), np.flatnonzero(~unit)
        sizes, ids = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype="<u4")]
        for j in range(0, len(plain), 200):
            some = plain[j : j + 200]
            code = self.tokenizer.encode(" ".join([words[k].decode() for k in some]), add_special_tokens=False)
            ids.append(np.array(code.ids, dtype="<u4"))
            sizes.append(np.bincount(np.array(code.word_ids, dtype=np.int64), minlength=len(some)))
        for code in self.tokenizer.encode_batch([words[k].decode() for k in rest], add_special_tokens=False):
            ids.append(np.array(code.ids, dtype="<u4"))
            sizes.append(np.array([len(ids[-1])]))
        return np.concatenate((plain, rest)), np.concatenate(sizes), np.concatenate(ids)

    def learn(self, keys: np.ndarray, words: list[bytes], unit: np.ndarray) -> None:
        order, size, ids = self.ids_of(words, unit)
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate((self.store, np.empty_like(self.store)))
        self.store[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(size) - size
        self.used += len(ids)
        rank = np.argsort(keys[order])
        keys = keys[order][rank]
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, at[rank])
        self.size = np.insert(self.size, place, size[rank])

    def encode(self, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
        """All ids laid end to end (little-endian unsigned 32-bit) and where each text starts."""
        data, start, end, unit = parts_of(flat)
        h, first, back = np.unique(span_hashes(data, start, end, 6), return_index=True, return_inverse=True)
        if len(self.keys) + len(h) > REMEMBER:
            self.forget()
        new = np.flatnonzero(~np.isin(h, self.keys, assume_unique=True))
        raw = data.tobytes()
        at = first[new]
        self.learn(h[new], [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], unit[at])
        slot = np.searchsorted(self.keys, h)
        n = self.size[slot].astype(np.int64)[back]
        total = int(n.sum())
        run = np.cumsum(n)
        doc = np.searchsorted(flat.off, start, "right") - 1
        out = np.full(total + flat.n, END, dtype="<u4")
        source = np.repeat(self.at[slot][back] - (run - n), n) + np.arange(total)
        out[np.arange(total) + np.repeat(doc, n)] = self.store[source]
        run = np.concatenate(([0], run))
        return out, run[np.searchsorted(start, flat.off)] + np.arange(flat.n + 1)


@lru_cache(maxsize=1)
def coder_of(path: str) -> Coder:
    """One coder for each Python worker, so that its memory serves all tasks there."""
    return Coder(path)


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: id, piece, start, length, ids_crc32, the task's number and the piece's number in it."""

    def cut(batches):
        coder, task, seen = coder_of(tokenizer), uuid.uuid4().int >> 65, np.zeros(limit + 1, dtype=np.int64)
        for part in slices(batches, "_t"):
            ids, off = coder.encode(Flat(get(part, "_t")))
            n = np.diff(off)
            parts = -(-n // limit)
            doc = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * limit
            length = np.minimum(limit, n[doc] - start)
            a = off[doc] + start
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            edge = np.flatnonzero(np.diff(ranked, prepend=-1))
            nth = np.empty(len(order), dtype=np.int64)
            nth[order] = np.arange(len(order)) - np.repeat(edge, np.diff(np.append(edge, len(order)))) + seen[ranked]
            seen += np.bincount(length, minlength=limit + 1)
            columns = [get(part, "_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task)), pa.array(nth)]
            names = ["_id", "piece", "start", "length", "ids_crc32", "_task", "_nth"]
            if with_ids:
                columns.append(pa.array([ids[x:y].astype(np.int32).tolist() for x, y in zip(a, a + length, strict=True)], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = f"_id {kind}, piece int, start long, length long, ids_crc32 long, _task long, _nth long" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(cut, out)


def fullest(capacity: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The combination of ``lengths`` (descending), each at most ``counts`` times, with the largest sum up to ``capacity``."""
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in lengths:
        left = min(counts[length], capacity // length)
        if left <= 0:
            continue
        steps.append((length, reach))
        size = 1
        while left:
            size = min(size, left)
            reach |= (reach << (length * size)) & mask
            left -= size
            size *= 2
        if reach >> capacity & 1:
            break
    rest, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> rest & 1:
            rest -= length
            used[length] = used.get(length, 0) + 1
    return used


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, dict[int, int]]]:
    """(bins, lengths in each) in order; ``histogram`` has the number of pieces of each length."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        used = fullest(limit - longest, lengths, counts)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[k] // m for k, m in used.items())
        for k, m in used.items():
            counts[k] -= m * times
        lengths = [k for k in lengths if counts[k]]
        out.append((times, used))
    return out


def best_fit_packing(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece with ``sequence_id`` and ``offset``; ``with_ids`` adds the token ids."""
    rows = written(pieces(docs, tokenizer, limit, id_col, text_col, with_ids), "pieces")
    by_task = rows.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    starts = by_task.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))

    span = 1 << 50  # more than the pieces of one length
    key, base, many, place = [], [], [], []
    taken: dict[int, int] = {}
    bins = 0
    for times, used in plan(histogram, limit):
        at = 0
        for length, m in sorted(used.items(), reverse=True):
            key.append(length * span + taken.get(length, 0))
            base.append(bins)
            many.append(m)
            place.append(at)
            taken[length] = taken.get(length, 0) + m * times
            at += length * m
        bins += times
    order = np.argsort(np.array(key, dtype=np.int64))
    key, base, many, place = (np.array(x, dtype=np.int64)[order] for x in (key, base, many, place))

    def put(batches):
        for part in batches:
            length, rank = (get(part, c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            k = np.searchsorted(key, length * span + rank, "right") - 1
            inside = length * span + rank - key[k] if len(k) else rank
            keep = part.drop_columns(["_rank"])
            columns = [*keep.columns, pa.array(base[k] + inside // many[k]), pa.array(place[k] + inside % many[k] * length)]
            yield pa.record_batch(columns, [*keep.schema.names, "sequence_id", "offset"])

    ranked = rows.join(starts, ["_task", "length"]).withColumn("_rank", F.col("_start") + F.col("_nth")).drop("_task", "_start", "_nth")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(put, out + ", sequence_id long, offset long").withColumnRenamed("_id", id_col)
