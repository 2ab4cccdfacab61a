"""Ranked lexical search with geometric blocks in every posting list and exact bounds.

1. The terms of all query items are collected in parts of at most ``ITEM_TERMS`` terms (hashed by item; an item of more is a
   part of its own), and everything below is done for each part: a query set against all rows, in blocks.
2. One pass over the texts keeps what the part's terms need: the number of terms of a text and its own counts of these
   terms. This forward table is written; the numbers of documents, of terms and of documents by term come from it.
3. Documents are indexed in shards of bounded size where they lie. In a shard every term's posting list is clustered: some
   of its documents are drawn as centres, each document joins the centre to which its vector of term scores is most
   alike (by a random projection), and clusters are cut into blocks of ``BLOCK`` documents. A block stores the
   coordinatewise maximum of the vectors of its documents, over all terms of the part.
4. An item keeps its best documents so far; the score of the last of them is the mark to reach. Lists that cannot reach it
   even together (the sum of their largest entries) are left out, the blocks of the others are taken by falling bound
   (item times block maximum), and a block is skipped only when its bound lies below the mark, so no result is lost.
   Bounds and scores are whole numbers and exact.
5. Each task passes on the best of its shards, ``top`` rows an item at most; two windows, the first on one of ``SALT``
   parts of an item's rows, bring them together. A term that a third of all documents hold is spread like the documents.

Defined results: items are the distinct pairs of id and text; null texts and texts without terms find nothing and are
not found; repeated rows and documents of one id are ranked each, a null id behind others of the same score; no
documents or no items give no rows; other columns do not matter. A document's count of a term must stay below 2**31.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.text import Flat, get, slices
from wardlight.session import written

TOP = 20
ITEM_TERMS = 1 << 17
CELLS = 1 << 22  # cells of a shard's table of scores (documents x terms), and of the tables of maxima made at a time
BLOCK = 32
PROJECTION = 32
SALT = 256
GAP = np.ones(256, dtype=bool)
GAP[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def terms_of(column: pa.Array) -> tuple[Flat, pa.Array]:
    """Places of the terms of a slice of texts and the terms themselves, A-Z in lower case."""
    flat = Flat(column, GAP)
    data = LOWER[flat.data][flat.word]
    ends = np.concatenate(([0], np.cumsum(flat.end - flat.start))).astype(np.int64)
    return flat, pa.Array.from_buffers(pa.large_binary(), len(flat.start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


@dataclass
class Items:
    """A part of the items: its terms, and of each item the numbers of its terms and how often it holds them."""

    rows: list[tuple]
    vocabulary: pa.Array
    term: list[np.ndarray]
    times: list[np.ndarray]


def item_part(rows: list[tuple]) -> Items:
    found: dict[bytes, int] = {}
    terms, times, kept = [], [], []
    for row in rows:
        words = terms_of(pa.array([row[1]], pa.string()))[1].to_pylist()
        if words:
            own: dict[int, int] = {}
            for w in words:
                k = found.setdefault(w, len(found))
                own[k] = own.get(k, 0) + 1
            kept.append(row)
            terms.append(np.array(list(own), dtype=np.int64))
            times.append(np.array(list(own.values()), dtype=np.int64))
    return Items(kept, pa.array(list(found), pa.large_binary()), terms, times)


def item_parts(items: DataFrame, size: int):
    """Parts of the items (_item, _text), each small enough for the driver and a broadcast."""
    rows = written(items.distinct().withColumn("_n", F.char_length(F.coalesce("_text", F.lit("")))), "items")
    total = rows.agg(F.sum("_n")).first()[0] or 0
    parts = max(1, math.ceil(total / (2 * size)))  # a term and its gap take two characters at least
    for k in range(parts):
        part = item_part([(r["_item"], r["_text"]) for r in rows.filter(F.pmod(F.xxhash64("_text", "_item"), F.lit(parts)) == k).collect()])
        if part.rows:
            yield part


def forward_table(rows: DataFrame, part: Items) -> DataFrame:
    """Of each document (_id, _t): its number of terms ``n`` and its counts ``f`` of the part's terms ``t``."""
    width = len(part.vocabulary)
    shared = rows.sparkSession.sparkContext.broadcast(part.vocabulary.to_pylist())

    def forward(batches):
        vocabulary = pa.array(shared.value, pa.large_binary())
        for batch in slices(batches, "_t"):
            flat, words = terms_of(get(batch, "_t"))
            at = pc.index_in(words, vocabulary)
            known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            key, count = np.unique(flat.doc[known] * width + at.drop_null().to_numpy().astype(np.int64), return_counts=True)
            first = pa.array(np.searchsorted(key, np.arange(flat.n + 1) * width).astype(np.int32))
            lists = [pa.ListArray.from_arrays(first, pa.array(v.astype(np.int32))) for v in (key % width, count)]
            yield pa.record_batch([get(batch, "_id"), pa.array(flat.counts.astype(np.int64)), *lists], ["_id", "n", "t", "f"])

    kind = rows.schema["_id"].dataType.simpleString()
    return written(rows.mapInArrow(forward, f"_id {kind}, n long, t array<int>, f array<int>"), "forward")


def weights(forward: DataFrame, width: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term, number of documents and of terms in them."""
    documents, total = forward.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(width, dtype=np.int64)
    for r in forward.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # a part's terms
        held[r["t"]] = r["df"]
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held.tolist()], dtype=np.int64), documents, total


def entries(n: np.ndarray, weight: np.ndarray, count: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Score of one occurrence of a term in an item, for documents of ``n`` terms that hold it ``count`` times."""
    if len(n) and int(n.max()) * 25 * documents < 1 << 63:
        m = 75 + 25 * n * documents // total
    else:
        m = np.array([75 + 25 * int(x) * documents // total for x in n], dtype=np.int64)
    return weight * (1_000_000_000 * count // (1000 * count + 12 * m))


class Shard:
    """Posting lists of some documents (entries sorted by document), clustered into blocks with coordinatewise maxima."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, size: int, width: int, block: int = BLOCK, seed: int = 1):
        self.table = np.zeros((size, width), dtype=np.int64)
        self.table[doc, term] = value
        vectors = np.searchsorted(doc, np.arange(size + 1)), term, value
        order = np.lexsort((doc, term))
        doc, term = doc[order], term[order]
        self.ends = np.searchsorted(term, np.arange(width + 1))
        rng = np.random.default_rng(seed)
        flat = (self.table @ rng.choice([-1.0, 1.0], (width, PROJECTION))).astype(np.float32)
        flat /= np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-9)
        docs, sizes, lists = [], [], []
        for t in np.flatnonzero(np.diff(self.ends)):
            mine = doc[self.ends[t] : self.ends[t + 1]]
            if len(mine) > block:
                centres = mine[np.linspace(0, len(mine) - 1, -(-len(mine) // block)).astype(np.int64)]
                group = np.argmax(flat[mine] @ flat[centres].T, axis=1)
                by = np.argsort(group, kind="stable")
                mine = mine[by]
                full = np.bincount(group, minlength=len(centres))
                cut = [min(block, f - j) for f in full.tolist() for j in range(0, f, block)]
            else:
                cut = [len(mine)]
            docs.append(mine)
            sizes += cut
            lists += [t] * len(cut)
        self.docs = np.concatenate(docs) if docs else np.empty(0, dtype=np.int64)
        self.begin = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64))))
        self.blocks = np.searchsorted(np.array(lists, dtype=np.int64), np.arange(width + 1))  # blocks of each list
        self.summarise(width, *vectors)
        self.largest = self.table.max(axis=0) if size else np.zeros(width, dtype=np.int64)

    def summarise(self, width: int, start: np.ndarray, term: np.ndarray, entry: np.ndarray) -> None:
        """Coordinatewise maxima of the blocks, kept as the places and values that are not 0; ``start`` tells where each
        document's terms and entries begin."""
        size = np.diff(self.begin)
        step = max(1, CELLS // max(width, 1))
        at, value, count = [], [], []
        for j in range(0, len(size), step):
            top = np.zeros((min(step, len(size) - j), width), dtype=np.int64)
            cells = top.reshape(-1)
            docs = self.docs[self.begin[j] : self.begin[min(j + step, len(size))]]
            own = start[docs + 1] - start[docs]
            ends = np.cumsum(own)
            from_ = np.repeat(start[docs] - ends + own, own)
            from_ += np.arange(len(from_))
            to = np.repeat(np.repeat(np.arange(len(top)) * width, size[j : j + step]), own)
            to += term[from_]
            np.maximum.at(cells, to, entry[from_])
            to = np.flatnonzero(cells)
            row = to // width
            at.append((to - row * width).astype(np.int32))
            value.append(cells[to])
            count.append(np.bincount(row, minlength=len(top)))
        self.at = np.concatenate(at) if at else np.empty(0, dtype=np.int32)
        self.value = np.concatenate(value) if value else np.empty(0, dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(np.concatenate(count) if count else np.empty(0, dtype=np.int64))))

    def bounds(self, blocks: np.ndarray, item: np.ndarray) -> np.ndarray:
        """What a document of each block can score at most, ``item`` being how often each term is asked for."""
        size = self.first[blocks + 1] - self.first[blocks]
        own = np.repeat(np.arange(len(blocks)), size)
        cell = np.repeat(self.first[blocks] - (np.cumsum(size) - size), size) + np.arange(len(own))
        out = np.zeros(len(blocks), dtype=np.int64)
        full = np.flatnonzero(size)
        if len(full):
            out[full] = np.add.reduceat(self.value[cell] * item[self.at[cell]], (np.cumsum(size) - size)[full])
        return out

    def reached(self, term: np.ndarray, times: np.ndarray, mark: int, top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents (and scores above 0) that score at least the mark, as it rises to the ``top``-th best; blocks read."""
        most = self.largest[term] * times
        rank = np.argsort(most)
        asked = term[rank][np.cumsum(most[rank]) >= max(mark, 1)]  # the others fall short together
        if not len(asked):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
        blocks = np.concatenate([np.arange(self.blocks[t], self.blocks[t + 1]) for t in asked])
        item = np.zeros(self.table.shape[1], dtype=np.int64)
        item[term] = times
        bound = self.bounds(blocks, item)
        order = np.argsort(-bound, kind="stable")
        blocks, bound = blocks[order], bound[order]
        seen = np.zeros(len(self.table), dtype=bool)
        docs, scores, read, j, step = [], [], 0, 0, 8
        while j < len(blocks):
            j2 = j + int(np.searchsorted(-bound[j : j + step], -max(mark, 1), "right"))
            if j2 == j:
                break
            mine = np.unique(np.concatenate([self.docs[self.begin[b] : self.begin[b + 1]] for b in blocks[j:j2]]))
            mine = mine[~seen[mine]]
            seen[mine] = True
            read += j2 - j
            score = self.table[np.ix_(mine, term)] @ times
            ok = score >= max(mark, 1)
            docs.append(mine[ok])
            scores.append(score[ok])
            if j2 < j + step and j2 < len(blocks):
                break
            j, step = j2, step * 2
            every = np.concatenate(scores)
            if len(every) >= top:
                mark = max(mark, int(np.partition(every, len(every) - top)[len(every) - top]))
        docs, scores = np.concatenate(docs) if docs else np.empty(0, dtype=np.int64), np.concatenate(scores) if scores else np.empty(0, dtype=np.int64)
        if len(scores) >= top:
            mark = max(mark, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
        return docs[scores >= mark], scores[scores >= mark], read


def best_of_shards(forward: DataFrame, part: Items, top: int) -> DataFrame:
    """(q, _id, score): the best documents of each task for item number ``q`` of the part."""
    width = len(part.vocabulary)
    weight, documents, total = weights(forward, width)
    kind = forward.schema["_id"].dataType.simpleString()
    if not documents:
        return forward.sparkSession.createDataFrame([], f"q int, _id {kind}, score long")
    shared = forward.sparkSession.sparkContext.broadcast((part.term, part.times, weight))
    limit = max(256, CELLS // width)

    def search(batches):
        terms, times, weight = shared.value
        best: list[tuple] = [(np.empty(0, dtype=np.int64), None)] * len(terms)

        def add(batch):
            n = get(batch, "n").to_numpy()
            lists = [get(batch, c) for c in ("t", "f")]
            size = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), size)
            term, count = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            shard = Shard(doc, term, entries(n[doc], weight[term], count, documents, total), len(n), width)
            ids = get(batch, "_id")
            for q in range(len(terms)):
                scores, found = best[q]
                mark = int(scores[-1]) if len(scores) == top else 1
                docs, new, _ = shard.reached(terms[q], times[q], mark, top)
                if len(docs):
                    both = pa.table({"s": np.concatenate((scores, new)), "i": pa.concat_arrays([*([found] if found is not None else []), ids.take(pa.array(docs))])})
                    both = both.take(pc.sort_indices(both, sort_keys=[("s", "descending"), ("i", "ascending")])[:top])
                    best[q] = (both["s"].to_numpy(), both["i"].combine_chunks())

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for j in range(0, batch.num_rows, limit):
                held.append(batch.slice(j, limit))
                if sum(b.num_rows for b in held) >= limit:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    add(rows.slice(0, limit).to_batches()[0])
                    held = rows.slice(limit).to_batches()
        if held and sum(b.num_rows for b in held):
            add(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        for q, (scores, found) in enumerate(best):
            if len(scores):
                yield pa.record_batch([pa.array(np.full(len(scores), q, dtype=np.int32)), found, pa.array(scores)], ["q", "_id", "score"])

    return forward.filter("n > 0").mapInArrow(search, f"q int, _id {kind}, score long")


def lexical_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, size: int = ITEM_TERMS) -> DataFrame:
    """(item, ``rank``, id, ``score``): the ``top`` documents of each item with a score above 0, equal scores by rising id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    asked = items.select(F.col(item_col).alias("_item"), F.col(item_text).alias("_text"))
    kind = asked.schema["_item"].dataType.simpleString()
    out = None
    for part in item_parts(asked, size):
        found = best_of_shards(forward_table(rows, part), part, top).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALT)))
        for keys in (("q", "_salt"), ("q",)):
            place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("_id")))
            found = found.withColumn("rank", place).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(q, row[0]) for q, row in enumerate(part.rows)], f"q int, _item {kind}")  # one part of the items
        found = found.join(F.broadcast(names), "q").select(F.col("_item").alias(item_col), "rank", F.col("_id").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} {rows.schema['_id'].dataType.simpleString()}, score long") if out is None else out
