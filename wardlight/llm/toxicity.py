"""Toxicity scores by a factorization machine over hashed terms.

The terms of a text are its distinct words (runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased)
and the first ``STEM`` characters of longer words, which stand for compounds and inflections. Terms are hashed to
2 ** ``BITS`` numbers. The machine scores a set of terms by

    bias + sum of w[i] + sum over pairs i < j of <v[i], v[j]>,

so a pair such as an insult with a mention of a group has a weight of its own, which no sum of single weights can give.
All pairs together cost as much as the terms: half of |sum of v|**2 - sum of |v|**2.

It is fitted on the driver by AdaGrad on the log-loss, from at most ``sample`` labelled rows (those with the smallest hash of
their id) that have at most ``TERMS`` terms together (rows behind that are left out in the same order), so its memory is
bounded. Terms of fewer than ``LEAST`` of these rows (so all unseen ones), and terms whose share of label 1 is within ``APART``
standard deviations of the average, count as nothing: with far more terms than rows they would learn the sample by heart.
Every document is scored whole.

Defined results: rows whose crc32(id as text) mod 4 is 2 are held out and never learned from; null ids and null labels
are not learned from, and a null id is not held out; a document that is labelled twice counts twice; null and empty texts
have no terms and score by the bias alone; without labels every score is 0; an empty table gives no rows; repeated rows
are scored each; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.text import Flat, get, slices, span_hashes
from wardlight.session import written

SAMPLE, TERMS, LEAST = 20_000, 12_000_000, 4
BITS, STEM, RANK, EPOCHS = 20, 4, 8, 6
SHARE, APART = 0.3, 3.0
GAP = np.ones(256, dtype=bool)
GAP[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LEAD = np.ones(256, dtype=bool)
LEAD[0x80:0xC0] = False


def hashed_terms(column: pa.Array, bits: int = BITS, stem: int = STEM) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hashed term of all distinct terms of a slice of texts, in this order."""
    flat = Flat(column, GAP)
    data = LOWER[flat.data]
    lead = np.flatnonzero(LEAD[data])
    first = np.searchsorted(lead, flat.start)
    long = np.flatnonzero(np.searchsorted(lead, flat.end) - first > stem)
    head = lead[first[long] + stem] if len(long) else long
    word = span_hashes(data, flat.start, flat.end, 41)
    stems = span_hashes(data, flat.start[long], head, 42)
    mask = np.uint64((1 << bits) - 1)
    term = (np.concatenate((word, stems)) & mask).astype(np.int64)
    key = np.unique(np.concatenate((flat.doc, flat.doc[long])) << bits | term)
    return key >> bits, key & ((1 << bits) - 1)


@dataclass
class Machine:
    """``row[t]`` is the place of term t in ``weight`` and ``factors``; place 0 holds zeros for all other terms."""

    bias: float
    row: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    def odds(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of each of ``n`` sets of terms; ``doc`` is sorted."""
        at = self.row[term]
        known = at > 0
        doc, at = doc[known], at[known]
        total = self.bias + np.bincount(doc, self.weight[at], n)
        v = self.factors[at]
        for k in range(v.shape[1]):
            total += (np.bincount(doc, v[:, k], n) ** 2 - np.bincount(doc, v[:, k] ** 2, n)) / 2
        return total


def fit_machine(doc: np.ndarray, term: np.ndarray, y: np.ndarray, size: int, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.3, least: int = LEAST, apart: float = APART, decay: float = 1e-4, batch: int = 32) -> Machine:
    """Fit to labels ``y`` in {0, 1}; ``doc`` (sorted) and ``term`` list the terms below ``size`` of each row."""
    rng = np.random.default_rng(7)
    seen = np.bincount(term, minlength=size)
    share = y.mean() if len(y) else 0.0
    lift = np.bincount(term, y[doc], size) - seen * share
    kept = np.flatnonzero((seen >= least) & (lift**2 > apart**2 * seen * share * (1 - share)))
    row = np.zeros(size, dtype=np.int32)
    row[kept] = np.arange(1, len(kept) + 1)
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1) if n else 0.0
    bias = float(np.log(share / (1 - share))) if n else -np.inf
    w = np.zeros(len(kept) + 1)
    v = rng.normal(0, 0.01, (len(kept) + 1, rank))
    v[0] = 0
    if not n or y.min() == y.max() or not len(kept):
        return Machine(bias, row, np.zeros_like(w), np.zeros_like(v))
    use = row[term] > 0
    doc, at = doc[use], row[term][use]
    first = np.searchsorted(doc, np.arange(n + 1))
    gw, gv, gb = np.full(len(w), 1e-8), np.full(v.shape, 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(n)
        for j in range(0, n, batch):
            some = np.sort(order[j : j + batch])
            count = first[some + 1] - first[some]
            own = np.repeat(np.arange(len(some)), count)
            cell = at[np.repeat(first[some], count) + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)]
            feature, back = np.unique(cell, return_inverse=True)
            vf = v[feature]
            total = bias + np.bincount(own, w[cell], len(some))
            sums = np.stack([np.bincount(own, vf[back, k], len(some)) for k in range(rank)], axis=1)
            square = np.bincount(own, (vf**2).sum(axis=1)[back], len(some))
            total += ((sums**2).sum(axis=1) - square) / 2
            err = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y[some]) / np.sqrt(len(some))
            hit = np.bincount(back, err[own], len(feature))
            d = hit + decay * w[feature]
            gw[feature] += d * d
            w[feature] -= rate * d / np.sqrt(gw[feature])
            d = np.stack([np.bincount(back, (err[:, None] * sums)[own, k], len(feature)) for k in range(rank)], axis=1) - hit[:, None] * vf + decay * vf
            gv[feature] += d * d
            v[feature] -= rate / 4 * d / np.sqrt(gv[feature])
            d = err.sum()
            gb += d * d
            bias -= rate * d / np.sqrt(gb)
    return Machine(bias, row, w, v)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """The machine fitted to the labelled rows that are not held out; the sample of ids is bounded, so is its broadcast."""
    some = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_y"))
    some = some.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id", "_y").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(some), "_id")

    def terms(batches):
        for part in slices(batches, "_t"):
            doc, term = hashed_terms(get(part, "_t"))
            first = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32))
            size = pa.array(np.bincount(doc, minlength=part.num_rows))
            yield pa.record_batch([get(part, "_h"), get(part, "_y"), size, pa.ListArray.from_arrays(first, pa.array(term.astype(np.int32)))], ["_h", "_y", "n", "terms"])

    kept = written(rows.select("_h", "_y", "_t").mapInArrow(terms, "_h long, _y int, n long, terms array<int>"), "labelled")
    ends = np.cumsum(np.array([r["n"] for r in kept.select("n", "_h", "_y").orderBy("_h", "_y", "n").collect()], dtype=np.int64))
    fits = int(np.searchsorted(ends, TERMS, "right"))
    got = kept.orderBy("_h", "_y", "n", "terms").limit(fits).toArrow()
    size = got["n"].to_numpy()
    return fit_machine(np.repeat(np.arange(len(size), dtype=np.int32), size), got["terms"].combine_chunks().flatten().to_numpy() if len(size) else size, got["_y"].to_numpy().astype(float), 1 << BITS)


def toxicity_scores(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` (chance of label 1) and ``predicted``."""
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS numbers and TERMS / LEAST rows of RANK + 1

    def score(batches):
        machine = shared.value
        for part in slices(batches, "_t"):
            doc, term = hashed_terms(get(part, "_t"))
            odds = machine.odds(doc, term, part.num_rows)
            p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            p[np.isneginf(odds)] = 0.0
            yield pa.record_batch([get(part, "_id"), get(part, "held_out"), pa.array(p), pa.array((p >= share).astype(np.int32))], ["_id", "held_out", "score", "predicted"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("_id", id_col)
