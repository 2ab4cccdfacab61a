"""LM scoring: a bidirectional window network, trained in numpy, predicts every token from both sides.

Tokens are words hashed into ``TOKENS`` ids, so the vocabulary has a fixed size and every word of the corpus is one. The
probability of a token between its neighbours is the product of two factors,

    P(token | both sides) = P(class | both sides) * P(token | class).

Classes group tokens by how often they occur, counted over the whole corpus. The first factor is a network: the two
nearest neighbours enter by class (``CLASSES`` and an edge mark), the two beyond by a coarse group (``GROUPS``), each through its own
embedding, a tanh layer joins the four, and a softmax gives the class in the middle. Its training data are the counts of
all windows of the corpus, summed in tasks and then in a shuffle. There are at most ``(CLASSES + 1)**2 * GROUPS**2 * CLASSES``
different windows, so the driver receives a table of fixed size whatever the corpus, and full-batch gradients on it are
exact gradients of the corpus likelihood. A trained network is a table of log-probabilities by context, used for scoring.

A document's score is the sum of the conditional log-probabilities of all its tokens (natural logarithm).
Defined results: null, empty and wordless texts have no tokens, sum 0 and a null mean; an empty table gives an empty
result; repeated rows are scored each and count each in training; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.text import Flat, get, slices

TOKENS = 1 << 16
CLASSES = 48
GROUPS = 4
SIDE = CLASSES + 1  # the last one marks the edge of a text


def token_ids(flat: Flat) -> np.ndarray:
    return (flat.words(5) & np.uint64(TOKENS - 1)).astype(np.int64)


def token_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of every token id over the whole corpus."""

    def count(batches):
        total = np.zeros(TOKENS, dtype=np.int64)
        for part in slices(batches, "_t"):
            total += np.bincount(token_ids(Flat(get(part, "_t"))), minlength=TOKENS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["token", "n"])

    got = texts.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TOKENS, dtype=np.int64)
    out[got.column("token").to_numpy()] = got.column("n").to_numpy()
    return out


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every token, group of every class (edge included), log P(token | class).

    The most frequent three quarters of the classes hold one token each; the others share the rest by equal mass in
    order of frequency. Groups are runs of classes of about equal mass. One is added to each count.
    """
    order = np.lexsort((np.arange(TOKENS), -counts))
    single = 3 * CLASSES // 4
    smooth = counts + 1.0
    rest = smooth[order[single:]]
    share = np.minimum(((np.cumsum(rest) - rest / 2) / rest.sum() * (CLASSES - single)).astype(np.int64), CLASSES - single - 1)
    of = np.empty(TOKENS, dtype=np.int64)
    of[order[:single]] = np.arange(single)
    of[order[single:]] = single + share
    mass = np.bincount(of, smooth, CLASSES)
    group = np.minimum(((np.cumsum(mass) - mass / 2) / mass.sum() * GROUPS).astype(np.int64), GROUPS - 1)
    return of, np.append(group, GROUPS - 1), np.log(smooth / mass[of])


def windows(flat: Flat, of: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, class and context number of every word; a context is (far left, left, right, far right)."""
    token = token_ids(flat)
    c = of[token]
    n = len(c)

    def beside(step: int) -> np.ndarray:
        out = np.full(n, CLASSES, dtype=np.int64)
        if n > abs(step):
            a, b = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -step), slice(step, None))
            out[a] = np.where(flat.doc[a] == flat.doc[b], c[b], CLASSES)
        return out

    context = ((group[beside(-2)] * SIDE + beside(-1)) * SIDE + beside(1)) * GROUPS + group[beside(2)]
    return token, c, context


CONTEXTS = GROUPS * SIDE * SIDE * GROUPS


def window_counts(texts: DataFrame, of: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Occurrences of every (context, class) over the whole corpus."""

    def count(batches):
        total = np.zeros(CONTEXTS * CLASSES, dtype=np.int64)
        for part in slices(batches, "_t"):
            _, c, context = windows(Flat(get(part, "_t")), of, group)
            at, n = np.unique(context * CLASSES + c, return_counts=True)
            total[at] += n
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield pa.record_batch([pa.array(at[k : k + 100_000]), pa.array(total[at[k : k + 100_000]])], ["w", "n"])

    rows = texts.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    out = np.zeros(CONTEXTS * CLASSES, dtype=np.float32)
    for w, n in rows.select("w", "n").toLocalIterator():
        out[w] = n
    return out.reshape(CONTEXTS, CLASSES)


@dataclass
class Network:
    of: np.ndarray
    group: np.ndarray
    token_logp: np.ndarray
    logp: np.ndarray  # contexts x classes


def train(counts: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.05, seed: int = 7) -> np.ndarray:
    """Log P(class | context) of a one-layer network fitted to window counts by Adam on full-batch gradients."""
    rng = np.random.default_rng(seed)
    far_l, left, right, far_r = np.unravel_index(np.arange(CONTEXTS), (GROUPS, SIDE, SIDE, GROUPS))
    seen = np.flatnonzero(counts.sum(axis=1))
    inputs = [(far_l, GROUPS), (left, SIDE), (right, SIDE), (far_r, GROUPS)]
    unigram = counts.sum(axis=0) + 1
    p = [rng.normal(0, 0.3, (size, hidden)).astype(np.float32) for _, size in inputs]
    p += [np.zeros((hidden, CLASSES), np.float32), np.log(unigram / unigram.sum()).astype(np.float32)]

    def forward(at):
        h = np.tanh(sum(p[k][ids[at]] for k, (ids, _) in enumerate(inputs)))
        z = h @ p[4] + p[5]
        z -= z.max(axis=1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    target = counts[seen]
    weight = target.sum(axis=1, keepdims=True)
    total = max(float(weight.sum()), 1.0)
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, epochs + 1 if len(seen) else 1):
        h, logp = forward(seen)
        dz = (np.exp(logp) * weight - target) / total
        dh = (dz @ p[4].T) * (1 - h * h)
        grads = []
        for ids, size in inputs:
            one = np.zeros((size, hidden), np.float32)
            where = ids[seen]
            order = np.argsort(where, kind="stable")
            edge = np.flatnonzero(np.diff(where[order], prepend=-1))
            one[where[order][edge]] = np.add.reduceat(dh[order], edge, axis=0)
            grads.append(one)
        grads += [h.T @ dz, dz.sum(axis=0)]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return forward(np.arange(CONTEXTS))[1].astype(np.float32)


def pseudo_likelihood_model(docs: DataFrame, text_col: str = "text") -> Network:
    """Two passes over the corpus (token counts, window counts) and a fit whose cost does not depend on its size."""
    texts = docs.select(F.col(text_col).alias("_t"))
    of, group, token_logp = classes_of(token_counts(texts))
    return Network(of, group, token_logp, train(window_counts(texts, of, group)))


def pseudo_likelihood(docs: DataFrame, model: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``pll`` (sum) and ``mean_pll``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        net = held.value
        for part in slices(batches, "_t"):
            flat = Flat(get(part, "_t"))
            token, c, context = windows(flat, net.of, net.group)
            value = net.logp[context, c].astype(np.float64) + net.token_logp[token]
            total = np.bincount(flat.doc, value, flat.n) if len(value) else np.zeros(flat.n)
            mean = pa.array(total / np.maximum(flat.counts, 1), mask=flat.counts == 0)
            yield pa.record_batch([get(part, "_id"), pa.array(flat.counts.astype(np.int64)), pa.array(total), mean], ["_id", "n_tokens", "pll", "mean_pll"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"_id {kind}, n_tokens long, pll double, mean_pll double").withColumnRenamed("_id", id_col)
