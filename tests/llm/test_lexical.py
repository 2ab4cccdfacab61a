"""Ranked lexical search against a plain scorer; blocks against exact scores."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from wardlight.llm.lexical import Shard, lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UP = {c: c + 32 for c in range(65, 91)}
ITEM = "item_id long, text string"


def terms(t):
    return TERM.findall((t or "").translate(UP))


def plain(docs, items, top):
    ts = [(i, terms(t)) for i, t in docs]
    ts = [x for x in ts if x[1]]
    n_docs, n_terms, df = len(ts), sum(len(x[1]) for x in ts), {}
    for _, w in ts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in set(items):
        got = []
        for i, w in ts:
            m = 75 + 25 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 12 * m)) for t in terms(text) if t in df)
            if s > 0:
                got.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, g[3], -g[0]) for r, g in enumerate(sorted(got)[:top])]
    return sorted(out, key=str)


def run(docs, items, **kw):
    return sorted((tuple(r) for r in lexical_search(docs, items, **kw).collect()), key=str)


def make(seed, n):
    rng = random.Random(seed)
    words = [f"t{k}" for k in range(60)] + ["Été", "naïve", "日本", "A1", "a1"]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 30, 200])))) for k in range(n)]
    docs += [(n + k, "t1 t2 t3 t4 " * 3) for k in range(90)] + [(k, docs[k][1]) for k in range(5)] + [(None, "t1 t2"), (None, None), (n + 900, None), (n + 901, "... \t!"), (n + 902, "t5 " * 3000)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 12])))) for k in range(15)] + [(3, "t1-T1;t2"), (3, "t1-T1;t2"), (4, None), (5, ""), (6, "unheard of"), (None, "t4,t9")]
    return docs, items


def test_against_plain_scores(spark, frame):
    docs, items = make(1, 400)
    rng = random.Random(2)
    rng.shuffle(docs)
    df = frame(docs, 4).withColumns({c: F.lit("x") for c in ("_id", "q", "rank", "score", "t", "f", "item_id")})
    asked = spark.createDataFrame(items, ITEM).withColumn("score", F.lit(1))
    want = plain(docs, items, 20)
    assert run(df, asked) == want
    assert run(df, asked, size=4) == want  # many parts
    assert run(df, asked, top=3) == plain(docs, items, 3)


def test_small_shards(spark, frame, monkeypatch):
    import wardlight.llm.lexical as module

    monkeypatch.setattr(module, "CELLS", 1)  # 256 documents a shard, one block of maxima at a time
    docs, items = make(5, 900)
    assert run(frame(docs, 2), spark.createDataFrame(items, ITEM)) == plain(docs, items, 20)


def test_empty_tables(spark, frame, none):
    items = spark.createDataFrame([(1, "a b")], ITEM)
    assert run(none, items) == [] and run(frame([(1, "a")]), items.limit(0)) == [] and run(frame([(1, None), (2, "b")]), items) == [(1, 1, 2, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 1200)))]


def shard(seed, size=600, width=40, block=16):
    rng = np.random.default_rng(seed)
    topic = rng.integers(0, 8, size)
    table = np.where(rng.random((size, width)) < np.where((np.arange(width)[None, :] % 8) == topic[:, None], 0.7, 0.05), rng.integers(1, 10**10, (size, width)), 0)
    doc, term = np.nonzero(table)
    return table, Shard(doc, term, table[doc, term], size, width, block)


def test_maxima_bound_every_document_and_lists_are_whole():
    table, s = shard(3)
    for t in range(40):
        mine = np.concatenate([s.docs[s.begin[b] : s.begin[b + 1]] for b in range(s.blocks[t], s.blocks[t + 1])])
        assert sorted(mine.tolist()) == np.flatnonzero(table[:, t]).tolist()
    for b in range(len(s.begin) - 1):
        top = table[s.docs[s.begin[b] : s.begin[b + 1]]].max(axis=0)
        kept = np.zeros(40, dtype=np.int64)
        kept[s.at[s.first[b] : s.first[b + 1]]] = s.value[s.first[b] : s.first[b + 1]]
        assert kept.tolist() == top.tolist() and s.begin[b + 1] - s.begin[b] <= 16


def test_skipping_is_exact_and_happens():
    table, s = shard(4)
    rng = np.random.default_rng(9)
    read = whole = 0
    for _ in range(60):
        term = rng.choice(8) + 8 * rng.choice(5, rng.integers(1, 5), replace=False)
        times = rng.integers(1, 4, len(term))
        score = table[:, term] @ times
        for mark in (1, int(np.sort(score)[-5])):
            docs, scores, n = s.reached(term, times, mark, 10)
            tenth = max(mark, int(np.sort(score)[-10]), 1)
            assert sorted(docs.tolist()) == np.flatnonzero(score >= tenth).tolist() and (score[docs] == scores).all()
            read += n
            whole += int((s.blocks[term + 1] - s.blocks[term]).sum())
    assert read < 0.7 * whole
