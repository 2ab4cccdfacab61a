"""Substring dedup, pseudo-likelihood, quality rules."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlight.llm.boosting import fit
from wardlight.llm.pseudo_likelihood import CLASSES, CONTEXTS, TOKENS, pseudo_likelihood, pseudo_likelihood_model, train
from wardlight.llm.quality import MONOTONE, base_failed, measure, quality_filter, quality_model, quality_rules
from wardlight.llm.substring import substring_dedup
from wardlight.llm.text import Flat, rolling

SF = "/root/testdata/sf0.01"
texts = st.lists(st.text(alphabet="ab éß\n\t#!Z9 \x0b\x0c\r  ", max_size=60), max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_are_ascii_space_runs(ts):
    flat = Flat(pa.array(ts, pa.string()))
    raw = flat.data.tobytes()
    got = [[raw[a:b] for a, b in zip(flat.start[flat.first[k] : flat.first[k + 1]], flat.end[flat.first[k] : flat.first[k + 1]], strict=True)] for k in range(len(ts))]
    assert got == [t.encode().split() for t in ts]
    h = flat.words(1)
    flatten = [w for g in got for w in g]
    assert len({*zip(flatten, h.tolist(), strict=True)}) == len(set(flatten)) == len(set(h.tolist()))


def test_rolling_hash_depends_on_content_only():
    h = np.arange(1, 200, dtype=np.uint64) % np.uint64(7)
    r = rolling(h, 5, 3)
    assert (r[:50] == r[7:57]).all() and len(set(r.tolist())) == 7


def plain_measure(t):
    w = (t or "").encode().split()
    grams, where = {}, set()
    for k in range(len(w) - 2):
        grams.setdefault(tuple(w[k : k + 3]), []).append(k)
    for places in grams.values():
        if len(places) > 1:
            where |= {k + j for k in places for j in range(3)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return [len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(where)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \né#|\r", max_size=80)), max_size=6))
def test_base_counts(ts):
    counts, _ = measure(pa.array(ts, pa.string()))
    assert counts.tolist() == [plain_measure(t) for t in ts]


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.2)).astype(float)
    model = fit(x, y, np.array([-1, 0, 0]))
    assert ((model.score(x) >= 0) == (y > 0)).mean() > 0.98
    low = rng.random((500, 3))
    high = low.copy()
    high[:, 0] += rng.random(500)
    assert (model.score(high) <= model.score(low) + 1e-12).all()
    assert len(MONOTONE) == measure(pa.array(["a"]))[1].shape[1]


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model(docs, labels.filter("doc_id % 2 = 0"))
    got = quality_rules(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").toPandas()
    assert ((got["kept"]) == (got["quality"] == 1)).mean() > 0.97


def test_quality_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_model(odd, labels)
    got = quality_rules(odd, model).collect()
    assert len(got) == odd.count() and all(r.kept is False for r in got if r.n_words < 50)
    assert quality_filter(odd, model).columns == odd.columns
    assert quality_rules(none, quality_model(none, labels.limit(0))).count() == 0
    counts, _ = measure(pa.array(["a b c " * 40]))
    assert base_failed(counts).tolist() == [True]


def plain_dedup(rows, n=50):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        stay = [True] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                stay[k : k + n] = [False] * n
        out.append((i, len(w), len(w) - sum(stay), b" ".join(x for x, s in zip(w, stay, strict=True) if s).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [4, 26])
def test_substring_brute_force(frame, bits):
    rng = random.Random(4)
    vocabulary = [f"w{k}é" for k in range(40)]
    shared = [" ".join(rng.choices(vocabulary, k=rng.randint(40, 90))) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(4), rng.choice(shared))
        rows.append((i * 7 % 61, "\n ".join(parts)))
    got = sorted((tuple(r) for r in substring_dedup(frame(rows), bits=bits).collect()), key=str)
    assert got == plain_dedup(rows) and any(r[2] for r in got)


def test_substring_odd_rows(odd, none):
    got = sorted((tuple(r) for r in substring_dedup(odd).collect()), key=str)
    assert got == plain_dedup([(r.doc_id, r.text) for r in odd.collect()])
    assert substring_dedup(none).count() == 0
    assert hashlib.sha256(b"").hexdigest()  # kept text of a wordless row is empty, never null
    assert all(r[3] is not None for r in got)


def test_network_learns_from_both_sides():
    counts = np.zeros((CONTEXTS, CLASSES), dtype=np.float32)
    left = np.unravel_index(np.arange(CONTEXTS), (4, CLASSES + 1, CLASSES + 1, 4))
    for k in (3, 9):
        counts[(left[1] == k) & (left[2] == 5), k + 1] = 1
        counts[(left[1] == k) & (left[2] == 6), k + 20] = 1
    logp = train(counts, epochs=80)
    at = np.flatnonzero(counts.sum(axis=1))
    assert (logp[at].argmax(axis=1) == counts[at].argmax(axis=1)).mean() > 0.95
    assert np.allclose(np.exp(logp).sum(axis=1), 1, atol=1e-3)


def test_pseudo_likelihood_prefers_text_of_its_corpus(spark, none, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'")
    model = pseudo_likelihood_model(docs)
    real = docs.filter("n_chars > 500").limit(40).collect()
    rng = random.Random(1)
    mixed = [(r.doc_id, " ".join(rng.sample(r.text.split(), len(r.text.split())))) for r in real]
    before = {r.doc_id: r.mean_pll for r in pseudo_likelihood(docs, model).collect()}
    after = pseudo_likelihood(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()
    assert sum(before[r.doc_id] > r.mean_pll for r in after) > 30
    got = pseudo_likelihood(odd, model).collect()
    assert len(got) == odd.count() and all((r.mean_pll is None) == (r.n_tokens == 0) for r in got)
    assert pseudo_likelihood(none, pseudo_likelihood_model(none)).count() == 0


def test_pseudo_likelihood_sums_conditionals(frame):
    rows = [(1, "a b c d a b"), (2, "a"), (3, "c c c")]
    docs = frame(rows)
    net = pseudo_likelihood_model(docs)
    got = {r.doc_id: r.pll for r in pseudo_likelihood(docs, net).collect()}
    for i, t in rows:
        ids = [int(x) % TOKENS for x in Flat(pa.array([t])).words(5)]
        cls, total = [int(net.of[x]) for x in ids], 0.0

        def at(k, c=cls):
            return c[k] if 0 <= k < len(c) else CLASSES

        for k, token in enumerate(ids):
            context = ((net.group[at(k - 2)] * (CLASSES + 1) + at(k - 1)) * (CLASSES + 1) + at(k + 1)) * 4 + net.group[at(k + 2)]
            total += float(net.logp[context, cls[k]]) + float(net.token_logp[token])
        assert abs(total - got[i]) < 1e-3
