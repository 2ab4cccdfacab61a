"""Factorization machine: scores against plain sums over pairs, held-out accuracy, interactions, odd tables."""

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardlight.llm.toxicity import BITS, Machine, fit_machine, hashed_terms, toxicity_model, toxicity_scores

SF = "/root/testdata/sf0.1"


def test_terms_are_distinct_words_and_stems():
    texts = ["One one, ONE two_three! été", None, "", "üüüüü üüüüx 12345", "one"]
    doc, term = hashed_terms(pa.array(texts, pa.string()))
    sets = [set(term[doc == k].tolist()) for k in range(5)]
    assert [len(s) for s in sets] == [5, 0, 0, 5, 1]  # one two three thre été; two words of one stem, 12345 and 1234
    assert sets[4] < sets[0] and (np.diff(doc) >= 0).all()
    assert hashed_terms(pa.array(["x" * 100_000]))[0].tolist() == [0, 0]


def test_odds_are_sums_over_pairs():
    rng = np.random.default_rng(2)
    m = Machine(0.5, np.arange(20) % 7, np.r_[0, rng.normal(size=6)], np.r_[np.zeros((1, 3)), rng.normal(size=(6, 3))])
    sets = [sorted(rng.choice(20, size, replace=False).tolist()) for size in (0, 1, 2, 9, 20)]
    doc = np.repeat(np.arange(5), [len(s) for s in sets])
    got = m.odds(doc, np.concatenate([np.array(s, dtype=int) for s in sets]), 5)
    for s, g in zip(sets, got, strict=True):
        at = [m.row[t] for t in s]
        want = 0.5 + sum(m.weight[i] for i in at) + sum(float(m.factors[i] @ m.factors[j]) for i, j in itertools.combinations(at, 2))
        assert math.isclose(g, want, abs_tol=1e-9)


def test_pairs_are_learned():
    """Label 1 needs the insult and the mention together; the best sum of single weights ranks (one alone) far worse."""
    rng = np.random.default_rng(4)
    n = 3000
    has = rng.random((n, 2)) < 0.35
    y = (has[:, 0] & has[:, 1]).astype(float)
    rows = [sorted({*np.flatnonzero(has[k]).tolist(), *(2 + rng.integers(0, 300, 30)).tolist()}) for k in range(n)]
    doc, term = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)
    m = fit_machine(doc, term, y, 400, epochs=15)
    odds = m.odds(doc, term, n)
    assert odds[y == 1].min() > np.quantile(odds[y == 0], 0.99) and ((odds > 0) == (y == 1)).mean() > 0.99
    a, b = m.row[0], m.row[1]
    assert m.factors[a] @ m.factors[b] > 1


def test_held_out_rows_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity_scores(docs, toxicity_model(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    bad = got.toxic == 1
    assert len(got) > 500 and got.predicted[bad].mean() > 0.85 and got.predicted[~bad].mean() < 0.02
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_labels_of_held_out_rows_do_not_matter(spark, frame):
    docs = frame([(k, f"word{k % 7} some text {'idiot' if k % 5 == 0 else 'kind'}") for k in range(400)])
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({tuple(r) for r in toxicity_scores(docs, toxicity_model(docs, x)).collect()} for x in (labels, turned))
    assert one == two
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h, _, _ in one)
    assert all(p == (i % 5 == 0) for i, _, _, p in one)


def test_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (4, 0), (7, 1)], "doc_id long, toxic int").withColumns({c: F.lit("x") for c in ("_h", "_y", "text", "n")})
    some = toxicity_scores(odd, toxicity_model(odd, labels))
    assert some.count() == odd.count() and some.filter("score is null or held_out is null").isEmpty()
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity_scores(odd, toxicity_model(odd, empty)).collect()
    assert {(r.score, r.predicted) for r in got} == {(0.0, 0)}
    assert toxicity_scores(none, toxicity_model(none, labels)).count() == 0


def test_bounds_keep_rows_in_order(spark, frame, monkeypatch):
    import wardlight.llm.toxicity as module

    docs = frame([(k, "a b c d e") for k in range(100)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(module, "fit_machine", lambda doc, term, y, size: seen.append((len(y), len(term))) or Machine(0.0, np.zeros(1 << BITS, dtype=int), np.zeros(1), np.zeros((1, 2))))
    monkeypatch.setattr(module, "TERMS", 57)
    toxicity_model(docs, labels, sample=60)
    assert seen == [(11, 55)]


@pytest.mark.parametrize("labels", [[0] * 9, [1] * 9])
def test_one_class_only(labels):
    m = fit_machine(np.arange(9), np.zeros(9, dtype=int), np.array(labels, dtype=float), 4)
    p = 1 / (1 + math.exp(-m.odds(np.empty(0, int), np.empty(0, int), 1)[0]))
    assert (p > 0.9) == bool(labels[0])
