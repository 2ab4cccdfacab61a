"""Centroid clustering against plain loops."""

import hashlib
import math

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlight.llm.orchard import Orchard, orchard_clusters, whole_vectors

VEC = "vec_id long, embedding array<float>"


def plain(rows, k, dim, rounds, scale=256):
    kept = [(i, tuple(math.floor(scale * float(np.float32(c))) for c in v)) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    cents = [x for _, x in starts]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        cents = [tuple(sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)) if j in groups else c for j, c in enumerate(cents)]
    got = [(i, *near(x)) for i, x in kept]
    total = sum(d for _, d, _ in got)
    each = {j: sum(d for _, d, c in got if c == j) for _, _, j in got}
    return sorted(((i, j, d, each[j], total, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in got), key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in orchard_clusters(df, **kw).collect()), key=str)


def test_odd_tables(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in rng.integers(-3, 4, 4)]) for i in range(300)]  # few values: many ties and equal centroids
    rows += rows[:20] + [(None, [1.0] * 4), (900, None), (901, [1.0] * 3), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, []), (906, [-0.001, 0.003, 0.0, 1e-30])]
    rows += [(k, [2.0, 2.0, 2.0, 2.0]) for k in range(1000, 1300)]
    df = spark.createDataFrame(rows, VEC).repartition(5).withColumns({c: F.lit("x") for c in ("cluster", "distance", "_id", "n", "sums")})
    for k in (1, 12, 40, 1000):
        assert run(df, k=k, dim=4, rounds=3) == plain(rows, k, 4, 3)
    none = spark.createDataFrame([], VEC)
    assert run(none) == [] and run(spark.createDataFrame([(1, [1.0])], VEC)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=25), st.lists(st.lists(st.integers(-4, 4), min_size=3, max_size=3), min_size=1, max_size=12))
def test_search_finds_the_nearest(points, centroids):
    x, c = np.array(points, dtype=np.int64), np.array(centroids, dtype=np.int64)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    here, best, _ = Orchard(c).nearest(x)
    assert here.tolist() == d.argmin(axis=1).tolist() and best.tolist() == d.min(axis=1).tolist()


def test_search_measures_few_distances():
    rng = np.random.default_rng(5)
    middle = rng.integers(-2000, 2000, (40, 64))
    x = middle[rng.integers(0, 40, 5000)] + rng.integers(-20, 21, (5000, 64))
    _, _, measured = Orchard(middle).nearest(x)
    assert measured < 0.7 * 5000 * 40


def test_components_of_slices_and_doubles():
    column = pa.array([[9.0], None, [0.5, -0.5], [1.0], [0.25, 1e300], [0.1, 0.2]], pa.list_(pa.float64()))
    at, x = whole_vectors(column.slice(1), dim=2)
    assert at.tolist() == [1, 4] and x.tolist() == [[128, -128], [math.floor(25.6), math.floor(51.2)]]
