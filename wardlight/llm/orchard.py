"""Centroid clustering of embeddings by Lloyd rounds with Orchard's search for the nearest centroid.

Every centroid keeps the list of the others by rising distance. A vector starts at some centroid and walks its list; as
soon as a closer centroid is found it jumps to that one's list. Centroids that it has seen are marked and not measured
again. By the triangle inequality it may stop at the first neighbour that lies strictly further from the current centroid
than twice the current distance: that one and all behind it are further away than the current one. Equal distances go
to the smaller number, which the strict stop leaves room for. All vectors of a batch walk at once in numpy.

Components become integers floor(scale * x), and everything after that is exact: distances are squared Euclidean
distances of integers, new centroids are floor(sum / count) by component. Each task adds up its vectors by centroid, so a
round shuffles at most ``k`` rows a task and brings ``k`` rows to the driver; the centroids (k x dim integers, both
parameters) go out with the tasks. A centroid with a third of all vectors is therefore no hot key.

Defined results: vectors are left out when they are null, have another length, or a component that is null or not
finite, or whose integer exceeds ``LARGEST`` in size (its squares could leave 64 bits). Fewer vectors than ``k`` give as
many centroids; an empty table gives no rows. Repeated rows are clustered each; a null id is clustered, but starts no
centroid. Other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.text import get
from wardlight.session import written

K, DIM, SCALE, ROUNDS, PREFIX = 40, 64, 256, 5, "2:"
LARGEST = 1 << 26
BATCH = 4096


def whole_vectors(column: pa.Array, dim: int = DIM, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list column and their integer components (rows x dim)."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    flat = column.take(pa.array(at)).flatten()
    x = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    x = np.floor(x * scale)
    good = (np.abs(x) <= LARGEST).all(axis=1)  # false for not-a-number and infinity
    return at[good], x[good].astype(np.int64)


class Orchard:
    """Centroids with their sorted neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        gap = ((self.centroids[:, None, :] - self.centroids[None, :, :]) ** 2).sum(axis=2)
        self.order = np.argsort(gap, axis=1, kind="stable")  # a list begins with the centroid itself or an equal one
        self.gap = np.take_along_axis(gap, self.order, axis=1)
        self.start = int(np.argmin(gap.sum(axis=1).astype(float))) if len(gap) else 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid and squared distance of every row of ``x``; how many distances were measured."""
        n, k = len(x), len(self.centroids)
        here = np.full(n, self.start)
        best = ((x - self.centroids[here]) ** 2).sum(axis=1)
        seen = np.zeros((n, k), dtype=bool)
        seen[:, self.start] = True
        place = np.zeros(n, dtype=np.int64)
        walking = np.arange(n)
        measured = n
        while len(walking):
            c, p = here[walking], place[walking]
            go = p < k
            walking, c, p = walking[go], c[go], p[go]
            go = self.gap[c, p] <= 4 * best[walking]  # squared: at most twice the distance
            walking, c, p = walking[go], c[go], p[go]
            other = self.order[c, p]
            place[walking] = p + 1
            new = ~seen[walking, other]
            rows, other = walking[new], other[new]
            seen[rows, other] = True
            d = ((x[rows] - self.centroids[other]) ** 2).sum(axis=1)
            measured += len(rows)
            closer = (d < best[rows]) | ((d == best[rows]) & (other < here[rows]))
            rows, other = rows[closer], other[closer]
            here[rows], best[rows], place[rows] = other, d[closer], 0
        return here, best, measured


def first_centroids(vectors: DataFrame, k: int = K, dim: int = DIM, scale: int = SCALE, prefix: str = PREFIX) -> np.ndarray:
    """The ``k`` usable vectors with the smallest SHA-256 of prefix and id, by rising hash; ``vectors`` has _id and _v."""
    hashed = vectors.filter("_id is not null").withColumn("_h", F.sha2(F.concat(F.lit(prefix), F.col("_id").cast("string")), 256))

    def usable(batches):
        for batch in batches:
            at, x = whole_vectors(get(batch, "_v"), dim, scale)
            whole = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim), pa.array(x.reshape(-1)))
            yield pa.record_batch([get(batch, "_h").take(pa.array(at)), whole], ["_h", "_w"])

    rows = hashed.mapInArrow(usable, "_h string, _w array<long>").orderBy("_h", "_w").limit(k).collect()
    return np.array([r["_w"] for r in rows], dtype=np.int64).reshape(-1, dim)


def centroid_round(vectors: DataFrame, model: Orchard, dim: int = DIM, scale: int = SCALE) -> np.ndarray:
    """The centroids after one round: assign every vector, add up inside the tasks, then over all tasks."""

    def add_up(batches):
        total = np.zeros((len(model.centroids), dim), dtype=object)  # Python integers: a task's sums may leave 64 bits
        count = np.zeros(len(total), dtype=np.int64)
        for batch in batches:
            _, x = whole_vectors(get(batch, "_v"), dim, scale)
            for k in range(0, len(x), BATCH):
                part = x[k : k + BATCH]
                cluster, _, _ = model.nearest(part)
                sums = np.zeros((len(total), dim), dtype=np.int64)
                np.add.at(sums, cluster, part)
                total += sums
                count += np.bincount(cluster, minlength=len(total))
        full = np.flatnonzero(count)
        if len(full):
            sums = pa.array([[str(v) for v in total[c]] for c in full.tolist()], pa.list_(pa.string()))
            yield pa.record_batch([pa.array(full), pa.array(count[full]), sums], ["cluster", "n", "sums"])

    parts = vectors.select("_v").mapInArrow(add_up, "cluster long, n long, sums array<string>")
    sums = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dim)]
    out = model.centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(dim)]
    return out


def orchard_clusters(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, prefix: str = PREFIX
) -> DataFrame:
    """One row per usable vector: id, ``cluster``, squared ``distance``, ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256``."""
    vectors = table.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))
    model = Orchard(first_centroids(vectors, k, dim, scale, prefix))
    for _ in range(rounds if len(model.centroids) else 0):
        model = Orchard(centroid_round(vectors, model, dim, scale))

    def assign(batches):
        for batch in batches:
            at, x = whole_vectors(get(batch, "_v"), dim, scale)
            if len(model.centroids) and len(at):
                for j in range(0, len(x), BATCH):
                    cluster, distance, _ = model.nearest(x[j : j + BATCH])
                    yield pa.record_batch([get(batch, "_id").take(pa.array(at[j : j + BATCH])), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["_id", "cluster", "distance"])

    kind = vectors.schema["_id"].dataType.simpleString()
    placed = written(vectors.mapInArrow(assign, f"_id {kind}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in model.centroids.tolist()]
    each = [(c, s, sum(inertia.values()), digest[c]) for c, s in sorted(inertia.items())]  # at most k rows
    facts = table.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
