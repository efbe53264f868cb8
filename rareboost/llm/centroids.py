"""Centroid clustering of integer vectors, with Ptolemaic pivots.

Vectors are scaled to integers and clustered by Lloyd's rounds, so that sums,
means and distances are exact and no result hangs on the order of summation.
Ptolemy's inequality holds for the Euclidean distance d: for any points p, s,

    d(v, c) * d(p, s) >= |d(v, p) * d(c, s) - d(v, s) * d(c, p)|

Each vector's distances to a few fixed pivots are computed once and staged with
it. In a round, the pairs of pivots bound the distance to every centroid from
below by cached numbers alone. The bounds are rounded down by more than doubles
can err, and a centroid is skipped only if its bound exceeds a distance that is
known exactly; the rest are checked in integers.

A round is one narrow pass over the staged vectors. Tasks return sums per
centroid and component, and the driver holds ``k`` centroids: nothing that the
driver sees grows with the vectors. Pivots come from a bounded sample (the
``POOL`` vectors of least hash); they change the work, never the result.

Edge cases: vectors of another length, or with a null, NaN or infinite component
(or no vector at all), are left out. Repeated rows are vectors of their own;
equal hashes (repeated or null ids) are ordered by their components. With fewer
than ``k`` vectors there are as many centroids as vectors; without any the
result is empty. Components beyond 2^27 in size after scaling raise, as their
squares would leave 64 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from rareboost.session import stage

#: Vectors from which starts and pivots are taken, and how many of them become pivots.
POOL, PIVOTS = 256, 6
#: Largest component after scaling, so that squared distances fit 64 bits.
LARGEST = 1 << 27
#: Share by which bounds are lowered; a few hundred times what the products and roots can err.
SLACK = 1e-12
_STEP = 1 << 14


def lattice(df: DataFrame, dims: int = 64, scale: int = 1024, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and ``v``: the whole finite vectors of ``dims`` components, as integers floor(scale * x)."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    fits = F.forall(F.col("v"), lambda e: F.abs(e) <= LARGEST)
    scaled = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    kept = df.where((F.size(x) == dims) & finite).select(F.col(f"`{key}`").alias(key), scaled.alias("v"))
    return kept.select(key, F.when(fits, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit("component beyond 2^27"))).alias("v"))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``v`` to ``c`` (one point, or a point per row)."""
    return ((v - c) ** 2).sum(axis=1)


@dataclass(frozen=True)
class Pivots:
    """Fixed pivot points and the pairs of them that lie apart."""

    points: np.ndarray
    first: np.ndarray
    second: np.ndarray
    apart: np.ndarray

    @classmethod
    def among(cls, pool: np.ndarray, n: int) -> "Pivots":
        """Points far from one another: each next one is the farthest from those chosen."""
        chosen = [0]
        nearest = squared(pool, pool[0])
        while len(chosen) < n and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(pool, pool[chosen[-1]]))
        points = pool[chosen]
        first, second = np.triu_indices(len(chosen), 1)
        return cls(points, first, second, np.sqrt(squared(points[first], points[second]).astype(float)) if len(first) else np.empty(0))

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(squared(v, p).astype(float)) for p in self.points], axis=1)

    def bounds(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Squared distances that each vector (pivot distances ``near``) surely has to each centroid (``far``), rounded down."""
        out = np.zeros((len(near), len(far)))
        for p, s, apart in zip(self.first, self.second, self.apart):
            a, b = near[:, p, None] * far[None, :, s], near[:, s, None] * far[None, :, p]
            np.maximum(out, (np.abs(a - b) - SLACK * (a + b)) / (apart * (1 + SLACK)), out=out)
        return np.floor(out * out * (1 - SLACK))


def nearest(v: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (of equals the smallest), its squared distance, and how many distances were computed."""
    lower = pivots.bounds(near, pivots.distances(centroids))
    label = lower.argmin(axis=1)
    tried = label.copy()
    best = squared(v, centroids[label])
    checked = len(v)
    for c in range(len(centroids)):
        todo = np.flatnonzero((lower[:, c] <= best) & (tried != c))
        d = squared(v[todo], centroids[c])
        checked += len(todo)
        better = (d < best[todo]) | ((d == best[todo]) & (c < label[todo]))
        at = todo[better]
        best[at], label[at] = d[better], c
    return label, best, checked


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims).astype(kind)


def _with_distances(vectors: DataFrame, pivots: Pivots, dims: int) -> DataFrame:
    schema = T.StructType([*vectors.schema.fields, T.StructField("near", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), _STEP):
                batch = whole.slice(a, _STEP)
                near = pivots.distances(_matrix(batch.column(1), dims, np.int64))
                offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * near.shape[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(near.reshape(-1)))], names=schema.names)

    return vectors.mapInArrow(run, schema)


def _labelled(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: Pivots) -> Iterator[tuple]:
    for whole in batches:
        for a in range(0, len(whole), _STEP):
            batch = whole.slice(a, _STEP)
            v = _matrix(batch.column("v"), centroids.shape[1], np.int64)
            near = _matrix(batch.column("near"), len(pivots.points), float)
            yield batch, v, *nearest(v, near, centroids, pivots)[:2]


def _moments(vectors: DataFrame, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray]:
    """Rows per centroid and their exact sums per component: ``k * dims`` rows from every task."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, v, label, _ in _labelled(batches, centroids, pivots):
            n += np.bincount(label, minlength=k)
            for c in np.unique(label):
                total[c] += v[label == c].sum(axis=0)
        at = np.flatnonzero(np.repeat(n, dims))
        columns = [at.astype(np.int32), np.repeat(n, dims)[at], total.reshape(-1)[at]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "n", "total"])

    parts = vectors.select("v", "near").mapInArrow(run, "at int, n long, total long")
    n, total = np.zeros(k * dims, np.int64), np.zeros(k * dims, np.int64)
    for r in parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        n[r["at"]], total[r["at"]] = r["n"], r["total"]
    return n.reshape(k, dims)[:, 0], total.reshape(k, dims)


def _assigned(vectors: DataFrame, centroids: np.ndarray, pivots: Pivots, key: str) -> DataFrame:
    schema = T.StructType([vectors.schema[key], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, label, best in _labelled(batches, centroids, pivots):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label.astype(np.int32)), pa.array(best)], names=schema.names)

    return vectors.mapInArrow(run, schema)


@dataclass
class Clustering:
    """Assignments ``(key, cluster, distance)``, the final centroids, and the squared distances summed over each."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int]


def cluster(
    df: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", dims: int = 64, scale: int = 1024, *,
    key: str = "vec_id", vector: str = "embedding",
) -> Clustering:
    """Lloyd's rounds from the ``k`` vectors whose sha256 of ``seed:key`` is least; then one more assignment.

    A non-empty centroid moves to the floor of its vectors' means, an empty one stays.
    """
    vectors = lattice(df, dims, scale, key=key, vector=vector)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    pool = vectors.select(drawn.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(max(POOL, k)).collect()
    if not pool:
        empty = vectors.select(key, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
        return Clustering(empty, np.empty((0, dims), np.int64), [])
    points = np.array([r["v"] for r in pool], dtype=np.int64)
    pivots, centroids = Pivots.among(points, PIVOTS), points[:k]
    staged = stage(_with_distances(vectors, pivots, dims))
    for _ in range(rounds):
        n, total = _moments(staged, centroids, pivots)
        centroids = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centroids)
    rows = _assigned(staged, centroids, pivots, key)
    inertia = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    return Clustering(rows, centroids, [inertia.get(c, 0) for c in range(len(centroids))])


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def per_cluster(values: list) -> Column:
    """The entry of a row's cluster; there are at most ``k``."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster"))
