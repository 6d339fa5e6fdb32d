"""Centroid clustering in integers, by partial-distance search.

Vectors become integers. A round broadcasts the centroids (a fixed number of short vectors); tasks
assign their vectors and add up what they have read: for each centroid a count, the sums of the
components and of the distances. Only these few rows are shuffled; the exact sums of Spark make the
new centroids. Nothing is kept between rounds but the centroids: a lost task is read again.

The search goes through the dimensions in the order of their variance over all vectors, a few at a
time. A vector's best is first the centroid that the first dimensions favour, taken to the end. A
centroid is dropped for a vector once its partial sum is strictly above the vector's best; those that
survive are summed over all dimensions, so distances are exact, and of equal ones the smaller number
stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared

DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Dimensions summed between two looks at what can be dropped.
STRIDE = 8
#: Larger components stand for this one: squared distances over 64 dimensions then fit in 62 bits.
LARGEST = 1 << 27
#: Vectors searched at once.
BLOCK = 4096


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (integers floor(scale * x)) of the vectors that have as many components, none null or non-finite."""
    prepared(vectors.sparkSession)
    e = F.col("embedding").cast("array<double>")
    fine = (F.size(e) == dimensions) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.floor(F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), x * scale))).cast("int")
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, whole).alias("v"))


def starts(rows: DataFrame, clusters: int, seed: int = 1) -> np.ndarray:
    """The vectors of the least hashes of their ids, in that order. Equal ids: in the order of the vectors. Null ids are none."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.where("vec_id is not null").orderBy(order, "v").limit(clusters).select("v").collect()
    return np.array([r.v for r in found], np.int64)


def _rows(batch: pa.RecordBatch, at: int) -> np.ndarray:
    column = batch.column(at)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def spread(rows: DataFrame, dimensions: int) -> np.ndarray:
    """Dimensions by falling variance over all vectors (of equal ones the smaller first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        for batch in batches:
            v = _rows(batch, 0).astype(np.float64)
            n, total, squares = n + len(v), total + v.sum(axis=0), squares + (v * v).sum(axis=0)
        d = pa.array(np.arange(dimensions, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([d, pa.array(np.full(dimensions, n)), pa.array(total), pa.array(squares)], names=["d", "n", "total", "squares"])

    sums = rows.select("v").mapInArrow(run, "d int, n bigint, total double, squares double")
    sums = sums.groupBy("d").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).collect()
    variance = {r.d: r.squares / r.n - (r.total / r.n) ** 2 for r in sums if r.n}
    return np.array(sorted(range(dimensions), key=lambda d: (-variance.get(d, 0.0), d)))


def nearest(v: np.ndarray, centroids: np.ndarray, order: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row of v; order is that of the dimensions."""
    v, c = np.ascontiguousarray(v[:, order].T), centroids[:, order]
    head = sum((v[d][:, None] - c[:, d][None, :]) ** 2 for d in range(min(stride, len(order))))
    best = head.argmin(axis=1).astype(np.int32)
    of = c[best].T
    least = head[np.arange(len(best)), best] + sum(((v[d] - of[d]) ** 2 for d in range(stride, len(order))), np.zeros(len(best), np.int64))
    first = best.copy()
    for k in range(len(c)):
        rows = np.flatnonzero((head[:, k] <= least) & (first != k))
        far = head[rows, k]
        for at in range(stride, len(order), stride):
            if not len(rows):
                break
            for d in range(at, min(at + stride, len(order))):
                far = far + (v[d][rows] - c[k, d]) ** 2
            stay = far <= least[rows]
            rows, far = rows[stay], far[stay]
        closer = (far < least[rows]) | (best[rows] > k)
        best[rows[closer]], least[rows[closer]] = k, far[closer]
    return best, least


def assigned(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                best, least = nearest(_rows(part, 1), centroids, order)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best), pa.array(least)], names=["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def totals(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Of each centroid that has vectors their number, the sum of their distances and of their components, exact."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, sums = np.zeros(len(centroids), np.int64), [0] * len(centroids), np.zeros((len(centroids), size), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                v = _rows(batch.slice(at, BLOCK), 0)
                best, least = nearest(v, centroids, order)
                for k in np.unique(best).tolist():
                    own = best == k
                    n[k] += own.sum()
                    inertia[k] += sum(least[own].tolist())
                    sums[k] += v[own].sum(axis=0)
        for k in np.flatnonzero(n).tolist():
            columns = [pa.array([k] * (size + 1), pa.int32()), pa.array(np.arange(-1, size), pa.int32()), pa.array([n[k]] * (size + 1))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([str(inertia[k]), *map(str, sums[k].tolist())])], names=["cluster", "d", "n", "total"])

    parts = rows.select("v").mapInArrow(run, "cluster int, d int, n bigint, total string")
    found: dict[int, tuple[int, int, list[int]]] = {}
    for r in parts.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("cluster", "d").collect():
        if r.d < 0:
            found[r.cluster] = (r.n, int(r.total), [])
        else:
            found[r.cluster][2].append(int(r.total))
    return found


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or hold null or non-finite components are left out, as
    are other columns. The centroids start as the vectors with the least sha256 of `seed:vec_id`; with
    fewer vectors there are fewer, with none no rows. Each round assigns all vectors and replaces
    every centroid that has some by the floor of their mean; a last assignment follows. Ties go to the
    smaller number. Rows that repeat a vec_id are vectors of their own; rows without one are never a
    start. Components of 2**27 and more, scaled, count as 2**27 (and so below zero); sums of
    distances beyond a long are the largest long.
    """
    rows = kept(vectors, dimensions, scale)
    centroids = starts(rows, clusters, seed)
    if not len(centroids):
        if rows.isEmpty():
            return rows.select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
        centroids = np.zeros((1, dimensions), np.int64)  # vectors without ids alone: one cluster, from zero
    order = spread(rows, dimensions)
    for _ in range(rounds):
        for k, (n, _, sums) in totals(rows, centroids, order).items():
            centroids[k] = [s // n for s in sums]
    last = totals(rows, centroids, order)
    largest = (1 << 63) - 1
    inertia = min(largest, sum(x[1] for x in last.values()))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = F.array(*(F.struct(F.lit(min(largest, last[k][1] if k in last else 0)).cast("long").alias("inertia"), F.lit(s).alias("sha")) for k, s in enumerate(sha)))
    out = assigned(rows, centroids, order).withColumn("own", each[F.col("cluster")])
    return out.select("vec_id", "cluster", "distance", F.col("own.inertia").alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), F.col("own.sha").alias("centroid_sha256"))
