"""Clusters around integer centroids, with a table of distances to fixed pivots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indemna.llm.common import settle

#: Components beyond this, as integers, could have squared distances that no long holds.
LARGEST = 2**27
#: Vectors that are compared at once.
_ROWS = 2048

Batches = Iterator[pa.RecordBatch]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _nested(rows: np.ndarray) -> pa.Array:
    """A list column from the rows of a matrix."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def _whole(dims: int, scale: int) -> Callable[[Batches], Batches]:
    """(vec_id, v) of the vectors that have ``dims`` finite components: floor(scale * component)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False)
            batch = batch.filter(fits)
            x = _matrix(batch.column(1), dims)
            finite = np.isfinite(x).all(1)
            with np.errstate(over="ignore"):
                v = np.floor(scale * x[finite])
            if v.size and np.abs(v).max() > LARGEST:
                raise ValueError(f"a component times {scale} is beyond {LARGEST}, so that squared distances need not fit into a long")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(finite)), _nested(v.astype(np.int32))], names=["vec_id", "v"])

    return run


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact squared distances of the rows of ``a`` from ``b``."""
    diff = a - b
    return np.einsum("ij,ij->i", diff, diff)


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the points, each as far as can be from those before it, the first one first; equal points once."""
    chosen, near = [0], squared(points, points[0])
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(points, points[chosen[-1]]))
    return points[chosen]


def nearest(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row of ``v``, the squared distance, and how many centroids were measured.

    A centroid is no nearer than its distance from a pivot differs from that of the vector. The one with the least bound is
    measured first; all whose bound doesn't exceed this distance are measured too, in integers, ties to the smaller number.
    The distances from pivots are rounded, so a bound has to exceed it by more than this could make.
    """
    from_pivots = np.sqrt(np.stack([squared(centroids, p) for p in pivots], 1).astype(np.float64))
    bound = np.zeros((len(v), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - from_pivots[None, :, p]), out=bound)
    cluster = bound.argmin(1)
    best = squared(v, centroids[cluster])
    rounded = 1e-9 * (1 + to_pivots.max(initial=0) + from_pivots.max(initial=0))
    open_ = bound <= (np.sqrt(best.astype(np.float64)) + rounded)[:, None]
    for j in range(len(centroids)):
        rows = np.flatnonzero(open_[:, j])
        d = squared(v[rows], centroids[j])
        better = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = d[better], j
    return cluster, best, open_.sum(1)


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, n_pivots: int = 8) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid, n_measured) of the vectors of ``vectors`` (vec_id, embedding).

    Vectors with exactly ``dims`` components, none null or non-finite, are kept, as integers floor(scale * component); others
    have no row. The centroids start as the ``k`` kept vectors with the least SHA-256 of ``seed:vec_id``, or all if there
    are fewer. Each round assigns every vector to the nearest centroid, on a tie to that of the smaller number, and moves every
    centroid that has vectors to the floor of their mean; a last assignment follows. distance is squared, inertia its sum
    over all and cluster_inertia over the cluster; n_measured counts the exact distances that the last assignment took.

    Rows that repeat a vec_id are vectors of their own; if both start centroids, the one with the lesser components comes
    first. A null vec_id starts none; if no vector has an id, one centroid starts in the origin. Other columns are ignored. No vectors give no rows. A component beyond ``LARGEST``, as an
    integer, raises an error: no long holds all such distances.

    Distances to up to ``n_pivots`` of the first centroids, far from each other, are stored with the vectors once, in the shared
    folder. Tasks read this table each round and pass on one row a centroid with a count and sums of components. What goes to and from the driver are ``k`` centroids.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    whole = own.mapInArrow(_whole(dims, scale), "vec_id long, v array<int>")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.where("vec_id is not null").select("v", digest.alias("digest")).orderBy("digest", "v").limit(k).collect()
    centroids = np.array([r.v for r in first] or [[0] * dims], np.int64)
    pivots = far_apart(centroids, n_pivots)

    def measure(batches: Batches) -> Batches:
        for batch in batches:
            v = _matrix(batch.column(1), dims).astype(np.int64)
            d = np.sqrt(np.stack([squared(v, p) for p in pivots], 1).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, _nested(d)], names=["vec_id", "v", "to_pivots"])

    table = settle(whole.mapInArrow(measure, "vec_id long, v array<int>, to_pivots array<double>"))

    def assigned(batches: Batches, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, _ROWS):
                batch = whole_batch.slice(i, _ROWS)
                v = _matrix(batch.column(1), dims).astype(np.int64)
                yield batch.column(0), v, *nearest(v, _matrix(batch.column(2), len(pivots)), centroids, pivots)

    for _ in range(rounds):
        given = centroids

        def sums(batches: Batches, given: np.ndarray = given) -> Batches:
            n, total = np.zeros(len(given), np.int64), np.zeros(given.shape, np.int64)
            for _, v, cluster, _, _ in assigned(batches, given):
                n += np.bincount(cluster, minlength=len(given))
                np.add.at(total, cluster, v)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), _nested(total[used])], names=["cluster", "n", "total"])

        told = table.mapInArrow(sums, "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("at", "c"))
        centroids = given.copy()
        for r in told.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect():  # k * dims rows
            centroids[r.cluster, r["at"]] = r.c // r.n

    final = centroids

    def last(batches: Batches) -> Batches:
        for ids, _, cluster, best, measured in assigned(batches, final):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(best), pa.array(measured.astype(np.int32))], names=["vec_id", "cluster", "distance", "n_measured"])

    rows = settle(table.mapInArrow(last, "vec_id long, cluster int, distance long, n_measured int"))
    inertia = {r.cluster: r.d for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    about = [(j, c.tolist(), inertia[j], sum(inertia.values())) for j, c in enumerate(final) if j in inertia]
    about = rows.sparkSession.createDataFrame(about, "cluster int, centroid array<long>, cluster_inertia long, inertia long")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "n_measured")
