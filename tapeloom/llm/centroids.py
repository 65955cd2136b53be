"""Centroid clustering in exact integers; nearest centroids by Orchard search.

Every centroid has the list of all centroids in order of distance from it.  A vector walks the list of the centroid it
holds; a closer one found (or an equal one with a smaller number) is held from then on and its list is walked from the
start.  Centroids already measured are marked and not measured again.  The walk stops at a centroid strictly further from
the held one than twice the vector's distance: by the triangle inequality it and all behind it are strictly further from the
vector.  A run of vectors walks at once in numpy, each with its own list and place.

A round sends one row of sums per centroid and task to the shuffle; the driver sees one row a centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Stage

RUN = 8192


def limit_of(dim: int) -> int:
    """Components up to this keep four times a squared distance within a long."""
    return 1 << ((59 - max(dim - 1, 1).bit_length()) // 2)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each centroid, all centroids by distance (ties: smaller number), and those squared distances."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, axis=1)


def orchard(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number) and squared distance of each row of ``x``, and how many distances were measured."""
    n, k = len(x), len(centroids)
    held, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    dist = ((x - centroids[0]) ** 2).sum(axis=1)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    walking, measured = np.arange(n), n
    while len(walking):
        h, p = held[walking], at[walking]
        on = p < k
        on[on] = apart[h[on], p[on]] <= 4 * dist[walking[on]]
        walking = walking[on]
        j = order[h[on], p[on]]
        at[walking] += 1
        fresh = ~seen[walking, j]
        rows, j = walking[fresh], j[fresh]
        seen[rows, j] = True
        d = ((x[rows] - centroids[j]) ** 2).sum(axis=1)
        measured += len(rows)
        closer = (d < dist[rows]) | ((d == dist[rows]) & (j < held[rows]))
        rows = rows[closer]
        held[rows], dist[rows], at[rows] = j[closer], d[closer], 0
    return held, dist, measured


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    order, apart = neighbours(centroids)
    for batch in batches:
        for start in range(0, batch.num_rows, RUN):
            part = batch.slice(start, RUN)
            x = _matrix(part, centroids.shape[1])
            yield part, x, *orchard(x, centroids, order, apart)[:2]


def _sums(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        total, count = [[0] * dim for _ in range(k)], np.zeros(k, np.int64)
        for _, x, held, _ in _assigned(batches, centroids):
            count += np.bincount(held, minlength=k)
            for c in np.unique(held).tolist():
                total[c] = [a + b for a, b in zip(total[c], x[held == c].sum(axis=0).tolist())]
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(count[used]), pa.array([total[c] for c in used], pa.list_(pa.decimal128(38, 0)))], ["cluster", "n", "total"]
            )

    return run


def _nearest(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, held, dist in _assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(held, pa.int32()), pa.array(dist)], ["vec_id", "cluster", "distance"])

    return run


def moved(centroids: np.ndarray, vectors: DataFrame) -> np.ndarray:
    """Every centroid at the floor of the mean of its vectors; one without vectors stays."""
    parts = vectors.mapInArrow(_sums(centroids), "cluster int, n long, total array<decimal(38,0)>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for row in sums.collect():  # k x dim rows
        out[row.cluster, row.d] = int(row.s) // row.n
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept row of ``vectors`` (needs
    ``vec_id, embedding``).

    Kept are vectors with exactly ``dim`` components, none null or non-finite; a component x counts as floor(scale * x).
    Kept rows with the smallest sha256 of ``seed:vec_id`` are the first ``k`` centroids, ties by components, a null vec_id
    last; with fewer rows there are fewer centroids.  After ``rounds`` moves every row is assigned once more.  Equal
    centroids tie, and the smaller number wins.  Repeated rows count each.  Rows with an integer of ``limit_of(dim)`` or
    more in size (at 64 components 2^26) are not kept, since squared distances would not fit a long; an inertia that does not is null.  Other columns are
    ignored.  Without kept rows, or from an empty table, no rows come.
    """
    vec = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    most = float(limit_of(dim))
    fits = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < most), F.lit(False)))
    rows = vectors.filter((F.size("embedding") == dim) & fits).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    kept = Stage(rows, "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.df.orderBy(drawn.asc_nulls_last(), "vec").limit(k).select("vec").collect()
    if not first:
        return kept.df.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    centroids = np.array([r.vec for r in first], np.int64)
    for _ in range(rounds):
        fresh = moved(centroids, kept.df)
        if (fresh == centroids).all():
            break  # further rounds would give the same
        centroids = fresh
    placed = Stage(kept.df.mapInArrow(_nearest(centroids), "vec_id long, cluster int, distance long"), "clusters")
    kept.drop()
    inertia = placed.df.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    totals = {r.cluster: int(r.s) for r in inertia.collect()}  # k rows
    whole = sum(totals.values())
    long = lambda s: s if s < 1 << 63 else None
    table = [(c, long(s), long(whole), digest(centroids[c])) for c, s in sorted(totals.items())]
    named = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.df.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
