"""Embedding near-dedup by randomised-rotation binary codes.

A unit vector o is rotated, and the signs of the result are its code; ``f = |o|_1 / sqrt(d)`` of the rotated vector is
its correction factor; both are computed from the whole vectors in every group that is compared, nothing is stored.  For a unit vector q, ``<sign(o), q> / sqrt(d) / f`` estimates ``<o, q>`` without bias, with a
standard error of ``sqrt((1 - f^2) / f^2 / (d - 1))``.  A pair whose estimate plus ``SIGMAS`` errors stays below the
threshold is done with; every other pair is recomputed in double precision, and that decides.

Pairs to estimate share a bucket: ``bits`` signs of a code under one of ``tables`` sets of signs.  Bits grow with the
logarithm of the number of vectors, so that buckets keep their size, and tables follow from the bits, so that a pair at
the threshold itself meets with a probability of at least ``RECALL``; closer pairs meet more often.  A bucket above
``BLOCK`` vectors is cut in blocks, and its pairs of blocks are separate groups.

Copies are one vector with a count.  A group gives, per vector, the number of its links (a pair counts in the first table
where it meets) and a spanning forest of the links, never the pairs themselves, so a dense group of n vectors sends n rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import Stage, maybe_broadcast

RECALL, SIGMAS, PER_BUCKET, BLOCK = 0.95, 4.0, 256, 2048


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a bucket and number of tables for ``n`` vectors."""
    bits = max(8, math.ceil(math.log2(max(n, 1) / PER_BUCKET)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


#: Rotations of a task, made once each.
_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random rotation of ``dim`` dimensions."""
    if (dim, k) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng([dim, k]).standard_normal((dim, dim)))
        _ROTATIONS[dim, k] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim, k]


def keys_of(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each vector in each table."""
    dim = unit.shape[1]
    turns = math.ceil(bits * tables / dim)
    signs = np.concatenate([(unit @ rotation(dim, k)) > 0 for k in range(turns)], axis=1)[:, : bits * tables]
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _deal(bits: int, tables: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                keys = keys_of(_units(_vectors(part.column("vec"))), bits, tables)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("copies"), part.column("dim"), pa.array(np.full(len(part), t, np.int32)), pa.array(keys[:, t].copy())],
                        ["id", "copies", "dim", "slot", "key"],
                    )

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a to b (places below n) as links to the least place of each component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            moved = np.flatnonzero(label != np.arange(n))
            return moved, label[moved]


def compare(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with a cosine of x[i] and y[j] at the threshold or above."""
    dim = x.shape[1]
    turn = rotation(dim, 0)
    ux, uy = _units(x), _units(y)
    rx, ry = ux @ turn, (uy @ turn).astype(np.float32)
    factor = np.abs(rx).sum(axis=1) / math.sqrt(dim)
    error = SIGMAS * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1))
    least = ((threshold - error) * factor * math.sqrt(dim)).astype(np.float32) - np.float32(1e-4)
    i, j = np.nonzero(np.where(rx > 0, np.float32(1), np.float32(-1)) @ ry.T >= least[:, None])
    sure = np.concatenate([(ux[i[k : k + 65536]] * uy[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)] or [np.zeros(0)]) >= threshold
    return i[sure], j[sure]


def _link(bits: int, tables: int, threshold: float) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        left, right = group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1))
        same = right.num_rows == 0  # a block with itself
        right = left if same else right
        if not left.num_rows or not right.num_rows:
            return _links_of([], [], [])
        x, y = _vectors(left.column("vec")), _vectors(right.column("vec"))
        slot = group.column("slot")[0].as_py()
        i, j = compare(x, y, threshold)
        if same:
            i, j = i[i < j], j[i < j]
        if slot and len(i):
            kx, ky = keys_of(_units(x), bits, tables), keys_of(_units(y), bits, tables)
            new = ~np.concatenate([(kx[i[k : k + 65536], :slot] == ky[j[k : k + 65536], :slot]).any(axis=1) for k in range(0, len(i), 65536)])
            i, j = i[new], j[new]
        ids = np.concatenate([left.column("id").to_numpy(), right.column("id").to_numpy()])
        copies = np.concatenate([left.column("copies").to_numpy(), right.column("copies").to_numpy()])
        j = j + len(x)
        counts = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        a, b = _forest(i, j, len(ids))
        linked = np.flatnonzero(counts)
        return _links_of(
            np.concatenate([ids[linked], ids[a]]), np.concatenate([counts[linked].astype(np.int64), np.zeros(len(a), np.int64)]),
            np.concatenate([ids[linked], ids[b]]),
        )

    return run


def _links_of(ids, counts, others) -> pa.Table:
    return pa.table([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(others, pa.int64())], ["id", "links", "other"])


def embedding_dedup(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (needs ``vec_id, embedding``).

    ``n_links`` counts the other rows found at a cosine of ``threshold`` or above, copies included; ``component_id`` is the
    least vec_id reachable over links; ``kept`` rows stand for their component.  A vector that is null, empty, zero or has a
    null or non-finite component links with nothing, nor do vectors of different lengths.  A null vec_id links with nothing
    and is not kept.  Rows that share a vec_id and differ count their links together.  An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    good = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    classes = Stage(good.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).withColumn("dim", F.size("vec")), "vectors")
    n = classes.df.count()
    bits, tables = plan(n, threshold)
    dealt = Stage(classes.df.mapInArrow(_deal(bits, tables), "id long, copies long, dim int, slot int, key long"), "buckets")
    bucket = ["dim", "slot", "key"]
    sizes = dealt.df.groupBy(*bucket).agg(F.count("*").alias("m")).filter("m > 1")
    blocks = sizes.select(*bucket, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    placed = dealt.df.join(blocks, bucket).withColumn("block", F.pmod(F.xxhash64("id", "slot"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("with", other).select(
        *bucket, "id", "copies", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), (F.col("block") > F.col("with")).cast("int").alias("side")
    )
    vecs = maybe_broadcast(classes.df.select("id", "vec", "dim"), n, 100_000)
    found = placed.join(vecs, ["id", "dim"]).groupBy(*bucket, "x", "y").applyInArrow(_link(bits, tables, threshold), "id long, links long, other long")
    links = Stage(found, "links")
    copies = good.join(classes.df, "vec").select(F.col("id").alias("a"), F.col("vec_id").alias("b"))
    component = components(links.df.filter("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")).unionAll(copies))
    counted = links.df.groupBy("id").agg(F.sum("links").alias("links"))
    known = (
        good.join(classes.df.select("vec", "id", "copies"), "vec").join(counted, "id", "left")
        .groupBy("vec_id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    dealt.drop()
    out = rows.select("vec_id").join(known, "vec_id", "left").join(component.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"))
