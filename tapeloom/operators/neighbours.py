"""Mutual information of continuous columns from nearest neighbours (Kraskov, Stoegbauer and Grassberger, first estimator).

Every pair (feature, target) of a row is a point.  Its radius is the distance to its k-th nearest neighbour in the maximum
norm; the counts of points closer than that in either coordinate alone give the information.

Points of a feature are cut into slabs by feature and each slab into cells by target, both by quantiles, so a cell is as
narrow in one coordinate as in the other.  A point finds its nearest ones in its own cell; where its radius reaches beyond
the cell, it is sent to the cells it reaches, which answer with their nearest ones, if nearer: few points at any size.
Counts in one coordinate are differences of ranks: points ahead of a run of neighbouring values, and places inside the one
run that holds the value asked for.  A task holds one cell or run and the points that ask it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.numeric import finite
from ..session import written
from .prepare import train_rows

# ---- fixed values: neighbours, size of the noise that parts equal values ----
NEIGHBOURS, NOISE = 3, 1e-10
# ---- end of fixed values ----

#: Points of a run or a cell, about.
RUN = 1024


def digamma(x: Column) -> Column:
    """For numbers from 1 on, to about 11 digits."""
    y = x + 8.0
    series = F.ln(y) - 0.5 / y - 1.0 / (12.0 * y * y) + 1.0 / (120.0 * F.pow(y, 4.0)) - 1.0 / (252.0 * F.pow(y, 6.0)) + 1.0 / (240.0 * F.pow(y, 8.0))
    return series - sum((1.0 / (x + float(i)) for i in range(8)), F.lit(0.0))


def _noise(number: Column, name: Column) -> Column:
    """An even number from -1 to 1 that any task can draw again."""
    return F.xxhash64(number, name).cast("double") / float(1 << 63)


def neighbour_points(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """``feature, id, x, y``: both columns in units of their deviation over the training rows, equal values parted by noise.

    Rows without a finite target are left out, and a feature's rows without a finite value of it.  A constant column keeps
    its values.
    """
    columns = [target, *features]
    train = train_rows(df).select(*[finite(c).alias(f"__{i}") for i, c in enumerate(columns)]).filter("__0 IS NOT NULL")
    train = written(train.select(F.monotonically_increasing_id().alias("id"), "*"), "points")
    sizes = train.agg(*[f(f"__{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("s", F.stddev_pop), ("m", lambda c: F.avg(F.abs(c))))]).first()

    def scaled(i: int) -> Column:
        spread = sizes[f"s{i}"] or 1.0
        size = max(1.0, (sizes[f"m{i}"] or 0.0) / spread)
        return F.col(f"__{i}") / spread + NOISE * size * _noise(F.col("id"), F.lit(i))

    each = F.array(*[F.struct(F.lit(f).alias("feature"), scaled(i).alias("x")) for i, f in enumerate(features, 1)])
    long = train.select("id", scaled(0).alias("y"), F.explode(each).alias("p")).select("p.feature", "id", "p.x", "y")
    return written(long.filter("x IS NOT NULL"), "scaled-points")


Cuts = dict[str, np.ndarray]


def _cuts(points: DataFrame, key: str, value: str, run: int) -> Cuts:
    """Values at which the runs of each key begin, a few numbers per run."""
    sizes = {r[0]: r[1] for r in points.groupBy(key).count().collect()}
    most = max([-(-n // run) for n in sizes.values()], default=1)
    if most < 2:
        return {k: np.zeros(0) for k in sizes}
    probs = [i / most for i in range(1, most)]
    found = points.groupBy(key).agg(F.percentile_approx(value, probs, 20 * most).alias("cuts")).collect()
    return {r[0]: np.unique(np.array(r.cuts, float)) for r in found}


def _placed(cuts: Cuts, key: str, value: str) -> Callable:
    """Adds ``run``, the run that holds the value."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(key).to_pylist(), object)
            values, run = batch.column(value).to_numpy(zero_copy_only=False), np.zeros(len(batch), np.int32)
            for name in set(names.tolist()):
                at = names == name
                run[at] = np.searchsorted(cuts[name], values[at], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run)], [*batch.schema.names, "run"])

    return place


#: Per feature: bounds of its slabs, bounds of the cells of each slab, number of the first cell of each slab.
Cells = dict[str, tuple[np.ndarray, list[np.ndarray], np.ndarray]]


def _off_noise(cuts: np.ndarray) -> np.ndarray:
    """Cuts moved between the values that noise has parted, so that none lies among equal ones."""
    if not len(cuts):
        return cuts
    step = 100.0 * NOISE * max(1.0, float(np.abs(cuts).max()))
    return np.unique((np.floor(cuts / step) + 0.5) * step)


def _cells(points: DataFrame, run: int) -> Cells:
    """Slabs and cells of each feature with about ``run`` points a cell; a few numbers per cell.

    Bounds of slabs lie off the noise, so equal values share a slab, however many; a larger slab has more cells.
    """
    sizes = {r[0]: r[1] for r in points.groupBy("feature").count().collect()}
    largest = max(sizes.values(), default=0)
    slabs = max(1, round((-(-largest // run)) ** 0.5))
    cuts = {k: _off_noise(c) for k, c in _cuts(points, "feature", "x", max(1, -(-largest // slabs))).items()}
    in_slab = points.mapInArrow(_placed(cuts, "feature", "x"), "feature string, id long, x double, y double, run int")
    held = {(r.feature, r.run): r.n for r in in_slab.groupBy("feature", "run").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = -(-max(held.values(), default=0) // run)
    inner: dict[tuple[str, int], np.ndarray] = {}
    if each > 1:
        probs = [i / each for i in range(1, each)]
        found = in_slab.groupBy("feature", "run").agg(F.percentile_approx("y", probs, 20 * each).alias("cuts")).collect()
        for r in found:  # every so many of the bounds that the largest slab needs
            step = max(1, each * run // held[(r.feature, r.run)])
            inner[(r.feature, r.run)] = np.unique(np.array(r.cuts, float)[step - 1 :: step])
    out = {}
    for name, bounds in cuts.items():
        rows = [inner.get((name, i), np.zeros(0)) for i in range(len(bounds) + 1)]
        out[name] = bounds, rows, np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])])[:-1]
    return out


def _ranges(cells: tuple[np.ndarray, list[np.ndarray], np.ndarray], slab: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first and the last cell of a slab that hold targets from ``low`` to ``high``."""
    _, rows, first = cells
    a, b = np.zeros(len(slab), np.int64), np.zeros(len(slab), np.int64)
    for s in np.unique(slab):
        at = slab == s
        a[at], b[at] = first[s] + np.searchsorted(rows[s], low[at], "right"), first[s] + np.searchsorted(rows[s], high[at], "right")
    return a, b


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places repeated for every number from ``low`` to ``high``, and these numbers."""
    n = high - low + 1
    row = np.repeat(np.arange(len(low)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


def _in_cells(cells: Cells) -> Callable:
    """Adds ``run``, the cell that holds the point."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("feature").to_pylist(), object)
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in "xy")
            run = np.zeros(len(batch), np.int32)
            for name in set(names.tolist()):
                at = names == name
                run[at] = _ranges(cells[name], np.searchsorted(cells[name][0], x[at], "right"), y[at], y[at])[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run)], [*batch.schema.names, "run"])

    return place


def _distances(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    return np.maximum(np.abs(x[:, None] - px[None, :]), np.abs(y[:, None] - py[None, :]))


def _nearest(d: np.ndarray, k: int) -> np.ndarray:
    """The k least of each row in order, infinite where there are fewer."""
    if d.shape[1] < k:
        d = np.hstack([d, np.full((len(d), k - d.shape[1]), np.inf)])
    return np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1)


def _numbers(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in names]


def _in_own_run(k: int) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        x, y = _numbers(t, "x", "y")
        out = []
        for start in range(0, len(x), 512):
            d = _distances(x[start : start + 512], y[start : start + 512], x, y)
            d[np.arange(len(d)), np.arange(start, start + len(d))] = np.inf  # itself
            out.append(_nearest(d, k))
        return t.append_column("near", pa.array(list(np.vstack(out)), pa.list_(pa.float64())))

    return run


def _reached(cells: Cells) -> Callable:
    """A row per other cell that a point's radius reaches."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            x, y, own = _numbers(t, "x", "y", "run")
            radius = np.array([n[-1] for n in t.column("near").to_pylist()])
            names = np.array(t.column("feature").to_pylist(), object)
            rows, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for name in set(names.tolist()):
                at = np.flatnonzero(names == name)
                bounds = cells[name][0]
                near, slab = _spread(np.searchsorted(bounds, x[at] - radius[at], "right"), np.searchsorted(bounds, x[at] + radius[at], "right"))
                at = at[near]
                place, cell = _spread(*_ranges(cells[name], slab, y[at] - radius[at], y[at] + radius[at]))
                rows.append(at[place])
                to.append(cell)
            row, cell = np.concatenate(rows), np.concatenate(to)
            row, cell = row[cell != own[row]], cell[cell != own[row]]
            asks = t.select(["feature", "id", "x", "y"]).take(pa.array(row)).append_column("run", pa.array(cell.astype(np.int32)))
            yield from asks.append_column("radius", pa.array(radius[row])).combine_chunks().to_batches()

    return reach


def _in_other_run(k: int) -> Callable:
    def run(asks: pa.Table, points: pa.Table) -> pa.Table:
        schema = pa.schema([("feature", pa.string()), ("id", pa.int64()), ("near", pa.list_(pa.float64()))])
        if not asks.num_rows or not points.num_rows:
            return schema.empty_table()
        x, y, radius, ids = _numbers(asks, "x", "y", "radius", "id")
        px, py = _numbers(points, "x", "y")
        near = np.vstack([_nearest(_distances(x[s : s + 512], y[s : s + 512], px, py), k) for s in range(0, len(x), 512)])
        some = near[:, 0] < radius
        return pa.table([asks.column("feature").filter(pa.array(some)), pa.array(ids[some]), pa.array(list(near[some]), pa.list_(pa.float64()))], schema=schema)

    return run


def _ranked(queries: pa.Table, points: pa.Table) -> pa.Table:
    """Per query, points of its run below the value, those equal to it included if it asks so."""
    schema = pa.schema([("key", pa.string()), ("run", pa.int32()), ("id", pa.int64()), ("sign", pa.int32()), ("inside", pa.int64())])
    if not queries.num_rows:
        return schema.empty_table()
    value, equal = _numbers(queries, "v", "equal")
    own = np.sort(_numbers(points, "v")[0]) if points.num_rows else np.zeros(0)
    inside = np.where(equal.astype(bool), np.searchsorted(own, value, "right"), np.searchsorted(own, value, "left"))
    return pa.table([queries.column("key"), queries.column("run"), queries.column("id"), queries.column("sign"), pa.array(inside.astype(np.int64))], schema=schema)


def _closer(points: DataFrame, radii: DataFrame, run: int) -> DataFrame:
    """``feature, id, closer_x, closer_y``: other points nearer than the radius in that coordinate alone.

    A point asks for the ranks of both ends of its open interval; it counts itself, which is taken off.
    """
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v"), F.lit(a == "x").alias("is_x")) for a in "xy"]))
    tall = points.join(radii, ["feature", "id"]).select("feature", "id", "radius", axes.alias("a"))
    tall = tall.select(F.concat("a.axis", F.lit(":"), "feature").alias("key"), "feature", "id", "radius", "a.v", "a.is_x")
    cuts = _cuts(tall, "key", "v", run)
    kinds = "key string, feature string, id long, radius double, v double, is_x boolean, run int"
    placed = written(tall.mapInArrow(_placed(cuts, "key", "v"), kinds), "axes")
    ends = F.explode(F.array(*[
        F.struct(F.lit(sign).alias("sign"), (F.col("v") + sign * F.col("radius")).alias("v"), F.lit(equal).alias("equal")) for sign, equal in ((1, False), (-1, True))
    ]))
    asked = placed.select("key", "id", ends.alias("e")).select("key", "id", "e.sign", "e.v", "e.equal")
    asked = asked.mapInArrow(_placed(cuts, "key", "v"), "key string, id long, sign int, v double, equal boolean, run int")
    inside = asked.groupBy("key", "run").cogroup(placed.select("key", "run", "v").groupBy("key", "run"))
    inside = inside.applyInArrow(_ranked, "key string, run int, id long, sign int, inside long")
    ahead = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    every = spread_runs(placed.sparkSession, cuts).join(placed.groupBy("key", "run").count(), ["key", "run"], "left")
    before = every.select("key", "run", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    rank = F.col("sign") * (F.col("before") + F.col("inside"))
    counts = inside.join(before, ["key", "run"]).groupBy("key", "id").agg((F.sum(rank) - 1).alias("closer"))
    named = counts.select(F.substring("key", 3, 1 << 20).alias("feature"), "id", F.when(F.col("key").startswith("x:"), F.col("closer")).alias("x"), F.when(F.col("key").startswith("y:"), F.col("closer")).alias("y"))
    return named.groupBy("feature", "id").agg(F.max("x").alias("closer_x"), F.max("y").alias("closer_y"))


def spread_runs(spark: SparkSession, cuts: Cuts) -> DataFrame:
    """``key, run`` of every run, empty ones too."""
    return spark.createDataFrame([(k, i) for k, c in cuts.items() for i in range(len(c) + 1)], "key string, run int")


def radii_of(points: DataFrame, k: int = NEIGHBOURS, run: int = RUN) -> DataFrame:
    """``feature, id, radius``: the distance of each point to its k-th nearest neighbour; infinite with k points or fewer."""
    cells = _cells(points, run)
    placed = written(points.mapInArrow(_in_cells(cells), "feature string, id long, x double, y double, run int"), "cells")
    near = "feature string, id long, x double, y double, run int, near array<double>"
    own = written(placed.groupBy("feature", "run").applyInArrow(_in_own_run(k), near), "near")
    asks = own.mapInArrow(_reached(cells), "feature string, id long, x double, y double, run int, radius double")
    other = asks.groupBy("feature", "run").cogroup(placed.groupBy("feature", "run")).applyInArrow(_in_other_run(k), "feature string, id long, near array<double>")
    both = own.select("feature", "id", "near").unionByName(other).groupBy("feature", "id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))  # k a run
    return written(both.select("feature", "id", F.col("near")[k - 1].alias("radius")), "radii")


def neighbour_information(df: DataFrame, features: list[str], target: str, k: int = NEIGHBOURS, run: int = RUN) -> DataFrame:
    """``feature, n, score``: mutual information with the target in nats, at least 0, over the training rows.

    A feature with no more than ``k`` points has no score; one without any has no row.
    """
    return information_of(neighbour_points(df, features, target), k, run)


def information_of(points: DataFrame, k: int = NEIGHBOURS, run: int = RUN) -> DataFrame:
    """The same from the written points of :func:`neighbour_points`; their noise depends on the places of the rows."""
    radii = radii_of(points, k, run)
    counts = _closer(points, radii.filter(F.col("radius") < float("inf")), run)
    terms = digamma(F.col("closer_x") + 1.0) + digamma(F.col("closer_y") + 1.0)
    sums = counts.groupBy("feature").agg(F.avg(terms).alias("terms"))
    n = F.col("n").cast("double")
    score = F.when(F.col("n") > k, F.greatest(digamma(n) + digamma(F.lit(float(k))) - F.col("terms"), F.lit(0.0)))
    return points.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).join(sums, "feature", "left").select("feature", "n", score.alias("score"))
