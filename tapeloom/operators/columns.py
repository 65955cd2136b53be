"""Passes over many columns at once, a column of a batch being one array.

An expression per column makes a method too large to be compiled, and a row per value makes a hundred times the rows.  Here
a task counts or sums the arrays of its batches, and a few numbers per column leave it.  Columns reach a task packed into
one, because the size of a batch is taken after every row, column by column.  Functions that run in tasks are pickled by
value, so executors need numpy and pyarrow but no copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns that are read together; the reader of many is a method too large to be compiled.
WIDTH = 20
#: Parts of a result that are merged by as many tasks before the driver merges theirs.
MERGERS = 8
#: Buckets a column may hold before equal ones are added up.
HELD = 200_000

#: A range of a column that is counted: slot, bounds, and width of its buckets (0: one per value; None: the leading bits).
Range = tuple[int, float, float, float | None]


def _packed(df: DataFrame, picked: list[Column]) -> DataFrame:
    return df.select(F.array(*[c.cast("double") for c in picked]).alias("packed"))


def _by_columns(df: DataFrame, picked: list[Column], work: Callable[[int], Callable], schema: str, beside: list[Column] = ()) -> DataFrame:
    """``work(place of the first)`` over some columns at a time, each time after those ``beside``."""
    parts = [_packed(df, [*beside, *picked[i : i + WIDTH]]).mapInArrow(work(i), schema) for i in range(0, len(picked), WIDTH)]
    return reduce(DataFrame.unionByName, parts)


def _named(columns: list[str]) -> list[Column]:
    return [F.col(c) for c in columns]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """A line per column, NaN for NULL, and which values are there (None: all)."""
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(0).flatten()
            lines = lambda x: np.ascontiguousarray(x.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T)  # noqa: E731, B023
            yield lines(flat), lines(flat.is_valid()) if flat.null_count else None


# ---- missing values ----


def _nulls(first: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, nulls = 0, None
        for lines, there in _unpacked(batches):
            rows += lines.shape[1]
            own = np.zeros(len(lines), np.int64) if there is None else (~there).sum(axis=1)
            nulls = own if nulls is None else nulls + own
        if nulls is not None:
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(nulls), dtype=np.int32) + np.int32(first)), "nulls": pa.array(nulls), "rows": pa.array(np.full(len(nulls), rows))})

    return count


def null_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Share of NULL per column; 1 without rows."""
    plain = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    picked = [(F.col(c) if c in plain else F.when(F.col(c).isNotNull(), 0)) for c in columns]
    if not picked:
        return {}
    counts = _by_columns(df, picked, _nulls, "place int, nulls long, rows long")
    found = {r.place: r.nulls / r.rows for r in counts.groupBy("place").agg(F.sum("nulls").alias("nulls"), F.sum("rows").alias("rows")).filter("rows > 0").collect()}
    return {c: found.get(i, 1.0) for i, c in enumerate(columns)}


# ---- counts of values in buckets ----


def _ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles, equal only for equal ones."""
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _runs(bucket: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """``bucket, n, lo, hi`` with every bucket once."""
    bucket, n, lo, hi = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(bucket, kind="stable")
    start = _runs(bucket[order])
    return bucket[order][start], np.add.reduceat(n[order], start), np.minimum.reduceat(lo[order], start), np.maximum.reduceat(hi[order], start)


def _counts(places: list[int], ranges: dict[int, list[Range]]) -> Callable[[int], Callable]:
    def work(first: int) -> Callable:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[tuple[int, int], list] = {}
            held: dict[tuple[int, int], int] = {}
            for lines, _ in _unpacked(batches):
                for i, v in enumerate(lines):
                    v = v[np.isfinite(v)] + 0.0  # one zero
                    v.sort()
                    for slot, low, high, step in ranges[places[first + i]]:
                        own = v[np.searchsorted(v, low, "left") : np.searchsorted(v, high, "right")]
                        if not len(own):
                            continue
                        bucket = _ordered(own) >> 46 if step is None else np.floor((own - low) / step).astype(np.int64) if step else _ordered(own)
                        start = _runs(bucket)
                        end = np.append(start[1:], len(own))
                        key = places[first + i], slot
                        parts.setdefault(key, []).append((bucket[start], end - start, own[start], own[end - 1]))
                        held[key] = held.get(key, 0) + len(start)
                        if held[key] > HELD:
                            parts[key] = [_merged(parts[key])]
                            held[key] = len(parts[key][0][0]) // 2  # twice as many at least before the next time
            for (place, slot), some in parts.items():
                bucket, n, lo, hi = _merged(some)
                same = lambda x: pa.array(np.full(len(bucket), x, np.int32))
                yield pa.RecordBatch.from_pydict({"place": same(place), "slot": same(slot), "bucket": pa.array(bucket), "n": pa.array(n), "lo": pa.array(lo), "hi": pa.array(hi)})

        return count

    return work


def histogram(df: DataFrame, columns: list[str], ranges: dict[int, list[Range]] | None = None) -> DataFrame:
    """``place, slot, bucket, n, lo, hi``: finite values of columns in buckets whose order is that of the values.

    Without ``ranges`` a bucket holds the values with the same 18 leading bits.  ``ranges`` names places of columns and the
    ranges of each that are counted; other columns are not read.
    """
    places = sorted(ranges) if ranges is not None else list(range(len(columns)))
    wanted = ranges or {p: [(0, -np.inf, np.inf, None)] for p in places}
    rows = _by_columns(df, _named([columns[p] for p in places]), _counts(places, wanted), "place int, slot int, bucket long, n long, lo double, hi double")
    return rows.groupBy("place", "slot", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


# ---- sums of products ----


def _joined(a: tuple, b: tuple) -> tuple:
    """Number, means and sums of products about them of two sets of rows together (one column or a matrix)."""
    (n, m, s), (k, q, t) = a, b
    if not n or not k:
        return a if n else b
    d = q - m
    return n + k, m + d * (k / (n + k)), s + t + np.outer(d, d) * (n * k / (n + k))


def _moments(rows: np.ndarray) -> tuple:
    """The same of the rows of a matrix; taken from the first row, so a column of one value has no deviation at all."""
    x = rows - rows[0]
    off = x.mean(axis=0)
    x -= off
    return len(rows), rows[0] + off, x.T @ x


def _summed(first: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple] = {}
        for lines, there in _unpacked(batches):
            for i in range(len(lines) - 1):
                both = lines[[i + 1, 0]].T
                if there is not None:
                    both = both[there[i + 1] & there[0]]
                if len(both):
                    with np.errstate(all="ignore"):
                        total[i] = _joined(total.get(i, (0, None, None)), _moments(both))
        if total:
            n, m, s = zip(*total.values())
            m, s = np.array(m), np.array(s)
            made = {"place": np.array(list(total), np.int32) + np.int32(first), "n": np.array(n, np.int64), "mx": m[:, 0], "my": m[:, 1], "xx": s[:, 0, 0], "yy": s[:, 1, 1], "xy": s[:, 0, 1]}
            yield pa.RecordBatch.from_pydict({k: pa.array(np.ascontiguousarray(v)) for k, v in made.items()})

    return work


def correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``place, n, r``: rows with a value of both and their Pearson correlation, NULL where one of them does not vary.

    Tasks sum about their own means; the parts of a column, one a task, are set about the mean of all.
    """
    parts = _by_columns(
        df, _named(columns), _summed, "place int, n long, mx double, my double, xx double, yy double, xy double", [F.col(target)]
    )
    w = Window.partitionBy("place")

    def off(a: str) -> Column:
        above = F.col(f"m{a}") - F.col(f"l{a}")  # 0 in every part of a column that does not vary
        return above - F.sum(F.col("n") * above).over(w) / F.sum("n").over(w)

    off_mean = parts.withColumns({"lx": F.min("mx").over(w), "ly": F.min("my").over(w)}).withColumns({f"d{a}": off(a) for a in "xy"})
    n = F.sum("n")
    spread = {a: F.sqrt(F.sum(F.col(a * 2) + F.col("n") * F.col(f"d{a}") * F.col(f"d{a}")) / n) for a in "xy"}
    shared = F.sum(F.col("xy") + F.col("n") * F.col("dx") * F.col("dy")) / n
    return off_mean.groupBy("place").agg(n.alias("n"), (shared / F.nullif(spread["x"] * spread["y"], F.lit(0.0))).alias("r"))


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0, None, None
    for lines, _ in _unpacked(batches):
        rows = lines.T[~np.isnan(lines).any(axis=0)]
        if len(rows):
            with np.errstate(all="ignore"):
                total = _joined(total, _moments(rows))
    yield from _sent(total)


def _sent(total: tuple) -> Iterator[pa.RecordBatch]:
    n, m, s = total
    if n:
        yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "m": pa.array([m], pa.list_(pa.float64())), "s": pa.array([s.ravel()], pa.list_(pa.float64()))})


def _received(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for n, m, s in zip(*(batch.column(c) for c in "nms")):
            mean = m.values.to_numpy()
            yield n.as_py(), mean, s.values.to_numpy().reshape(len(mean), len(mean))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(all="ignore"):
        yield from _sent(reduce(_joined, _received(batches), (0, None, None)))


def covariances(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """Number of rows with a value in every column, and the sample covariances of these rows.

    A task makes one matrix, whose size depends on the number of columns only.
    """
    kinds = "n long, m array<double>, s array<double>"
    parts = _packed(df, _named(columns)).mapInArrow(_matrix, kinds).repartition(MERGERS).mapInArrow(_matrices, kinds)
    with np.errstate(all="ignore"):
        n, _, s = reduce(_joined, _received(parts.toArrow().to_batches()), (0, None, None))
        return n, s / (n - 1) if n > 1 else np.full((len(columns), len(columns)), np.nan)


# ---- means ----


def _totals(first: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for lines, there in _unpacked(batches):
            there = np.ones(lines.shape, bool) if there is None else there
            with np.errstate(all="ignore"):
                own = np.stack([there.sum(axis=1), np.where(there, lines, 0.0).sum(axis=1)])
                total = own if total is None else total + own
        if total is not None:
            place = np.arange(total.shape[1], dtype=np.int32) + np.int32(first)
            yield pa.RecordBatch.from_pydict({"place": pa.array(place), "n": pa.array(total[0].astype(np.int64)), "total": pa.array(total[1])})

    return work


def means(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, mean``: the mean of the values of each column, NULL without any."""
    sums = _by_columns(df, _named(columns), _totals, "place int, n long, total double").groupBy("place").agg(
        F.try_divide(F.sum("total"), F.sum("n")).alias("mean")
    )
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "place int, feature string")
    return names.join(sums, "place", "left").select("feature", "mean")
