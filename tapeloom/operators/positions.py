"""Global positions, average ranks and exact quantiles without a one-task sort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable
from .columns import Range, histogram


def _range_split(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-partitioned by ``order`` with the partition number frozen in ``__part``.

    The result is checkpointed: partition numbers are not repeatable values, and
    both the counts and the rows below must see the same ones.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    return durable(ranged)


def _offsets(ranged: DataFrame, weight: Column, by: list[str]) -> DataFrame:
    """Weight found in lower partitions; one row per partition, so the window is tiny."""
    per_part = ranged.groupBy(*by, "__part").agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(*by, "__part", F.coalesce(F.sum("__w").over(w), F.lit(0)).alias("__before"))


def dense_positions(distinct_rows: DataFrame, order: str) -> DataFrame:
    """1-based position of each distinct value in the global order."""
    ranged = _range_split(distinct_rows, [order])
    local = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return (
        ranged.withColumn("__local", local)
        .join(F.broadcast(_offsets(ranged, F.lit(1), [])), "__part")
        .withColumn("position", (F.col("__before") + F.col("__local")).cast("bigint"))
        .drop("__part", "__local", "__before")
    )


def rank_dictionary(long: DataFrame, by: str, value: str, rank: str, weight: str = "1") -> DataFrame:
    """Average rank and row count ``__n`` of every distinct value within ``by``.

    Equal values are counted first, so a value held by a third of the rows is one
    row here; positions come from counts per range partition.
    """
    counts = long.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.sum(F.expr(weight)).alias("__n"))
    ranged = _range_split(counts, [by, value])
    below = Window.partitionBy(by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("__local", F.coalesce(F.sum("__n").over(below), F.lit(0)))
        .join(F.broadcast(_offsets(ranged, F.col("__n"), [by])), [by, "__part"])
        .select(by, value, "__n", (F.col("__before") + F.col("__local") + (F.col("__n") + 1) / 2.0).alias(rank))
    )


def spearman(long: DataFrame, by: list[str], group: str, x: str, y: str, ranked: bool = False) -> DataFrame:
    """Rank correlation of ``x`` and ``y`` per group; ``group`` is the key column of ``by``.

    Equal pairs are counted first, so a pair held by a third of the rows is one row
    from there on.  The counts are written once; both dictionaries and the weighted
    correlation read them from there.  ``ranked`` says that ``y`` holds its average ranks already.
    """
    counts = long.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*dict.fromkeys([*by, group]), x, y).agg(F.count(F.lit(1)).alias("__n"))
    counts = durable(counts)
    pairs = counts.withColumn("__ry", F.col(y)) if ranked else counts
    for value, rank in ((x, "__rx"),) if ranked else ((x, "__rx"), (y, "__ry")):
        ranks = rank_dictionary(counts, group, value, rank, "__n")
        pairs = pairs.join(ranks.select(group, value, rank), [group, value])
    return pairs.groupBy(*by).agg(_weighted_corr(F.col("__rx"), F.col("__ry"), F.col("__n")).alias("spearman"), F.sum("__n").alias("rows"))


def _weighted_corr(x: Column, y: Column, n: Column) -> Column:
    """Correlation of rows that stand for ``n`` each.  Ranks are halves, so the sums are exact decimals."""
    def total(c: Column) -> Column:
        return F.sum(c.cast("decimal(38,0)")).cast("double")

    a, b = (2 * x).cast("decimal(18,0)"), (2 * y).cast("decimal(18,0)")
    rows, sx, sy = total(n), total(a * n), total(b * n)
    xx, yy, xy = total(a * a * n), total(b * b * n), total(a * b * n)
    return F.try_divide(rows * xy - sx * sy, F.sqrt((rows * xx - sx * sx) * (rows * yy - sy * sy)))


# --------------------------------------------------------------------------
# exact quantiles
# --------------------------------------------------------------------------

#: Buckets per factor e of magnitude.
_LOG_STEPS = 512
#: Above every ``floor(ln(x) * 512)`` of a double in absolute value.
_LOG_OFFSET = 500_000
#: Parts a bucket is cut into at a time; a bucket with no more values than that is cut into its values.
_PARTS = 4096


@dataclass(frozen=True)
class _Target:
    rank: int  # zero-based rank inside the bucket
    low: float
    high: float
    rows: int  # values in the bucket


def _bucket(v: Column) -> Column:
    """A non-decreasing map from doubles to less than a million buckets, a few thousand in practice."""
    size = F.floor(F.ln(F.abs(v)) * _LOG_STEPS) + _LOG_OFFSET
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, size).otherwise(-size)


def _locate(histogram: DataFrame, wanted: dict[tuple, list[int]]) -> dict[tuple, list[_Target]]:
    """Bucket and rank inside it for each wanted rank; only those buckets reach the driver."""
    w = Window.partitionBy("place", "slot").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = histogram.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
    listed = [(place, slot, r) for (place, slot), ranks in wanted.items() for r in ranks]
    asked = F.broadcast(histogram.sparkSession.createDataFrame(listed, "place int, slot int, rank bigint"))
    hits = cum.join(asked, ["place", "slot"]).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
    at = {(r.place, r.slot, r["rank"]): _Target(r["rank"] - r.before, r.lo, r.hi, r.n) for r in hits.collect()}
    return {key: [at[(*key, r)] for r in ranks] for key, ranks in wanted.items()}


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of whole columns; NULL, NaN and infinite values are ignored.

    ``percentile`` would gather every distinct value of a column in one task.  Here
    the ranks are located by counting: a histogram over monotone buckets, finer ones
    inside the hit buckets while these hold many values, then a count per distinct
    value in what is left.  Each pass counts within the tasks; the driver sees a
    handful of bucket bounds and values.

    The input is read two or three times: pass a table or a ``written`` one when
    its columns are costly to derive.
    """
    first = durable(histogram(df, columns))
    counts = {r.place: r.n for r in first.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    ranks: dict[tuple, list[int]] = {}
    for place, n in counts.items():
        need = set()
        for p in probs:
            at = p * (n - 1)
            need.update({int(at), min(int(at) + 1, n - 1)})
        ranks[(place, 0)] = sorted(need)
    if not ranks:
        return {c: [None] * len(probs) for c in columns}
    located = _locate(first, ranks)
    targets = {(p, r): t for (p, _), rs in ranks.items() for r, t in zip(rs, located[(p, 0)])}
    while any(t.low < t.high for t in targets.values()):
        targets = _narrowed(df, columns, targets)
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    for place, n in counts.items():
        for i, p in enumerate(probs):
            at = p * (n - 1)
            k = int(at)
            a, b = targets[(place, k)].low, targets[(place, min(k + 1, n - 1))].low
            out[columns[place]][i] = a + (b - a) * (at - k)
    return out


def _narrowed(df: DataFrame, columns: list[str], targets: dict[tuple, _Target]) -> dict[tuple, _Target]:
    """Every rank in the part of its bucket that holds it; a small bucket, and one too narrow to be cut, is cut into its values."""
    open_ = {(place, t.low, t.high): t.rows for (place, _), t in targets.items() if t.low < t.high}
    slots = {bounds: i for i, bounds in enumerate(sorted(open_))}
    ranges: dict[int, list[Range]] = {}
    for (place, low, high), slot in slots.items():
        step = (high - low) / _PARTS if open_[(place, low, high)] > _PARTS else 0.0
        ranges.setdefault(place, []).append((slot, low, high, step))
    wanted: dict[tuple, list[int]] = {}
    owners: dict[tuple, list[tuple]] = {}
    for (place, rank), t in targets.items():
        if t.low < t.high:
            key = (place, slots[(place, t.low, t.high)])
            wanted.setdefault(key, []).append(t.rank)
            owners.setdefault(key, []).append((place, rank))
    located = _locate(histogram(df, columns, ranges), wanted)
    return {**targets, **{owner: t for key, names in owners.items() for owner, t in zip(names, located[key])}}
