"""Exact quantiles of many groups at once, whatever the size of a group.

A built-in percentile holds every distinct value of a group in one buffer.  Here equal values are counted first, a group's
values fall into monotone buckets whose counts are kept as a table, and running counts name the bucket of every rank.  Only
the values of those buckets go on, into finer parts, until a part holds one value.  A group is never gathered: windows run
over its buckets or parts, of which there are a few thousand at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import finite, sample_skewness
from ..session import written
from .news import SCORES
from .positions import _bucket

#: Parts a bucket is cut into at a time.
PARTS = 1024


def _same(a: str, b: str, columns: list[str]) -> Column:
    """Equal keys, NULL being a key like any other."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def _running(histogram: DataFrame, cell: list[str], order: str) -> DataFrame:
    """Rows of a cell before each part of it."""
    w = Window.partitionBy(*cell).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return histogram.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))


def _ranks(size: Column, probs: list[float]) -> Column:
    """Zero-based ranks that the quantiles of ``size`` values lie between."""
    at = [F.floor(F.lit(float(p)) * (size - 1)).cast("bigint") for p in probs]
    return F.array_distinct(F.array(*at, *[F.least(k + 1, size - 1) for k in at]))


def _narrow(counts: DataFrame, open_: DataFrame, by: list[str]) -> DataFrame:
    """Every open rank ``(by, rank, bucket, local, low, high)`` in the part of its range that holds it."""
    cell = [*by, "bucket", "low", "high"]
    cells = open_.select(*cell).distinct().alias("c")
    rows = counts.alias("r").join(cells, _same("r", "c", [*by, "bucket"]) & F.col("r.v").between(F.col("c.low"), F.col("c.high")))
    part = F.floor((F.col("r.v") - F.col("c.low")) / (F.col("c.high") - F.col("c.low")) * PARTS)
    parts = rows.groupBy(*[F.col(f"c.{c}").alias(c) for c in cell], part.alias("part")).agg(
        F.sum("r.n").alias("n"), F.min("r.v").alias("least"), F.max("r.v").alias("most")
    )
    found = _running(parts, cell, "part").alias("p").join(
        open_.alias("o"), _same("p", "o", cell) & (F.col("p.before") <= F.col("o.local")) & (F.col("o.local") < F.col("p.upto"))
    )
    return found.select(
        *[F.col(f"o.{c}").alias(c) for c in [*by, "rank", "bucket"]], (F.col("o.local") - F.col("p.before")).alias("local"),
        F.col("p.least").alias("low"), F.col("p.most").alias("high"),
    )


def grouped_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """``n`` and ``quantiles`` (linear between neighbours, in the order of ``probs``) of each group.

    NULL, NaN and infinite values are ignored, and a group without others gives no row.  Counted values and located
    ranks are written, so a pass reads the ones before it from there.
    """
    keys = [*by, "bucket", "v"]
    rows = df.select(*by, finite(value).alias("v")).filter("v IS NOT NULL").withColumn("v", F.when(F.col("v") == 0, 0.0).otherwise(F.col("v")))
    counts = written(rows.withColumn("bucket", _bucket(F.col("v"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "counted-values")
    buckets = counts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    placed = _running(buckets, by, "bucket").withColumn("size", F.sum("n").over(Window.partitionBy(*by)))
    inside = F.filter(_ranks(F.col("size"), probs), lambda k: (k >= F.col("before")) & (k < F.col("upto")))
    at = placed.select(*by, "size", "bucket", "low", "high", "before", F.explode(inside).alias("rank"))
    located = written(at.select(*by, "size", "rank", "bucket", (F.col("rank") - F.col("before")).alias("local"), "low", "high"), "located-ranks")
    sizes = located.select(*by, "size").distinct()
    found = [located.filter("low = high").select(*by, "rank", F.col("low").alias("v"))]
    open_ = located.filter("low < high").drop("size")
    while not open_.isEmpty():
        narrowed = written(_narrow(counts, open_, by), "located-ranks")
        found.append(narrowed.filter("low = high").select(*by, "rank", F.col("low").alias("v")))
        open_ = narrowed.filter("low < high")
    values = reduce(lambda a, b: a.unionByName(b), found)
    held = values.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two ranks a quantile at most
    n = F.col("s.size")

    def quantile(p: float) -> Column:
        place = F.lit(float(p)) * (n - 1)
        k = F.floor(place).cast("bigint")
        a, b = F.element_at("h.at", k), F.element_at("h.at", F.least(k + 1, n - 1))
        return a + (b - a) * (place - k)

    joined = sizes.alias("s").join(held.alias("h"), _same("s", "h", by))
    return joined.select(*[F.col(f"s.{c}").alias(c) for c in by], n.alias("n"), F.array(*[quantile(p) for p in probs]).alias("quantiles"))


def sentiment_shape(scored: DataFrame, by: list[str] = ("symbol", "date"), probs: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """How the compound scores of a symbol and day lie: count, mean, median, quartile distance, deviation, skewness, range.

    Moments are partial aggregates; only the quantiles need the passes above.  Deviation is 0 for one article and
    skewness NULL below three, or where the scores are equal.
    """
    by = list(by)
    c = finite("sentiment_compound")
    moments = scored.groupBy(*by).agg(
        F.count(c).alias("article_count"), F.avg(c).alias("sentiment_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sentiment_std"),
        F.when(F.max(c) > F.min(c), sample_skewness(c)).alias("sentiment_skewness"), (F.max(c) - F.min(c)).alias("sentiment_range"),
        *[F.avg(s).alias(f"{s}_mean") for s in SCORES if s in scored.columns],
    )
    q = grouped_quantiles(scored, by, "sentiment_compound", list(probs))
    low, middle, high = (F.col("q.quantiles")[i] for i in range(3))
    joined = moments.alias("m").join(q.alias("q"), _same("m", "q", by))
    return joined.select("m.*", middle.alias("sentiment_median"), (high - low).alias("sentiment_iqr"))
