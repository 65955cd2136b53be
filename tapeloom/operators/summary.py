"""Descriptive tables: counts, nulls, distributions, coverage and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import written
from . import registry
from .positions import exact_quantiles
from .windows import whole

#: Least rows and least absolute value of a listed correlation.
LEAST_PAIRS, LEAST_CORRELATION = 50, 0.01


def data_summary(df: DataFrame) -> DataFrame:
    """One row: rows, symbols, date range, coverage of each target and overall."""
    targets = [c for c in df.columns if registry.is_target(c)]
    cells = [F.count(c) for c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
        F.count_distinct("symbol").alias("symbols"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.datediff(F.max("date"), F.min("date")).alias("days"),
        *[(F.count(t) / F.count(F.lit(1))).alias(f"{t}_coverage") for t in targets],
        (sum(cells[1:], cells[0]) / (F.count(F.lit(1)) * len(df.columns))).alias("overall_coverage"),
    )


def null_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULL count and percentage per column, most first; one aggregate."""
    cols = columns or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot(["__n"], cols, "column", "nulls")
    return long.select("column", "nulls", (F.col("nulls") * 100.0 / F.col("__n")).alias("null_pct")).orderBy(F.desc("nulls"), "column")


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier one; copies are counted on the map side first."""
    counts = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"))


def rows_per_symbol(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "symbol")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum per column."""
    numbers = written(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    quartiles = exact_quantiles(numbers, columns, [0.25, 0.5, 0.75])
    long = numbers.unpivot([], columns, "column", "value")
    stats = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    out = stats
    for i, name in enumerate(("q25", "q50", "q75")):
        value = F.lit(None).cast("double")
        for c in columns:
            value = F.when(F.col("column") == c, F.lit(quartiles[c][i]).cast("double")).otherwise(value)
        out = out.withColumn(name, value)
    return out


def group_means(df: DataFrame, columns: list[str], by: str = "symbol") -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])


def trimmed(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows inside the symbol's own quantile range (one window per bounded series)."""
    w = whole()
    bounds = {
        "q_low": F.percentile(column, F.lit(low)).over(w), "q_high": F.percentile(column, F.lit(high)).over(w)
    }
    return df.withColumns(bounds).filter(F.col(column).between(F.col("q_low"), F.col("q_high")))


def group_quantiles(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    return df.groupBy("symbol").agg(
        F.percentile(column, F.lit(low)).alias("q_low"), F.percentile(column, F.lit(high)).alias("q_high")
    )


def feature_statistics(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """Count, coverage, moments, range and non-zero share per feature (and group)."""
    by = by or []
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(by, features, "feature", "value")
    v = F.col("value")
    return long.groupBy(*by, "feature").agg(
        F.count(v).alias("count"), (F.count(v) * 100.0 / F.count(F.lit(1))).alias("coverage_pct"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.avg((v != 0).cast("double")) * 100.0).alias("non_zero_pct"),
    )


def nonzero_coverage(df: DataFrame, features: list[str]) -> DataFrame:
    """Share of non-zero rows per feature, in percent."""
    wide = df.agg(*[(F.avg(F.coalesce(F.col(c) != 0, F.lit(False)).cast("double")) * 100.0).alias(c) for c in features])
    return wide.unpivot([], features, "feature", "non_zero_pct")


def target_coverage(df: DataFrame) -> DataFrame:
    """Share of known values per target column."""
    targets = [c for c in df.columns if registry.is_target(c)]
    wide = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in targets])
    return wide.unpivot([], targets, "target", "coverage")


def target_correlations(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """Correlation of each feature with each target: enough rows, not all zero, not negligible.

    The table has one row per feature and is aggregated once for all targets.
    """
    wide = df.select(*targets, *[F.col(c).cast("double").alias(c) for c in features])
    long = wide.unpivot(targets, features, "feature", "value")
    v = F.col("value")
    made = []
    for t in targets:
        both = v.isNotNull() & F.col(t).isNotNull()
        made += [
            F.corr(v, F.col(t).cast("double")).alias(f"c_{t}"), F.count_if(both).alias(f"n_{t}"),
            F.count_if(both & (v != 0)).alias(f"z_{t}"),
        ]
    stats = long.groupBy("feature").agg(*made)
    parts = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("target"), F.col(f"c_{t}").alias("correlation"), F.col(f"n_{t}").alias("rows"),
                    F.col(f"z_{t}").alias("__nonzero"),
                )
                for t in targets
            ]
        )
    )
    return (
        stats.select("feature", parts.alias("p")).select("feature", "p.*")
        .filter((F.col("rows") >= LEAST_PAIRS) & (F.col("__nonzero") > 0) & (F.abs("correlation") > LEAST_CORRELATION))
        .drop("__nonzero")
        .withColumn("abs_correlation", F.abs("correlation"))
        .orderBy(F.desc("abs_correlation"), "feature", "target")
    )


def distribution_check(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean, sample deviation, population skewness and rows beyond three population deviations."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    moments = wide.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in features])
    scalar = moments.select(F.struct(*features)).scalar()
    made = {}
    for c in features:
        z = (F.col(c) - scalar[c]["m"]) / F.nullif(scalar[c]["s"], F.lit(0.0))
        made[c] = F.struct(
            F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.skewness(c).alias("skewness"),
            F.count_if(F.abs(z) > 3).alias("outliers"),
        )
    stats = wide.agg(*[c.alias(n) for n, c in made.items()])
    return stats.unpivot([], features, "feature", "s").select("feature", "s.*")


def decay_sanity(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Whether each feature stays within +-5 and varies, and its absolute target correlation."""
    made = {
        c: F.struct(
            ((F.min(c) >= -5.0) & (F.max(c) <= 5.0)).alias("bounded"), (F.stddev_samp(c) > 0.001).alias("varies"),
            F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.abs(F.corr(F.col(c).cast("double"), F.col(target))).alias("abs_correlation"),
        )
        for c in features
    }
    return df.agg(*[c.alias(n) for n, c in made.items()]).unpivot([], features, "feature", "s").select("feature", "s.*")
