"""Temporal splits of the panel and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Percent of the distinct dates up to the end of train and of val.
TRAIN_END_PCT, VAL_END_PCT = 70, 90


def _date_cut(dates: DataFrame, percents: list[int]) -> Column:
    """Array of the last date inside each percentage of the distinct dates.

    The one-task window runs over distinct calendar days only, whatever type the
    column has.
    """
    dates = dates.select(F.col("date").cast("date").alias("date")).distinct()
    w = Window.orderBy("date")
    ranked = dates.withColumns(
        {"__rank": F.row_number().over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy())}
    )
    cuts = [
        F.max(F.when(F.col("__rank") <= F.floor(F.col("__n") * p / 100), F.col("date"))) for p in percents
    ]
    return ranked.agg(F.array(*cuts)).scalar()


def temporal_split(df: DataFrame, train_end: int = TRAIN_END_PCT, val_end: int = VAL_END_PCT) -> DataFrame:
    """Adds ``split``: train, val or test by position of the date among the distinct dates."""
    cuts = _date_cut(df, [train_end, val_end])
    day = F.col("date").cast("date")
    label = F.when(day <= F.get(cuts, F.lit(0)), "train").when(day <= F.get(cuts, F.lit(1)), "val").otherwise("test")
    return df.withColumn("split", label)


def split_at_date(df: DataFrame, first_validation: str | None, fallback_pct: int = 80) -> DataFrame:
    """Train before the first validation date (or up to ``fallback_pct`` of the dates), val after."""
    if first_validation is not None:
        before = F.col("date") < F.lit(first_validation).cast("date")
    else:
        before = F.col("date").cast("date") <= F.get(_date_cut(df, [fallback_pct]), F.lit(0))
    return df.withColumn("split", F.when(before, "train").otherwise("val"))


def split_at_first(df: DataFrame, validation: DataFrame) -> DataFrame:
    """Train up to the last ``time_idx`` before the first validation date."""
    first = validation.agg(F.min("date")).scalar()
    return df.withColumn("split", F.when(F.col("date") < first, "train").otherwise("val"))


def split_bounds(df: DataFrame) -> DataFrame:
    """Rows and first and last date of each split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def leakage_report(df: DataFrame) -> DataFrame:
    """One row: whether every split has rows and ends before the next one begins."""
    bounds = split_bounds(df)

    def of(split: str, column: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(column)))

    ordered = (of("train", "last_date") < of("val", "first_date")) & (of("val", "last_date") < of("test", "first_date"))
    return bounds.agg(
        (F.count(F.lit(1)) == 3).alias("all_present"), F.coalesce(ordered, F.lit(False)).alias("ordered"),
        *[of(s, "rows").alias(f"{s}_rows") for s in ("train", "val", "test")],
    )


def require_no_leakage(df: DataFrame) -> DataFrame:
    """``df`` itself, or an error when its splits overlap in time or one is empty."""
    r = leakage_report(df).first()
    if not (r.all_present and r.ordered):
        raise ValueError(f"splits leak or are empty: {r.asDict()}")
    return df
