"""Risk table per symbol and its summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import ratio, sample_kurtosis, sample_skewness
from .positions import exact_quantiles
from .windows import running, whole

# ---- fixed values ----
TRADING_DAYS = 252
LEAST_ROWS, LEAST_RETURNS = 10, 5
TAILS = {"5": 0.05, "1": 0.01}
# ---- end of fixed values ----


def risk_table(panel: DataFrame) -> DataFrame:
    """Return, volatility, drawdown, tail and shape measures of each symbol's daily returns.

    Needs ``close`` and ``returns``.  Tails and drawdown are windows of the same
    partitioning as the final aggregate, so the panel is shuffled once.
    """
    r, w = F.col("returns"), running()
    rows = panel.select("symbol", "date", "close", "returns").withColumns(
        {
            "__grown": F.exp(F.sum(F.log1p(F.col("returns"))).over(w)),
            **{f"__q{t}": F.percentile(r, F.lit(p)).over(whole()) for t, p in TAILS.items()},
        }
    )
    rows = rows.withColumn("__fall", F.when(r.isNotNull(), F.col("__grown") / F.max("__grown").over(w) - 1.0))
    table = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("__rows"), F.count(r).alias("observations"),
        F.avg(r).alias("mean_return_daily"), F.stddev_samp(r).alias("volatility_daily"),
        F.stddev_samp(F.when(r < 0, r)).alias("__down"), F.min("__fall").alias("max_drawdown"),
        *[F.max(f"__q{t}").alias(f"var_{t}") for t in TAILS],
        *[F.avg(F.when(r <= F.col(f"__q{t}"), r)).alias(f"cvar_{t}") for t in TAILS],
        sample_skewness(r).alias("skewness"), sample_kurtosis(r).alias("kurtosis"),
        F.avg((r > 0).cast("double")).alias("hit_ratio"),
        F.min("close").alias("lowest_price"), F.max("close").alias("highest_price"),
    )
    year, root = F.col("mean_return_daily") * TRADING_DAYS, math.sqrt(TRADING_DAYS)

    def positive(num, den):
        return F.coalesce(F.when(den > 0, num / den), F.lit(0.0))

    return (
        table.filter((F.col("__rows") >= LEAST_ROWS) & (F.col("observations") >= LEAST_RETURNS))
        .withColumns(
            {
                "mean_return_annual": year,
                "volatility_annual": F.col("volatility_daily") * root,
                "sharpe_ratio": positive(year, F.col("volatility_daily") * root),
                "sortino_ratio": positive(year, F.col("__down") * root),
                "calmar_ratio": F.coalesce(F.when(F.col("max_drawdown") < 0, F.abs(ratio(year, F.col("max_drawdown")))), F.lit(0.0)),
            }
        )
        .drop("__rows", "__down")
    )


def extremes(risk: DataFrame) -> DataFrame:
    """Best and worst symbols in one aggregate; equal values go to the first symbol in order."""

    def best(column: str, sign: int):
        # struct comparison: value first, then symbol
        return F.min(F.struct((F.col(column) * -sign).alias("v"), F.col("symbol").alias("s")))["s"]

    return risk.agg(
        best("sharpe_ratio", 1).alias("best_sharpe"), best("volatility_annual", -1).alias("lowest_volatility"),
        best("mean_return_annual", 1).alias("highest_return"), best("max_drawdown", 1).alias("smallest_drawdown"),
    )


def risk_classes(risk: DataFrame) -> DataFrame:
    """High above the median annual volatility, low at or below it."""
    median = exact_quantiles(risk, ["volatility_annual"], [0.5])["volatility_annual"][0]
    label = F.when(F.col("volatility_annual") > F.lit(median), "high").otherwise("low")
    return risk.select("symbol", "volatility_annual", label.alias("risk_class"))
