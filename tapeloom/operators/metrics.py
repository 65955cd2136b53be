"""Forecast metrics as grouped aggregates over columns ``y`` and ``yhat``."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.numeric import ratio
from .windows import series

# ---- fixed values: thresholds, goals and loss parameters ----
SMALL_MOVE, SMALL_VALUE, SMALL_DENOMINATOR = 5e-4, 1e-8, 1e-8
TRADING_DAYS, RISK_FREE = 252, 0.02
GOALS = {"rmse": 0.025, "mae": 0.018, "r2": 0.35, "directional_accuracy": 0.65, "sharpe_ratio": 2.5}
LOWER_IS_BETTER = ["rmse", "mae"]
OVERFIT_LIMITS = {"mda": 0.15, "rmse": 0.01, "r2": 0.15}
HUBER_DELTA = 0.1
LOSS_WEIGHTS = {"mse": 0.3, "mae": 0.3, "huber": 0.2, "direction": 0.2}
QUANTILES = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]
LJUNG_BOX_LAGS, LEAST_RESIDUALS, PASS_ABOVE = 10, 10, 0.05
# ---- end of fixed values ----

def truth() -> Column:
    return F.col("y")


def guess() -> Column:
    return F.col("yhat")


def error() -> Column:
    return truth() - guess()


def rmse() -> Column:
    return F.sqrt(F.avg(F.pow(error(), 2.0)))


def mae() -> Column:
    return F.avg(F.abs(error()))


def r2() -> Column:
    """1 - SSR / SST over rows with both values, 0 when the target does not vary."""
    both = F.when(guess().isNotNull(), truth())
    return F.coalesce(1.0 - F.sum(F.pow(error(), 2.0)) / F.nullif(F.var_pop(both) * F.count(both), F.lit(0.0)), F.lit(0.0))


def mape() -> Column:
    """Percent; infinite when every true value is too small to divide by."""
    term = F.when(F.abs(truth()) > SMALL_VALUE, F.abs(error() / F.nullif(truth(), F.lit(0.0))))
    return F.coalesce(F.avg(term) * 100.0, F.lit(float("inf")))


def smape() -> Column:
    den = (F.abs(truth()) + F.abs(guess())) / 2.0
    return F.coalesce(F.avg(F.when(den > SMALL_DENOMINATOR, ratio(F.abs(error()), den))) * 100.0, F.lit(0.0))


def directional_accuracy(threshold: float = SMALL_MOVE) -> Column:
    hit = F.when(F.abs(truth()) > threshold, (F.signum(truth()) == F.signum(guess())).cast("double"))
    return F.coalesce(F.avg(hit), F.lit(0.5))


def directional_f1(threshold: float = SMALL_MOVE) -> Column:
    moved = F.abs(truth()) > threshold
    tp, fp, fn = (
        F.count_if(moved & c).cast("double") for c in ((truth() > 0) & (guess() > 0), (truth() <= 0) & (guess() > 0), (truth() > 0) & (guess() <= 0))
    )
    precision, recall = tp / (tp + fp + 1e-8), tp / (tp + fn + 1e-8)
    return precision * recall * 2.0 / (precision + recall + 1e-8)


def sharpe(x: Column, risk_free: float = RISK_FREE) -> Column:
    """Annualised from daily returns; 0 without variation."""
    value = math.sqrt(TRADING_DAYS) * (F.avg(x) - risk_free / TRADING_DAYS) / F.nullif(F.stddev_pop(x), F.lit(0.0))
    return F.coalesce(value, F.lit(0.0))


def forecast_metrics(df: DataFrame, by: list[str], strategy: str | None = None) -> DataFrame:
    """All point-forecast metrics per group in one aggregate."""
    made = {
        "rows": F.count(error()), "rmse": rmse(), "mae": mae(), "r2": r2(), "mape": mape(), "smape": smape(),
        "directional_accuracy": directional_accuracy(), "directional_f1": directional_f1(),
        "residual_mean": F.avg(error()), "residual_std": F.stddev_pop(error()),
    }
    if strategy:
        made["sharpe_ratio"] = sharpe(F.col(strategy))
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in made.items()])


def losses(df: DataFrame, by: list[str]) -> DataFrame:
    """Huber, composite and quantile losses per group."""
    e = F.abs(error())
    huber = F.avg(F.when(e <= HUBER_DELTA, 0.5 * e * e).otherwise(HUBER_DELTA * (e - 0.5 * HUBER_DELTA)))
    mse = F.avg(e * e)
    w = LOSS_WEIGHTS
    composite = (
        mse * w["mse"] + mae() * w["mae"] + huber * w["huber"] + (1.0 - directional_accuracy()) * w["direction"]
    )
    pinball = {
        f"quantile_loss_{round(q * 100):02d}": F.avg(F.greatest(error() * q, error() * (q - 1.0))) for q in QUANTILES
    }
    made = {"mse": mse, "huber": huber, "composite": composite, **pinball}
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in made.items()])


def goals_met(metrics: DataFrame) -> DataFrame:
    """Flag and distance to goal per metric, and the share of goals met."""
    have = [m for m in GOALS if m in metrics.columns]
    met = {
        f"{m}_target_met": (F.col(m) < GOALS[m]) if m in LOWER_IS_BETTER else (F.col(m) > GOALS[m]) for m in have
    }
    distance = {f"{m}_vs_target": F.col(m) - GOALS[m] for m in have}
    score = sum((F.coalesce(c, F.lit(False)).cast("double") for c in met.values()), F.lit(0.0)) / len(have)
    return metrics.withColumns({**met, **distance, "overall_score": score})


def overfit_gaps(metrics: DataFrame, by: list[str], train: str = "train", held: str = "val") -> DataFrame:
    """Gap between training and held-out metrics per group and whether it hints at overfitting."""

    def of(split: str, m: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(m)))

    gaps = {
        "mda_gap": of(train, "directional_accuracy") - of(held, "directional_accuracy"),
        "rmse_gap": of(held, "rmse") - of(train, "rmse"),
        "r2_gap": of(train, "r2") - of(held, "r2"),
    }
    table = metrics.groupBy(*by).agg(*[c.alias(n) for n, c in gaps.items()])
    limits = OVERFIT_LIMITS
    over = (F.col("mda_gap") > limits["mda"]) | (F.col("rmse_gap") > limits["rmse"]) | (F.col("r2_gap") > limits["r2"])
    return table.withColumn("overfit", F.coalesce(over, F.lit(False)))


def rank_models(metrics: DataFrame, model: str, names: list[str], lower: list[str] = ("rmse", "mae", "mape", "smape")) -> DataFrame:
    """Rank of each model per metric; the window covers one row per model."""
    long = metrics.unpivot([model], names, "metric", "value")
    better = F.when(F.col("metric").isin(list(lower)), F.col("value")).otherwise(-F.col("value"))
    return long.withColumn("rank", F.rank().over(Window.partitionBy("metric").orderBy(better)))


def expected_order(ranking: DataFrame, model: str, order: list[str]) -> DataFrame:
    """Per metric of :func:`rank_models`: whether the listed models, expected best first, come strictly in that order.

    A metric that lacks one of the models is left out.
    """
    place = {name: F.max(F.when(F.col(model) == name, F.col("rank"))) for name in order}
    wide = ranking.groupBy("metric").agg(*[c.alias(f"__{i}") for i, c in enumerate(place.values())])
    known = reduce(lambda a, b: a & b, [F.col(f"__{i}").isNotNull() for i in range(len(order))])
    holds = reduce(lambda a, b: a & b, [F.col(f"__{i}") < F.col(f"__{i + 1}") for i in range(len(order) - 1)], F.lit(True))
    return wide.filter(known).select("metric", holds.alias("as_expected"))


def max_drawdown(df: DataFrame, column: str, kind: str = "returns", by: str = "symbol", order: str = "date") -> DataFrame:
    """Largest fall of the compounded series from its running peak, per group.

    ``kind`` says whether the column holds returns or prices.
    """
    w = series(by, order)
    r = F.col(column) if kind == "returns" else ratio(F.col(column), F.lag(column).over(w)) - 1.0
    grown = df.withColumn("__r", r).filter(F.col("__r").isNotNull())
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = grown.withColumn("__c", F.exp(F.sum(F.log1p("__r")).over(upto)))
    grown = grown.withColumn("__d", ratio(F.col("__c"), F.max("__c").over(upto)) - 1.0)
    return grown.groupBy(by).agg(F.min("__d").alias("max_drawdown"))


@F.pandas_udf(T.DoubleType())
def chi_square_tail(q: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail probability of a chi-square value with whole degrees of freedom."""

    def tail(x: float, k: float) -> float | None:
        if x != x or k != k or k < 1:
            return None
        half, k = x / 2.0, int(k)
        if k % 2 == 0:
            start, term = math.exp(-half), 1.0
            total = term
            for i in range(1, k // 2):
                term *= half / i
                total += term
            return start * total
        total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
        for i in range(1, (k - 1) // 2 + 1):
            total += term
            term *= half / (i + 0.5)
        return total

    return pd.Series([tail(x, k) for x, k in zip(q, df)], dtype=float)


def ljung_box_statistic(df: DataFrame, column: str, by: str = "symbol", order: str = "date") -> DataFrame:
    """Portmanteau statistic over min(10, n/4) lags per series; short series get no statistic."""
    rows = df.filter(F.col(column).isNotNull()).select(by, order, F.col(column).alias("__e"))
    rows = rows.withColumn("__e", F.col("__e") - F.avg("__e").over(Window.partitionBy(by)))
    lagged = {f"__p{k}": F.col("__e") * F.lag("__e", k).over(series(by, order)) for k in range(1, LJUNG_BOX_LAGS + 1)}
    sums = rows.withColumns(lagged).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__e") * F.col("__e")).alias("__c0"),
        *[F.sum(n).alias(n) for n in lagged],
    )
    n = F.col("n")
    lags = F.least(F.lit(LJUNG_BOX_LAGS), F.floor(n / 4)).cast("int")
    total = sum(
        (
            F.when((lags >= k), F.pow(ratio(F.coalesce(F.col(f"__p{k}"), F.lit(0.0)), F.col("__c0")), 2.0) / F.nullif(n - k, F.lit(0)))
            .otherwise(0.0)
            for k in range(1, LJUNG_BOX_LAGS + 1)
        ),
        F.lit(0.0),
    )
    return sums.select(by, "n", lags.alias("lags"), F.when(n >= LEAST_RESIDUALS, n * (n + 2) * total).alias("q"))


def ljung_box(df: DataFrame, column: str, by: str = "symbol", order: str = "date") -> DataFrame:
    """Statistic, p-value and whether no autocorrelation is found (also for short series)."""
    s = ljung_box_statistic(df, column, by, order)
    p = F.when(F.col("q").isNull(), 1.0).otherwise(chi_square_tail(F.col("q"), F.col("lags").cast("double")))
    return s.withColumn("p_value", p).withColumn("passed", F.col("p_value") > PASS_ABOVE)
