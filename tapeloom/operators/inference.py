"""How sure a result is: bootstrap intervals, robust standard errors and tests of forecasts against each other.

A bootstrap replicate is a weight per block of dates, drawn from a hash of (block, replicate).  Rows are reduced to a few
sums per group and block first; only those meet the replicates.  No row is resampled, and all groups and models share a
replicate's weights, which keeps what happens on the same days together.

Series here are panel rows or daily means, at most one row per date and key, so a window over one is bounded by the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.calendar import day_number
from ..functions.chance import poisson_weight, two_sided, with_counter_hash
from ..functions.numeric import finite, total
from .metrics import RISK_FREE, TRADING_DAYS

# ---- fixed values ----
LEVELS, REPLICATES, SIGNIFICANT = (0.9, 0.95, 0.99), 1000, 0.05
BLOCK_DAYS, SEED = 22, 42
# ---- end of fixed values ----


def block_of(date: str = "date", days: int = BLOCK_DAYS) -> Column:
    """The run of ``days`` calendar days a date falls in, counted from 1900 so that it is never negative."""
    return F.floor((day_number(date) + 25_567) / days).cast("bigint")


# ---- bootstrap ----


def _weighted(blocks: DataFrame, by: list[str], sums: list[str], replicates: int, seed: int) -> DataFrame:
    """Sums over blocks under each replicate's weights: one row per group and replicate; blocks drawn 0 times are not sent."""
    drawn = blocks.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = with_counter_hash(drawn, "__bits", F.col("__block"), F.col("replicate"), seed).withColumn("__w", poisson_weight(F.col("__bits"))).filter("__w > 0")
    return drawn.groupBy(*by, "replicate").agg(*[F.sum(F.col(s) * F.col("__w")).alias(s) for s in sums])




def _statistics() -> dict[str, tuple[dict[str, Column], Column]]:
    e, r = F.col("y") - F.col("yhat"), F.signum("yhat") * F.col("y")
    n = lambda c: F.col(c) / F.nullif(F.col("n"), F.lit(0.0))
    spread = F.sqrt(F.greatest(n("rr") - n("r") * n("r"), F.lit(0.0)))
    return {
        "mae": ({"abs_e": F.abs(e)}, n("abs_e")),
        "rmse": ({"ee": e * e}, F.sqrt(n("ee"))),
        "sharpe_ratio": ({"r": r, "rr": r * r}, math.sqrt(TRADING_DAYS) * (n("r") - RISK_FREE / TRADING_DAYS) / F.nullif(spread, F.lit(0.0))),
    }


def bootstrap_intervals(
    df: DataFrame, by: list[str], statistics: list[str] = ("mae", "sharpe_ratio"), levels: tuple[float, ...] = LEVELS,
    replicates: int = REPLICATES, days: int = BLOCK_DAYS, seed: int = SEED,
) -> DataFrame:
    """``statistic, value, level, low, high`` per group of forecasts ``y, yhat`` with a ``date``.

    Limits are percentiles of the statistic over the replicates.  The statistics are mae, rmse and the yearly Sharpe ratio of
    holding the sign of the forecast.  Rows with a missing or non-finite value count for nothing; replicates in which the
    statistic is undefined (no rows, no variation) are left out, and a group without any gets NULL limits.
    """
    known = _statistics()
    sums = {name: c for s in statistics for name, c in known[s][0].items()}
    rows = df.select(*by, block_of(days=days).alias("__block"), finite("y").alias("y"), finite("yhat").alias("yhat"))
    rows = rows.filter("y IS NOT NULL AND yhat IS NOT NULL AND __block IS NOT NULL")
    blocks = rows.groupBy(*by, "__block").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    each = F.array(*[F.struct(F.lit(s).alias("statistic"), known[s][1].alias("value")) for s in statistics])
    table = lambda d: d.select(*by, F.explode(each).alias("s")).select(*by, "s.*")
    whole = table(blocks.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ["n", *sums]]))
    drawn = table(_weighted(blocks, by, ["n", *sums], replicates, seed))
    at = [p for level in levels for p in ((1 - level) / 2, (1 + level) / 2)]
    cuts = drawn.groupBy(*by, "statistic").agg(F.percentile("value", F.array(*map(F.lit, at))).alias("__cuts"))  # one value a replicate
    limits = F.array(*[
        F.struct(F.lit(level).alias("level"), F.col("__cuts")[2 * i].alias("low"), F.col("__cuts")[2 * i + 1].alias("high")) for i, level in enumerate(levels)
    ])
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "statistic"]]
    joined = whole.alias("a").join(cuts.alias("b"), reduce(lambda x, y: x & y, same), "left")
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in [*by, "statistic", "value"]], F.explode(limits).alias("l")).select(*by, "statistic", "value", "l.*")


# ---- regression with errors that may vary and hang together over time ----


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solved(gram: pd.Series, cross: pd.Series) -> pd.Series:
    """Coefficients of one regression a row; NULL where the regressors are collinear."""

    def one(g, c):
        if g is None or c is None or any(x is None for x in g):
            return None
        a = np.array(g, float).reshape(len(c), -1)
        scale = np.sqrt(np.diag(a))
        if not (scale > 0).all() or np.linalg.cond(a / np.outer(scale, scale)) > 1e12:
            return None
        return np.linalg.solve(a, np.array(c, float))

    return pd.Series([one(g, c) for g, c in zip(gram, cross)], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _spread(gram: pd.Series, middle: pd.Series, beta: pd.Series) -> pd.Series:
    """Square roots of the diagonal of gram^-1 middle gram^-1."""

    def one(g, m, b):
        if b is None or m is None:
            return None
        k = len(b)
        inverse = np.linalg.inv(np.array(g, float).reshape(k, k))
        return np.sqrt(np.maximum(np.diag(inverse @ np.array(m, float).reshape(k, k) @ inverse), 0))

    return pd.Series([one(g, m, b) for g, m, b in zip(gram, middle, beta)], dtype=object)


def newey_west(df: DataFrame, target: str, regressors: list[str], lags: int, by: str = "symbol", order: str = "date") -> DataFrame:
    """Least squares with an intercept per series: ``term, n, coefficient, std_error, t_value, p_value``.

    Standard errors allow for errors of changing size that hang together over ``lags`` rows, whose products enter with falling
    weights ``1 - l / (lags + 1)``.  Rows with a missing or non-finite value are left out before lags are counted.  A series
    with no more rows than terms, or with collinear regressors, has NULL coefficients.  Products are summed in two
    aggregates; a series' small system is solved in one row.
    """
    terms, k = ["intercept", *regressors], len(regressors) + 1
    x = ["__1", *[f"__x{i}" for i in range(1, k)]]
    rows = df.select(by, order, finite(target).alias("__y"), F.lit(1.0).alias("__1"), *[finite(r).alias(n) for r, n in zip(regressors, x[1:])])
    rows = rows.na.drop()
    gram = F.array(*[F.sum(F.col(a) * F.col(b)) for a in x for b in x])
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), gram.alias("__gram"), F.array(*[F.sum(F.col(a) * F.col("__y")) for a in x]).alias("__cross"))
    beta = _solved("__gram", "__cross")
    fitted = sums.withColumn("__beta", F.when(F.col("n") > k, beta)).drop("__cross")
    residual = F.col("__y") - total([F.col(c) * F.col("__beta")[i] for i, c in enumerate(x)])
    scored = rows.join(fitted.filter("__beta IS NOT NULL").select(by, "__beta"), by)
    scored = scored.withColumn("__e", residual).select(by, order, *[(F.col(c) * F.col("__e")).alias(f"__u{i}") for i, c in enumerate(x)])
    over = Window.partitionBy(by).orderBy(order)
    past = {f"__u{i}_{lag}": F.lag(f"__u{i}", lag).over(over) for i in range(k) for lag in range(1, lags + 1)}
    lagged = scored.withColumns(past)

    def product(i: int, j: int) -> Column:
        own = F.sum(F.col(f"__u{i}") * F.col(f"__u{j}"))
        back = [
            F.coalesce(F.sum(F.col(f"__u{i}") * F.col(f"__u{j}_{lag}") + F.col(f"__u{j}") * F.col(f"__u{i}_{lag}")), F.lit(0.0)) * (1 - lag / (lags + 1))
            for lag in range(1, lags + 1)
        ]
        return total([own, *back])

    middle = lagged.groupBy(by).agg(F.array(*[product(i, j) for i in range(k) for j in range(k)]).alias("__middle"))
    made = fitted.join(middle, by, "left").withColumn("__se", _spread("__gram", "__middle", "__beta"))
    each = F.array(*[F.struct(F.lit(t).alias("term"), F.col("__beta")[i].alias("coefficient"), F.col("__se")[i].alias("std_error")) for i, t in enumerate(terms)])
    out = made.select(by, "n", F.explode(each).alias("t")).select(by, "t.term", "n", "t.coefficient", "t.std_error")
    t_value = F.col("coefficient") / F.nullif(F.col("std_error"), F.lit(0.0))
    return out.withColumn("t_value", t_value).withColumn("p_value", two_sided(F.col("t_value")))


# ---- forecasts against each other ----


def _loss(truth: str, model: str, power: int) -> Column:
    e = F.abs(finite(truth) - finite(model))
    return e if power == 1 else F.pow(e, float(power))


def diebold_mariano(df: DataFrame, truth: str, models: list[str], horizon: int = 1, power: int = 2, date: str = "date") -> DataFrame:
    """``model_a, model_b, n, mean_difference, statistic, p_value`` of every pair of forecast columns.

    The loss of a forecast is its error to the ``power``; the differences of a pair are averaged over the rows of a date on
    which both forecasts and the truth are known, and n counts such dates.  Errors of forecasts over ``horizon`` dates
    overlap, so the variance of the mean takes ``horizon - 1`` lags; should that sum not be positive, the lags enter with
    falling weights.  The statistic is corrected for short series and compared with the normal distribution; NULL where the
    differences do not vary or n is not above the horizon.  A negative statistic speaks for ``model_a``.
    """
    pairs = list(combinations(models, 2))
    losses = df.select(date, *[_loss(truth, m, power).alias(f"__{i}") for i, m in enumerate(models)]).filter(F.col(date).isNotNull())
    gap = lambda a, b: F.col(f"__{models.index(a)}") - F.col(f"__{models.index(b)}")
    daily = losses.groupBy(date).agg(*[F.avg(gap(a, b)).alias(f"__d{i}") for i, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"__d{i}").alias("d")) for i, (a, b) in enumerate(pairs)])
    long = daily.select(date, F.explode(each).alias("p")).select(date, "p.*").filter("d IS NOT NULL")
    pair = Window.partitionBy("model_a", "model_b")  # one row a date
    long = long.withColumn("__c", F.col("d") - F.avg("d").over(pair))
    lagged = long.withColumns({f"__l{j}": F.lag("__c", j).over(pair.orderBy(date)) for j in range(1, horizon)})
    sums = lagged.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_difference"), F.avg(F.col("__c") * F.col("__c")).alias("__g0"),
        *[F.coalesce(F.sum(F.col("__c") * F.col(f"__l{j}")), F.lit(0.0)).alias(f"__g{j}") for j in range(1, horizon)],
    )
    n, h = F.col("n").cast("double"), float(horizon)
    flat = total([F.col("__g0"), *[2.0 * F.col(f"__g{j}") / n for j in range(1, horizon)]])
    falling = total([F.col("__g0"), *[2.0 * (1 - j / horizon) * F.col(f"__g{j}") / n for j in range(1, horizon)]])
    variance = F.when(flat > 1e-12 * F.col("__g0"), flat).when(falling > 1e-12 * F.col("__g0"), falling)
    short = F.sqrt((n + 1.0 - 2.0 * h + h * (h - 1.0) / n) / n)
    statistic = F.when((F.col("__g0") > 0) & (n > h), F.col("mean_difference") / F.sqrt(variance / n) * short)
    out = sums.select("model_a", "model_b", "n", "mean_difference", statistic.alias("statistic"))
    return out.withColumn("p_value", two_sided(F.col("statistic")))


def holm(tests: DataFrame, p: str = "p_value", level: float = SIGNIFICANT, by: list[str] | None = None) -> DataFrame:
    """``p_holm`` and ``rejected``: p-values of a family of tests corrected step by step, smallest first.

    The family is the whole table or a group of it, one row a test; a NULL p-value is no test.
    """
    ordered = Window.partitionBy(*(by or [])).orderBy(p, *[c for c in tests.columns if c != p])
    some = F.col(p).isNotNull()
    of, place = F.count(p).over(Window.partitionBy(*(by or []))), F.count(p).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    raised = tests.withColumn("__r", F.when(some, F.least((of - place + 1) * F.col(p), F.lit(1.0))))
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    out = raised.withColumn("p_holm", F.when(some, F.max("__r").over(upto))).drop("__r")
    return out.withColumn("rejected", F.coalesce(F.col("p_holm") <= level, F.lit(False)))


def reality_check(
    df: DataFrame, truth: str, benchmark: str, models: list[str], power: int = 2, replicates: int = REPLICATES, days: int = BLOCK_DAYS,
    seed: int = SEED, level: float = SIGNIFICANT, date: str = "date",
) -> DataFrame:
    """Whether any of many models beats a benchmark by more than the best of them would by luck.

    Per model: ``n`` dates, ``gain`` (mean loss of the benchmark less that of the model, over daily means), ``statistic``
    (gain times the root of n), ``p_value`` of the model alone, ``p_reality`` (the chance that the greatest centred gain of all models in a
    replicate reaches the model's: for the best model, that of the whole search), ``p_holm`` and ``rejected``.  Models share
    the weights of a replicate.  Dates enter on which truth, benchmark and all models are known.
    """
    losses = df.select(F.col(date).alias("date"), *[_loss(truth, m, power).alias(f"__{i}") for i, m in enumerate([benchmark, *models])]).na.drop()
    gains = [f"__f{i}" for i in range(len(models))]
    daily = losses.groupBy("date").agg(*[F.avg(F.col("__0") - F.col(f"__{i + 1}")).alias(g) for i, g in enumerate(gains)])
    blocks = daily.groupBy(block_of(days=days).alias("__block")).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(g).alias(g) for g in gains])
    sums = blocks.agg(F.sum("n").alias("n"), *[F.sum(g).alias(g) for g in gains])
    own = sums.select("n", F.array(*[F.col(g) / F.col("n") for g in gains]).alias("__own"))  # one row
    drawn = _weighted(blocks, [], ["n", *gains], replicates, seed).select("replicate", F.array(*[F.col(g) / F.col("n") for g in gains]).alias("__drawn"))
    centred = F.zip_with("__drawn", "__own", lambda a, b: a - b)
    joined = drawn.crossJoin(F.broadcast(own.select("__own"))).select("__own", centred.alias("__c")).withColumn("__most", F.array_max("__c"))
    reach = lambda i, c: F.avg((c >= F.col("__own")[i]).cast("double"))
    p = joined.agg(
        F.array(*[reach(i, F.col("__c")[i]) for i in range(len(models))]).alias("__alone"),
        F.array(*[reach(i, F.col("__most")) for i in range(len(models))]).alias("__joint"),
    )
    each = F.array(*[
        F.struct(
            F.lit(m).alias("model"), F.col("n").cast("bigint").alias("n"), F.col("__own")[i].alias("gain"), (F.col("__own")[i] * F.sqrt("n")).alias("statistic"),
            F.col("__alone")[i].alias("p_value"), F.col("__joint")[i].alias("p_reality"),
        )
        for i, m in enumerate(models)
    ])
    made = own.crossJoin(F.broadcast(p)).filter("n > 0").select(F.explode(each).alias("m")).select("m.*")  # one row a side
    return holm(made, level=level)
