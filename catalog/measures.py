"""Forecast metrics, risk, descriptive tables and data-quality queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tapeloom.operators import decay, indicators as ind, joins, metrics, news, quality, risk, summary
from tapeloom.operators.positions import spearman
from tapeloom.session import durable, stage_path, written
from tapeloom.sources import files

from .base import CTE, bars, daily, pick, query, rnd, scored, table
from .prep import FEATURES, panel

KEY = ["symbol", "date"]
_BY = "PARTITION BY symbol ORDER BY date"

# ---- forecasts: yesterday's return as forecast of today's, per split ----

CTE["forecast"] = CTE["panel"] + f""",
forecast AS (SELECT symbol, date, split, returns AS y, lag(returns) OVER ({_BY}) / 10 AS yhat FROM panel),
pairs AS (SELECT *, y - yhat AS e FROM forecast WHERE y IS NOT NULL AND yhat IS NOT NULL)"""


def forecast(spark, sf):
    p = panel(spark, sf)
    w = Window.partitionBy("symbol").orderBy("date")
    f = p.select(*KEY, "split", F.col("returns").alias("y"), (F.lag("returns").over(w) / 10).alias("yhat"))
    return f.filter(F.col("y").isNotNull() & F.col("yhat").isNotNull())


_MDA = "coalesce(avg(CASE WHEN abs(y) > 5e-4 THEN CAST(sign(y) = sign(yhat) AS DOUBLE) END), 5e-1)"
_TP, _FP, _FN = (f"count(*) FILTER (abs(y) > 5e-4 AND {c})" for c in ("y > 0 AND yhat > 0", "y <= 0 AND yhat > 0", "y > 0 AND yhat <= 0"))
_PR, _RE = f"({_TP} / ({_TP} + {_FP} + 1e-8))", f"({_TP} / ({_TP} + {_FN} + 1e-8))"
METRICS = {
    "rmse": "sqrt(avg(e * e))", "mae": "avg(abs(e))", "r2": "1 - sum(e * e) / (var_pop(y) * count(*))",
    "mape": "avg(CASE WHEN abs(y) > 1e-8 THEN abs(e / y) END) * 100",
    "smape": "avg(CASE WHEN (abs(y) + abs(yhat)) / 2 > 1e-8 THEN abs(e) / ((abs(y) + abs(yhat)) / 2) END) * 100",
    "directional_accuracy": _MDA, "directional_f1": f"2 * {_PR} * {_RE} / ({_PR} + {_RE} + 1e-8)",
    "residual_mean": "avg(e)", "residual_std": "stddev_pop(e)",
    "sharpe_ratio": "sqrt(252e0) * (avg(y) - 2e-2 / 252) / stddev_pop(y)",
}


def _metric_sql(by: str) -> str:
    return f"SELECT {by}, count(*) AS rows, " + ", ".join(f"{e} AS {n}" for n, e in METRICS.items()) + f" FROM pairs GROUP BY {by}"


@query("forecast_metrics", f"WITH {CTE['forecast']}, m AS ({_metric_sql('split')}) SELECT split, rows, " + ", ".join(f"{rnd(n, 5)} AS {n}" for n in METRICS) + " FROM m")
def _(spark, sf):
    return pick(metrics.forecast_metrics(forecast(spark, sf), ["split"], "y"), ["split", "rows"], list(METRICS), 5)


@query("symbol_forecast_metrics", f"WITH {CTE['forecast']}, m AS ({_metric_sql('symbol')}) SELECT symbol, rows, " + ", ".join(f"{rnd(n, 5)} AS {n}" for n in METRICS) + " FROM m")
def _(spark, sf):
    return pick(metrics.forecast_metrics(forecast(spark, sf), ["symbol"], "y"), ["symbol", "rows"], list(METRICS), 5)


_HUBER = "avg(CASE WHEN abs(e) <= 1e-1 THEN 5e-1 * e * e ELSE 1e-1 * (abs(e) - 5e-2) END)"


@query(
    "forecast_losses",
    f"WITH {CTE['forecast']} SELECT split, {rnd('avg(e * e)', 5)} AS mse, {rnd(_HUBER, 5)} AS huber, "
    + rnd(f"3e-1 * avg(e * e) + 3e-1 * avg(abs(e)) + 2e-1 * {_HUBER} + 2e-1 * (1 - {_MDA})", 5) + " AS composite, "
    + ", ".join(f"{rnd(f'avg(greatest({q!r} * e, ({q!r} - 1) * e))', 5)} AS quantile_loss_{round(q * 100):02d}" for q in metrics.QUANTILES)
    + " FROM pairs GROUP BY split",
)
def _(spark, sf):
    made = ["mse", "huber", "composite", *[f"quantile_loss_{round(q * 100):02d}" for q in metrics.QUANTILES]]
    return pick(metrics.losses(forecast(spark, sf), ["split"]), ["split"], made, 5)


_LOWER = ("rmse", "mae")


@query(
    "goals_met",
    f"WITH {CTE['forecast']}, m AS ({_metric_sql('split')}) SELECT split, "
    + ", ".join(f"{n} {'<' if n in _LOWER else '>'} {g!r} AS {n}_target_met, {rnd(f'{n} - {g!r}', 5)} AS {n}_vs_target" for n, g in metrics.GOALS.items())
    + ", " + rnd("(" + " + ".join(f"CAST({n} {'<' if n in _LOWER else '>'} {g!r} AS INT)" for n, g in metrics.GOALS.items()) + ") / 5e0") + " AS overall_score FROM m",
)
def _(spark, sf):
    g = metrics.goals_met(metrics.forecast_metrics(forecast(spark, sf), ["split"], "y"))
    return pick(g, ["split", *[f"{n}_target_met" for n in metrics.GOALS]], [*[f"{n}_vs_target" for n in metrics.GOALS], "overall_score"], 5)


_GAP = "(SELECT {m} FROM m WHERE split = '{a}') - (SELECT {m} FROM m WHERE split = '{b}')"


@query(
    "overfit_gaps",
    f"""WITH {CTE['forecast']}, m AS ({_metric_sql('split')}), g AS (SELECT {_GAP.format(m='directional_accuracy', a='train', b='val')} AS mda_gap,
    {_GAP.format(m='rmse', a='val', b='train')} AS rmse_gap, {_GAP.format(m='r2', a='train', b='val')} AS r2_gap)
    SELECT 'lag' AS model, {rnd('mda_gap', 5)} AS mda_gap, {rnd('rmse_gap', 5)} AS rmse_gap, {rnd('r2_gap', 5)} AS r2_gap, mda_gap > 15e-2 OR rmse_gap > 1e-2 OR r2_gap > 15e-2 AS overfit FROM g""",
)
def _(spark, sf):
    m = metrics.forecast_metrics(forecast(spark, sf).withColumn("model", F.lit("lag")), ["model", "split"])
    return pick(metrics.overfit_gaps(m, ["model"]), ["model", "overfit"], ["mda_gap", "rmse_gap", "r2_gap"], 5)


@query(
    "expected_ranking",
    f"WITH {CTE['forecast']}, m AS ({_metric_sql('split')}) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS metric, (SELECT {n} FROM m WHERE split = 'train') {o} (SELECT {n} FROM m WHERE split = 'val') AND (SELECT {n} FROM m WHERE split = 'val') {o} (SELECT {n} FROM m WHERE split = 'test') AS as_expected"
        for n, o in (("rmse", "<"), ("mae", "<"), ("r2", ">"), ("directional_accuracy", ">"))
    ),
)
def _(spark, sf):
    """Whether each metric is best on training rows and worst on test rows."""
    r = metrics.rank_models(metrics.forecast_metrics(forecast(spark, sf), ["split"]), "split", ["rmse", "mae", "r2", "directional_accuracy"])
    return metrics.expected_order(r, "split", ["train", "val", "test"])


@query(
    "model_ranking",
    f"WITH {CTE['forecast']}, m AS ({_metric_sql('split')}) "
    + " UNION ALL ".join(f"SELECT split, '{n}' AS metric, {rnd(n, 5)} AS value, CAST(rank() OVER (ORDER BY {n} {'' if n in _LOWER else 'DESC'}) AS INTEGER) AS rank FROM m" for n in ("rmse", "mae", "r2", "directional_accuracy")),
)
def _(spark, sf):
    r = metrics.rank_models(metrics.forecast_metrics(forecast(spark, sf), ["split"]), "split", ["rmse", "mae", "r2", "directional_accuracy"])
    return pick(r, ["split", "metric", "rank"], ["value"], 5)


_GROWN = f"""grown AS (SELECT symbol, date, exp(sum(ln(1 + returns)) OVER ({_BY} ROWS UNBOUNDED PRECEDING)) AS c FROM rets WHERE returns IS NOT NULL),
falls AS (SELECT symbol, date, c / max(c) OVER ({_BY} ROWS UNBOUNDED PRECEDING) - 1 AS d FROM grown)"""


@query("max_drawdown", f"WITH {CTE['returns']}, {_GROWN} SELECT symbol, {rnd('min(d)')} AS max_drawdown FROM falls GROUP BY symbol")
def _(spark, sf):
    return pick(metrics.max_drawdown(ind.returns(bars(spark, sf)), "returns"), ["symbol"], ["max_drawdown"])


@query("price_drawdown", f"WITH {CTE['returns']}, {_GROWN} SELECT symbol, {rnd('min(d)')} AS max_drawdown FROM falls GROUP BY symbol")
def _(spark, sf):
    return pick(metrics.max_drawdown(bars(spark, sf), "close", "prices"), ["symbol"], ["max_drawdown"])


@query(
    "ljung_box",
    f"""WITH {CTE['returns']}, c AS (SELECT symbol, date, returns - avg(returns) OVER (PARTITION BY symbol) AS e FROM rets WHERE returns IS NOT NULL),
    p AS (SELECT *, {', '.join(f"lag(e, {k}) OVER ({_BY}) AS l{k}" for k in range(1, 11))} FROM c),
    r AS (SELECT symbol, count(*) AS n, {', '.join(f"sum(e * l{k}) / sum(e * e) AS r{k}" for k in range(1, 11))} FROM p GROUP BY symbol)
    SELECT symbol, n, 10 AS lags, {rnd('n * (n + 2) * (' + ' + '.join(f'r{k} * r{k} / (n - {k})' for k in range(1, 11)) + ')', 4)} AS q,
      {rnd('exp(-q2) * (1 + q2 + q2 ** 2 / 2 + q2 ** 3 / 6 + q2 ** 4 / 24)', 4)} AS p_value,
      exp(-q2) * (1 + q2 + q2 ** 2 / 2 + q2 ** 3 / 6 + q2 ** 4 / 24) > 5e-2 AS passed
    FROM (SELECT *, n * (n + 2) * ({' + '.join(f'r{k} * r{k} / (n - {k})' for k in range(1, 11))}) / 2 AS q2 FROM r)""",
)
def _(spark, sf):
    lb = metrics.ljung_box(ind.returns(bars(spark, sf)), "returns")
    return pick(lb, ["symbol", "n", "lags", "passed"], ["q", "p_value"], 4)


# ---- risk ----

_N = "count(returns)"
RISK = {
    "mean_return_daily": "avg(returns)", "volatility_daily": "stddev_samp(returns)", "mean_return_annual": "avg(returns) * 252",
    "volatility_annual": "stddev_samp(returns) * sqrt(252)", "sharpe_ratio": "avg(returns) * 252 / (stddev_samp(returns) * sqrt(252))",
    "sortino_ratio": "avg(returns) * 252 / (stddev_samp(returns) FILTER (returns < 0) * sqrt(252))",
    "max_drawdown": "min(d)", "calmar_ratio": "abs(avg(returns) * 252 / min(d))",
    "var_5": "any_value(q5)", "var_1": "any_value(q1)", "cvar_5": "avg(returns) FILTER (returns <= q5)", "cvar_1": "avg(returns) FILTER (returns <= q1)",
    "skewness": "skewness(returns)", "kurtosis": "kurtosis(returns)", "hit_ratio": "avg(CAST(returns > 0 AS DOUBLE))",
}
CTE["risk"] = CTE["returns"] + f""", {_GROWN},
tails AS (SELECT symbol, quantile_cont(returns, 5e-2) AS q5, quantile_cont(returns, 1e-2) AS q1 FROM rets GROUP BY symbol),
risk AS (SELECT symbol, {_N} AS observations, """ + ", ".join(f"{e} AS {n}" for n, e in RISK.items()) + """,
         min(close) AS lowest_price, max(close) AS highest_price FROM rets JOIN tails USING (symbol) LEFT JOIN falls USING (symbol, date) GROUP BY symbol)"""


@query(
    "risk_table",
    f"WITH {CTE['risk']} SELECT symbol, observations, " + ", ".join(f"{rnd(n, 5)} AS {n}" for n in RISK)
    + f", {rnd('lowest_price', 8)} AS lowest_price, {rnd('highest_price', 8)} AS highest_price FROM risk",
)
def _(spark, sf):
    r = risk.risk_table(ind.returns(bars(spark, sf)))
    return pick(r, ["symbol", "observations"], [*RISK, "lowest_price", "highest_price"], 5, {"lowest_price": 8, "highest_price": 8})


@query(
    "risk_extremes",
    f"""WITH {CTE['risk']} SELECT (SELECT symbol FROM risk ORDER BY sharpe_ratio DESC, symbol LIMIT 1) AS best_sharpe,
    (SELECT symbol FROM risk ORDER BY volatility_annual, symbol LIMIT 1) AS lowest_volatility,
    (SELECT symbol FROM risk ORDER BY mean_return_annual DESC, symbol LIMIT 1) AS highest_return,
    (SELECT symbol FROM risk ORDER BY max_drawdown DESC, symbol LIMIT 1) AS smallest_drawdown""",
)
def _(spark, sf):
    return risk.extremes(risk.risk_table(ind.returns(bars(spark, sf))))


@query(
    "risk_classes",
    f"WITH {CTE['risk']} SELECT symbol, {rnd('volatility_annual', 5)} AS volatility_annual, CASE WHEN volatility_annual > (SELECT quantile_cont(volatility_annual, 5e-1) FROM risk) THEN 'high' ELSE 'low' END AS risk_class FROM risk",
)
def _(spark, sf):
    table_ = durable(risk.risk_table(ind.returns(bars(spark, sf))))
    return pick(risk.risk_classes(table_), ["symbol", "risk_class"], ["volatility_annual"], 5)


# ---- descriptive tables ----


@query(
    "data_summary",
    f"""WITH {CTE['panel']} SELECT count(*) AS rows, 9 AS columns, count(DISTINCT symbol) AS symbols, min(date) AS first_date, max(date) AS last_date,
    CAST(max(date) - min(date) AS INTEGER) AS days, {rnd('count(target_5) / count(*)')} AS target_5_coverage,
    {rnd("(" + " + ".join(f"count({c})" for c in [*KEY, *FEATURES, "target_5", "split"]) + ") / (count(*) * 9e0)")} AS overall_coverage FROM panel""",
)
def _(spark, sf):
    s = summary.data_summary(panel(spark, sf))
    return pick(s, ["rows", "columns", "symbols", "first_date", "last_date", "days"], ["target_5_coverage", "overall_coverage"])


@query(
    "null_report",
    f"WITH {CTE['panel']} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, {rnd(f'(count(*) - count({c})) * 100e0 / count(*)')} AS null_pct FROM panel" for c in [*FEATURES, "target_5"]),
)
def _(spark, sf):
    return pick(summary.null_report(panel(spark, sf), [*FEATURES, "target_5"]), ["column", "nulls"], ["null_pct"])


_TWICE = "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_quantity > 40"


@query("duplicate_rows", f"WITH t AS ({_TWICE}) SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows FROM t")
def _(spark, sf):
    """Whole rows, some of which were loaded twice."""
    lines = table(spark, sf, "lineitem")
    return summary.duplicate_rows(lines.unionByName(lines.filter("l_quantity > 40")))


@query("rows_per_symbol", f"WITH {CTE['bars']} SELECT symbol, count(*) AS rows FROM bars GROUP BY symbol")
def _(spark, sf):
    return summary.rows_per_symbol(bars(spark, sf))


_DESCRIBED = ["close", "volume", "returns", "target_5"]


@query(
    "described_columns",
    f"WITH {CTE['panel']} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, " + ", ".join(f"{rnd(e.format(c=c), 3)} AS {n}" for n, e in {
            "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})", "q25": "quantile_cont({c}, 25e-2)",
            "q50": "quantile_cont({c}, 5e-1)", "q75": "quantile_cont({c}, 75e-2)"}.items()) + " FROM panel" for c in _DESCRIBED),
)
def _(spark, sf):
    return pick(summary.describe(panel(spark, sf), _DESCRIBED), ["column", "count"], ["mean", "std", "min", "max", "q25", "q50", "q75"], 3)


@query("target_means", f"WITH {CTE['targets']} SELECT symbol, " + ", ".join(f"{rnd(f'avg(target_{h}d)')} AS target_{h}d" for h in (5, 22, 90)) + " FROM targets GROUP BY symbol")
def _(spark, sf):
    names = [f"target_{h}d" for h in (5, 22, 90)]
    return pick(summary.group_means(ind.horizon_returns(bars(spark, sf)), names), ["symbol"], names)


@query("target_quantiles", f"WITH {CTE['targets']} SELECT symbol, {rnd('quantile_cont(target_5d, 5e-2)')} AS q_low, {rnd('quantile_cont(target_5d, 95e-2)')} AS q_high FROM targets GROUP BY symbol")
def _(spark, sf):
    return pick(summary.group_quantiles(ind.horizon_returns(bars(spark, sf)), "target_5d"), ["symbol"], ["q_low", "q_high"])


@query(
    "trimmed_targets",
    f"""WITH {CTE['targets']}, q AS (SELECT symbol, quantile_cont(target_5d, 5e-2) AS lo, quantile_cont(target_5d, 95e-2) AS hi FROM targets GROUP BY symbol)
    SELECT symbol, date, {rnd('target_5d')} AS target_5d FROM targets JOIN q USING (symbol) WHERE target_5d BETWEEN lo AND hi""",
)
def _(spark, sf):
    return pick(summary.trimmed(ind.horizon_returns(bars(spark, sf)), "target_5d"), KEY, ["target_5d"])


_SENT = ["sentiment_compound", "sentiment_positive", "sentiment_negative", "confidence"]
_STATS = {
    "coverage_pct": "count({c}) * 100e0 / count(*)", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})",
    "non_zero_pct": "avg(CAST({c} <> 0 AS DOUBLE)) * 100",
}


def _stats(source: str, by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    prefix = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {prefix}'{c}' AS feature, count({c}) AS count, " + ", ".join(f"{rnd(e.format(c=c), 5)} AS {n}" for n, e in _STATS.items()) + f" FROM {source}{group}"
        for c in _SENT
    )


_JOINED = f"{CTE['bars']}, {CTE['daily']}, joined AS (SELECT b.symbol, b.date, d.sentiment_compound, d.sentiment_positive, d.sentiment_negative, d.confidence FROM bars b LEFT JOIN daily d ON d.symbol = b.symbol AND d.date = b.date)"


def joined(spark, sf):
    d = daily(spark, sf).select(*KEY, *_SENT)
    return bars(spark, sf).select(*KEY).join(d, KEY, "left")


@query("sentiment_statistics", f"WITH {_JOINED} {_stats('joined')}")
def _(spark, sf):
    return pick(summary.feature_statistics(joined(spark, sf), _SENT), ["feature", "count"], list(_STATS), 5)


@query("symbol_sentiment_statistics", f"WITH {_JOINED} {_stats('joined', 'symbol')}")
def _(spark, sf):
    return pick(summary.feature_statistics(joined(spark, sf), _SENT, ["symbol"]), ["symbol", "feature", "count"], list(_STATS), 5)


@query("target_coverage", f"WITH {CTE['targets']} " + " UNION ALL ".join(f"SELECT 'target_{h}d' AS target, {rnd(f'count(target_{h}d) / count(*)')} AS coverage FROM targets" for h in (5, 22, 90)))
def _(spark, sf):
    t = ind.horizon_returns(bars(spark, sf)).drop("target_5", "target_5_log", "target_5_direction")
    return pick(summary.target_coverage(t), ["target"], ["coverage"])


_MOOD = f"""{CTE['targets']}, {CTE['daily']}, latest AS (SELECT t.symbol, t.date, t.target_5d, t.target_22d, coalesce(d.sentiment_compound, 0) AS sentiment_last, coalesce(d.confidence, 0) AS confidence_last
  FROM targets t ASOF LEFT JOIN daily d ON d.symbol = t.symbol AND t.date >= d.date)"""
_LAST = ["sentiment_last", "confidence_last"]


def mood(spark, sf):
    from tapeloom.operators.windows import asof_attach

    market = ind.horizon_returns(bars(spark, sf)).select(*KEY, "target_5d", "target_22d")
    d = daily(spark, sf).select(*KEY, F.col("sentiment_compound").alias("sentiment_last"), F.col("confidence").alias("confidence_last"))
    return asof_attach(market, d, _LAST).fillna(0.0, subset=_LAST)


@query("nonzero_coverage", f"WITH {_MOOD} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {rnd(f'avg(CAST({c} <> 0 AS DOUBLE)) * 100')} AS non_zero_pct FROM latest" for c in _LAST))
def _(spark, sf):
    return pick(summary.nonzero_coverage(mood(spark, sf), _LAST), ["feature"], ["non_zero_pct"])


_TARGETS = ["target_5", "target_22"]
CTE["two_targets"] = CTE["panel"] + f""",
two AS (SELECT p.*, close / lag(close, 22) OVER ({_BY}) - 1 AS target_22 FROM panel p)"""


@query(
    "target_correlations",
    f"WITH {CTE['two_targets']}, c AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, '{t}' AS target, corr({f}, {t}) AS correlation, count(*) FILTER ({f} IS NOT NULL AND {t} IS NOT NULL) AS rows FROM two" for f in FEATURES for t in _TARGETS)
    + f") SELECT feature, target, rows, {rnd('correlation')} AS correlation, {rnd('abs(correlation)')} AS abs_correlation FROM c WHERE abs(correlation) > 1e-2 AND rows >= 50",
)
def _(spark, sf):
    w = Window.partitionBy("symbol").orderBy("date")
    two = panel(spark, sf).withColumn("target_22", F.col("close") / F.lag("close", 22).over(w) - 1)
    t = summary.target_correlations(two, FEATURES, _TARGETS)
    return pick(t, ["feature", "target", "rows"], ["correlation", "abs_correlation"])


@query(
    "strongest_correlations",
    f"WITH {CTE['panel']}, c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS \"left\", corr({f}, target_5) AS correlation FROM panel" for f in FEATURES)
    + f") SELECT \"left\", {rnd('correlation')} AS correlation FROM c ORDER BY abs(correlation) DESC LIMIT 5",
)
def _(spark, sf):
    from tapeloom.operators.selection import pairwise_correlations

    pairs = pairwise_correlations(panel(spark, sf), [(f, "target_5") for f in FEATURES])
    return pick(pairs.orderBy(F.desc(F.abs("correlation"))).limit(5), ["left"], ["correlation"])


@query(
    "rank_correlation",
    f"""WITH {CTE['panel']}, p AS (SELECT split, volume AS x, returns AS y FROM panel WHERE volume IS NOT NULL AND returns IS NOT NULL),
    k AS (SELECT split, rank() OVER (PARTITION BY split ORDER BY x) + (count(*) OVER (PARTITION BY split, x) - 1) / 2e0 AS rx,
                 rank() OVER (PARTITION BY split ORDER BY y) + (count(*) OVER (PARTITION BY split, y) - 1) / 2e0 AS ry FROM p)
    SELECT split, {rnd('corr(rx, ry)')} AS spearman, count(*) AS rows FROM k GROUP BY split""",
)
def _(spark, sf):
    p = panel(spark, sf).select("split", F.col("volume").alias("x"), F.col("returns").alias("y"))
    return pick(spearman(p, ["split"], "split", "x", "y"), ["split", "rows"], ["spearman"])


def _population_skew(c: str) -> str:
    return f"(avg({c} * {c} * {c}) - 3 * avg({c}) * avg({c} * {c}) + 2 * pow(avg({c}), 3)) / pow(stddev_pop({c}), 3)"


@query(
    "distribution_check",
    f"WITH {_MOOD} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {rnd(f'avg({c})')} AS mean, {rnd(f'stddev_samp({c})')} AS std, {rnd(_population_skew(c), 5)} AS skewness,"
        f" (SELECT count(*) FROM latest, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM latest) WHERE abs(({c} - m) / s) > 3) AS outliers FROM latest" for c in _LAST),
)
def _(spark, sf):
    d = summary.distribution_check(mood(spark, sf), _LAST)
    return pick(d, ["feature", "outliers"], ["mean", "std", "skewness"], 6, {"skewness": 5})


@query(
    "decay_sanity",
    f"WITH {_MOOD} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, min({c}) >= -5 AND max({c}) <= 5 AS bounded, stddev_samp({c}) > 1e-3 AS varies, {rnd(f'avg({c})')} AS mean,"
        f" {rnd(f'stddev_samp({c})')} AS std, {rnd(f'abs(corr({c}, target_5d))')} AS abs_correlation FROM latest" for c in _LAST),
)
def _(spark, sf):
    return pick(summary.decay_sanity(mood(spark, sf), _LAST, "target_5d"), ["feature", "bounded", "varies"], ["mean", "std", "abs_correlation"])


# ---- quality rules ----


@query("panel_violations", f"WITH {CTE['scored']} SELECT symbol, date, count(*) AS rows FROM scored GROUP BY symbol, date HAVING count(*) > 1")
def _(spark, sf):
    """Symbol-days with several scored articles: what must be aggregated before any window."""
    return quality.panel_violations(scored(spark, sf))


@query(
    "value_ranges",
    f"WITH {CTE['daily']} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {rnd(f'min({c})')} AS min_value, {rnd(f'max({c})')} AS max_value, min({c}) < {lo} AS below_minimum, {f'max({c}) > {hi}' if hi else 'false'} AS above_maximum FROM daily"
        for c, lo, hi in (("sentiment_compound", -1, 1), ("confidence", 0, 1), ("article_count", 1, None))),
)
def _(spark, sf):
    v = quality.value_ranges(daily(spark, sf), "daily_sentiment")
    return pick(v, ["column", "below_minimum", "above_maximum"], ["min_value", "max_value"])


@query(
    "general_quality",
    f"""WITH {CTE['scored']}, k AS (SELECT symbol, date, sentiment_compound, confidence FROM scored)
    SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM k)) AS duplicate_rows,
    count(*) FILTER (abs(sentiment_compound) > 95e-2) AS extreme_rows, count(*) FILTER (abs(sentiment_compound) > 95e-2) > 1e-1 * count(*) AS too_many_extreme FROM k""",
)
def _(spark, sf):
    s = scored(spark, sf).select(*KEY, "sentiment_compound", "confidence")
    return quality.general_quality(s, "sentiment_analysis")


@query(
    "stage_issues",
    f"""WITH {CTE['scored']} SELECT 'error' AS severity, 'missing_column' AS rule, 'headline' AS subject, CAST(NULL AS DOUBLE) AS value
    UNION ALL SELECT 'warning', 'above_maximum', 'confidence', {rnd('max(confidence) * 2')} FROM scored HAVING max(confidence) * 2 > 1
    UNION ALL SELECT 'error', 'custom', 'few days', NULL FROM scored HAVING count(DISTINCT date) < 1000000""",
)
def _(spark, sf):
    def enough_days(df):
        return df.agg((F.count_distinct("date") >= 1_000_000).alias("ok"), F.lit("few days").alias("message"))

    s = scored(spark, sf).select(*KEY, "sentiment_compound", (F.col("confidence") * 2).alias("confidence"))
    issues = quality.stage_issues(s, "sentiment_analysis", [enough_days])
    return pick(issues, ["severity", "rule", "subject"], ["value"])


@query(
    "dataset_validation",
    f"""WITH {CTE['panel']} SELECT * FROM (
    SELECT 'error' AS severity, 'missing_column' AS rule, c AS subject, CAST(NULL AS DOUBLE) AS value FROM (VALUES ('stock_id'), ('open'), ('high'), ('low')) v(c)
    UNION ALL SELECT 'info', 'good_target_coverage', 'target_5', {rnd('count(target_5) / count(*)')} FROM panel
    UNION ALL SELECT 'info', 'date_range', 'date', CAST(max(date) - min(date) AS DOUBLE) FROM panel
    UNION ALL SELECT 'warning', 'sparse_symbol', symbol, CAST(count(*) AS DOUBLE) FROM panel GROUP BY symbol HAVING count(*) < 100)""",
)
def _(spark, sf):
    v = quality.validate_dataset(panel(spark, sf).drop("split"))
    return pick(v, ["severity", "rule", "subject"], ["value"])


_DIRTY = """dirty AS (SELECT symbol || '-' || strftime(date, '%Y%m') AS symbol, volume % 50 = 0 AS undated, CAST(date - DATE '1990-01-01' AS INTEGER) % 20 AS d,
  volume % 7 = 0 AS endless, volume % 11 = 0 AS worded, volume % 3 <> 0 AS unknown, volume % 5 <> 0 AS open_target FROM bars)"""


def _share(flag: str) -> str:
    return rnd(f"avg(CAST({flag} AS DOUBLE))")


@query(
    "dirty_dataset_validation",
    f"""WITH {CTE['bars']}, {_DIRTY}
    SELECT 'error' AS severity, 'missing_column' AS rule, c AS subject, CAST(NULL AS DOUBLE) AS value FROM (VALUES ('stock_id'), ('low')) v(c)
    UNION ALL SELECT 'warning', 'forbidden_characters', 'close (usd)', NULL
    UNION ALL SELECT 'error', 'not_numeric', 'high', CAST(count(*) FILTER (worded) AS DOUBLE) FROM dirty HAVING count(*) FILTER (worded) > 0
    UNION ALL SELECT 'error', 'invalid_date', 'date', CAST(count(*) FILTER (undated) AS DOUBLE) FROM dirty HAVING count(*) FILTER (undated) > 0
    UNION ALL SELECT 'warning', 'mostly_null', 'close', {_share('unknown')} FROM dirty HAVING {_share('unknown')} > 5e-1
    UNION ALL SELECT 'warning', 'mostly_null', 'target_5', {_share('open_target')} FROM dirty HAVING {_share('open_target')} > 5e-1
    UNION ALL SELECT 'warning', 'infinite', 'open', CAST(count(*) FILTER (endless) AS DOUBLE) FROM dirty HAVING count(*) FILTER (endless) > 0
    UNION ALL SELECT 'warning', 'low_target_coverage', 'target_5', {_share('NOT open_target')} FROM dirty
    UNION ALL SELECT 'info', 'good_target_coverage', 'target_22d', 1e0
    UNION ALL SELECT 'warning', 'short_date_range', 'date', CAST(max(d) - min(d) AS DOUBLE) FROM dirty WHERE NOT undated
    UNION ALL SELECT 'warning', 'sparse_symbol', symbol, CAST(count(*) AS DOUBLE) FROM dirty GROUP BY symbol HAVING count(*) < 100""",
)
def _(spark, sf):
    """Bars spoilt in every way the validation knows."""
    v = F.col("volume")
    days = F.date_add(F.lit("2020-01-01").cast("date"), F.datediff("date", F.lit("1990-01-01").cast("date")) % 20)
    dirty = bars(spark, sf).select(
        F.concat("symbol", F.lit("-"), F.date_format("date", "yyyyMM")).alias("symbol"), F.when(v % 50 == 0, "some day").otherwise(days.cast("string")).alias("date"),
        F.when(v % 7 == 0, float("inf")).otherwise(F.col("open").cast("double")).alias("open"), F.when(v % 11 == 0, "high").otherwise(F.col("high").cast("string")).alias("high"),
        F.when(v % 3 == 0, F.col("close")).alias("close"), "volume", F.col("close").alias("close (usd)"), F.when(v % 5 == 0, 1.0).alias("target_5"), F.lit(1.0).alias("target_22d"),
    )
    return pick(quality.validate_dataset(dirty), ["severity", "rule", "subject"], ["value"])


@query(
    "cross_source_check",
    f"""WITH {CTE['bars'].replace('bars AS (', 'traded AS (', 1)}, {CTE['daily']}, d AS (SELECT * FROM daily),
    bars AS (SELECT * FROM traded UNION ALL SELECT * REPLACE ('N' || symbol AS symbol) FROM traded)
    SELECT CAST(0 AS BIGINT) AS null_values, {rnd('avg(CAST(confidence < 5e-1 AS DOUBLE))')} AS low_confidence_share, avg(CAST(confidence < 5e-1 AS DOUBLE)) > 3e-1 AS too_many_low_confidence,
    min(date) AS sentiment_first, max(date) AS sentiment_last, (SELECT min(date) FROM bars) AS market_first, (SELECT max(date) FROM bars) AS market_last,
    (SELECT count(DISTINCT symbol) FROM bars WHERE symbol NOT IN (SELECT symbol FROM d)) AS symbols_without_sentiment FROM d""",
)
def _(spark, sf):
    traded = bars(spark, sf)  # and twins that nobody writes about
    market = traded.unionByName(traded.withColumn("symbol", F.concat(F.lit("N"), "symbol")))
    c = quality.cross_source_check(market, daily(spark, sf))
    return pick(c, [x for x in c.columns if x != "low_confidence_share"], ["low_confidence_share"])


@query(
    "enhancement_safety",
    f"""WITH {CTE['daily']}, n AS (SELECT * FROM daily WHERE article_count > 1 OR confidence > 6e-1)
    SELECT bool_and(sentiment_compound BETWEEN -1 AND 1) AS valid_sentiment_range, bool_and(confidence BETWEEN 0 AND 1) AS valid_confidence_range, true AS no_critical_nulls,
    stddev_samp(sentiment_compound) > 1e-2 AS reasonable_distribution, count(*) >= 7e-1 * (SELECT count(*) FROM daily) AS record_count,
    NOT EXISTS (SELECT symbol FROM daily EXCEPT SELECT symbol FROM n) AS same_symbols, count(*) - (SELECT count(*) FROM daily) AS record_improvement,
    {rnd('avg(confidence) - (SELECT avg(confidence) FROM daily)')} AS confidence_improvement FROM n""",
)
def _(spark, sf):
    old = daily(spark, sf)
    s = quality.enhancement_safety(old, old.filter((F.col("article_count") > 1) | (F.col("confidence") > 0.6)))
    return pick(s, [c for c in s.columns if c != "confidence_improvement"], ["confidence_improvement"])


@query(
    "target_integrity",
    f"WITH {CTE['targets']} " + " UNION ALL ".join(
        f"SELECT 'target_{h}d' AS target, count(*) FILTER (rn <= {h} AND target_{h}d IS NOT NULL) AS early_targets, {rnd(f'avg(CAST(target_{h}d IS NOT NULL AS DOUBLE)) FILTER (rn > {h})')} AS coverage, true AS passed FROM targets"
        for h in (5, 22, 90)),
)
def _(spark, sf):
    t = quality.target_integrity(ind.horizon_returns(bars(spark, sf)), [5, 22, 90])
    return pick(t, ["target", "early_targets", "passed"], ["coverage"])


@query(
    "integration_report",
    f"""WITH {CTE['bars']}, {CTE['daily']} SELECT count(*) AS total_records, count(DISTINCT b.symbol) AS unique_symbols, min(b.date) AS first_date, max(b.date) AS last_date,
    {rnd('count(d.symbol) * 100e0 / count(*)')} AS sentiment_coverage, count(d.symbol) * 100e0 / count(*) < 50 AS moderate_coverage,
    7 AS sentiment_features, 15 AS decay_features, CASE WHEN count(d.symbol) * 100e0 / count(*) < 20 THEN 'warning' ELSE 'success' END AS status
    FROM bars b LEFT JOIN daily d ON d.symbol = b.symbol AND d.date = b.date""",
)
def _(spark, sf):
    """Bars with decayed and same-day sentiment, not filled: every decay column must still be there."""
    market, days = ind.horizon_returns(bars(spark, sf), [5]), daily(spark, sf)
    decayed = joins.attach_features(market, decay.decay_features(market.select(*KEY), days))
    r = quality.integration_report(joins.attach_sentiment(decayed, days, fill=False))
    return pick(r, [c for c in r.columns if c != "sentiment_coverage"], ["sentiment_coverage"])


_LOG_SQL = f"""WITH {CTE['scored']}, {CTE['daily'].removeprefix(CTE['scored'] + ', ').removeprefix(CTE['scored'] + ',')},
    log AS (SELECT 'daily_sentiment' AS stage, (SELECT count(*) FROM scored) AS input_rows, count(*) AS output_rows, 'aggregate' AS operations, '' AS issues FROM daily
    UNION ALL SELECT 'prepared', count(*), count(*) FILTER (article_count > 1), 'filter,drop', 'confidence' FROM daily)"""


def _stage_log(spark, sf):
    """Two stages written one after the other; the second loses a column that its schema asks for."""
    d, first = quality.logged("daily_sentiment", scored(spark, sf), lambda x: news.daily_sentiment(x, quality=False), ["aggregate"], "daily_sentiment")
    d = written(d, "daily")
    p, second = quality.logged("prepared", d, lambda x: x.filter(F.col("article_count") > 1).drop("confidence"), ["filter", "drop"], "daily_sentiment")
    written(p, "prepared")
    return quality.stage_log(spark, [first, second])


@query("stage_log", f"{_LOG_SQL} SELECT * FROM log")
def _(spark, sf):
    """The log as a JSON report, read back."""
    log, path = _stage_log(spark, sf), stage_path(spark, "stage-log")
    files.write_report(log, path)
    return spark.read.schema(log.schema).json(path)


@query(
    "pipeline_summary",
    f"{_LOG_SQL} SELECT count(*) AS stages, count(*) FILTER (issues <> '') AS stages_with_issues, CAST(sum(output_rows) AS BIGINT) AS rows_written, {rnd('min(output_rows * 100e0 / input_rows)')} AS least_kept_pct FROM log",
)
def _(spark, sf):
    return pick(quality.pipeline_summary(_stage_log(spark, sf)), ["stages", "stages_with_issues", "rows_written"], ["least_kept_pct"])


@query("sentiment_source", f"WITH {CTE['bars']} SELECT 'neutral' AS source, symbol, date, 0e0 AS sentiment_compound, 5e-1 AS confidence, CAST(0 AS BIGINT) AS article_count FROM bars")
def _(spark, sf):
    """An unusable sentiment table gives way to neutral values."""
    unusable = daily(spark, sf).drop("confidence")
    name, chosen = quality.choose_sentiment(spark, unusable, bars(spark, sf))
    return chosen.select(F.lit(name).alias("source"), *KEY, "sentiment_compound", "confidence", "article_count")
