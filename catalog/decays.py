"""Decayed sentiment, its dynamics, rate search and the flagship summary."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tapeloom.operators import decay, indicators as ind, metrics, splits
from tapeloom.plans import market_news

from .base import CTE, bars, daily, pick, query, rnd

KEY = ["symbol", "date"]
_CW = "CASE WHEN s.confidence >= 7e-1 THEN s.confidence ELSE 5e-1 * s.confidence END"
_PAIRS = "FROM bars m LEFT JOIN daily s ON s.symbol = m.symbol AND s.date <= m.date GROUP BY m.symbol, m.date"
_BASE = f"WITH {CTE['bars']}, {CTE['daily']}"


def _decayed(column: str, rate: float, weight: str = _CW, where: str = "true") -> str:
    """Weighted mean over the joined history, weights taken directly from the age in days."""
    w = f"{weight} * exp(-{rate!r} * (m.date - s.date))"
    return f"coalesce(sum({column} * {w}) FILTER ({where}) / nullif(sum({w}) FILTER ({where}), 0), 0)"


_DECAY = {
    f"sentiment_decay_{h}d_{m}": _decayed(f"s.{c}", rate)
    for h, rate in decay.RATES.items()
    for m, c in decay.DECAYED.items()
}


@query(
    "decay_features",
    f"{_BASE} SELECT m.symbol, m.date, " + ", ".join(f"{rnd(e)} AS {n}" for n, e in _DECAY.items()) + f" {_PAIRS}",
)
def _(spark, sf):
    return pick(decay.decay_features(bars(spark, sf).select(*KEY), daily(spark, sf)), KEY, list(_DECAY))


def _recent(days: int) -> str:
    return f"s.date > m.date - {days}"


_DYNAMICS = {
    **{
        f"sentiment_volatility_{d}d": f"CASE WHEN count(s.date) FILTER ({_recent(d)}) >= 3 THEN stddev_samp(s.sentiment_compound) FILTER ({_recent(d)}) ELSE 0 END"
        for d in decay.VOLATILITY_DAYS
    },
    **{
        f"sentiment_momentum_{d}d": f"CASE WHEN count(s.date) FILTER ({_recent(d)}) >= 2 THEN coalesce(regr_slope(s.sentiment_compound, s.k) FILTER ({_recent(d)}), 0) ELSE 0 END"
        for d in decay.MOMENTUM_DAYS
    },
    "confidence_mean": "CASE WHEN count(s.date) >= 5 THEN avg(s.confidence) ELSE 5e-1 END",
    "confidence_std": "CASE WHEN count(s.date) >= 5 THEN stddev_samp(s.confidence) ELSE 0 END",
    "high_confidence_ratio": "CASE WHEN count(s.date) >= 5 THEN avg(CAST(s.confidence >= 7e-1 AS DOUBLE)) ELSE 5e-1 END",
}
#: Means of two-digit numbers end on a tie at six digits for some counts.
_FINER = {"confidence_mean": 10, "high_confidence_ratio": 10}
_DYN_PAIRS = (
    "FROM bars m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM daily) s"
    " ON s.symbol = m.symbol AND s.date <= m.date GROUP BY m.symbol, m.date"
)


@query(
    "sentiment_dynamics",
    f"{_BASE} SELECT m.symbol, m.date, " + ", ".join(f"{rnd(e, _FINER.get(n, 6))} AS {n}" for n, e in _DYNAMICS.items()) + f" {_DYN_PAIRS}",
)
def _(spark, sf):
    return pick(decay.sentiment_dynamics(bars(spark, sf).select(*KEY), daily(spark, sf)), KEY, list(_DYNAMICS), 6, _FINER)


@query(
    "all_decay_features",
    f"{_BASE.replace('bars AS (', 'traded AS (', 1)}, bars AS (SELECT symbol, date FROM traded UNION ALL SELECT 'N' || symbol, date FROM traded) SELECT m.symbol, m.date, "
    + ", ".join(f"{rnd(e, _FINER.get(n, 6))} AS {n}" for n, e in {**_DECAY, **_DYNAMICS}.items())
    + " " + _DYN_PAIRS,
)
def _(spark, sf):
    """All decay columns when half of the symbols have no news at all: each symbol has a twin that nobody writes about."""
    traded = bars(spark, sf).select(*KEY)
    market = traded.unionByName(traded.withColumn("symbol", F.concat(F.lit("N"), "symbol")))
    return pick(decay.all_decay_features(market, daily(spark, sf)), KEY, [*_DECAY, *_DYNAMICS], 6, _FINER)


@query(
    "prepared_daily",
    f"WITH {CTE['daily']} SELECT symbol, date, {rnd('CASE WHEN article_count > 1 THEN confidence ELSE 8e-1 END')} AS confidence FROM daily WHERE article_count > 0",
)
def _(spark, sf):
    d = daily(spark, sf).withColumn("confidence", F.when(F.col("article_count") > 1, F.col("confidence")))
    return pick(decay.prepare_daily(d), KEY, ["confidence"])


_WINDOWED = {
    f"sentiment_decay_{h}d": f"CASE WHEN count(s.date) FILTER (s.date >= m.date - {back}) >= 3 THEN "
    + _decayed("s.sentiment_compound", rate, where=f"s.date >= m.date - {back}") + " ELSE 0 END"
    for h, (rate, back) in decay.WINDOWED.items()
}


@query(
    "windowed_decay",
    f"{_BASE} SELECT m.symbol, m.date, " + ", ".join(f"{rnd(e)} AS {n}" for n, e in _WINDOWED.items()) + f" {_PAIRS}",
)
def _(spark, sf):
    w = decay.windowed_decay(bars(spark, sf).select(*KEY), daily(spark, sf))
    return pick(w, KEY, list(_WINDOWED))


_GRID = decay.rate_grid()
_GRID_SQL = ", ".join(f"({h}, {r!r})" for h, rates in _GRID.items() for r in rates)
_DATES = """ordered AS (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)),
cuts AS (SELECT max(date) FILTER (r <= n * 70 // 100) AS train_end, max(date) FILTER (r <= n * 90 // 100) AS val_end FROM ordered)"""


@query(
    "decay_rate_scores",
    f"""WITH {CTE['targets']}, {CTE['daily']}, {_DATES}, grid(horizon, rate) AS (VALUES {_GRID_SQL}),
    m AS (SELECT t.symbol, t.date, horizon, CASE horizon WHEN 5 THEN target_5d WHEN 22 THEN target_22d ELSE target_90d END AS target
          FROM targets t, cuts, (VALUES (5), (22), (90)) h(horizon) WHERE t.date <= train_end),
    v AS (SELECT m.horizon, g.rate, m.target, coalesce(sum(s.sentiment_compound * {_CW} * exp(-g.rate * (m.date - s.date)))
            / nullif(sum({_CW} * exp(-g.rate * (m.date - s.date))), 0), 0) AS x
          FROM m JOIN grid g USING (horizon) LEFT JOIN daily s ON s.symbol = m.symbol AND s.date <= m.date
          WHERE m.target IS NOT NULL GROUP BY m.symbol, m.date, m.horizon, g.rate, m.target),
    k AS (SELECT horizon, rate, rank() OVER (PARTITION BY horizon, rate ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY horizon, rate, round(x, 9)) - 1) / 2e0 AS rx,
                 rank() OVER (PARTITION BY horizon, rate ORDER BY target) + (count(*) OVER (PARTITION BY horizon, rate, target) - 1) / 2e0 AS ry FROM v)
    SELECT horizon, {rnd('rate')} AS rate, {rnd('corr(rx, ry)', 5)} AS spearman, count(*) AS rows FROM k GROUP BY horizon, rate""",
)
def _(spark, sf):
    panel = splits.temporal_split(ind.horizon_returns(bars(spark, sf)))
    scores = decay.score_rates(panel.filter(F.col("split") == "train"), daily(spark, sf), _GRID)
    return scores.select("horizon", F.round("rate", 6).alias("rate"), F.round("spearman", 5).alias("spearman"), "rows")


def _rate_scores(grid: str, out: str) -> str:
    """Rank correlation per horizon and rate of a grid, as a SQL table."""
    return f"""{out} AS (SELECT horizon, rate, corr(rx, ry) AS s FROM (
      SELECT horizon, rate, rank() OVER (PARTITION BY horizon, rate ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY horizon, rate, round(x, 9)) - 1) / 2e0 AS rx,
             rank() OVER (PARTITION BY horizon, rate ORDER BY target) + (count(*) OVER (PARTITION BY horizon, rate, target) - 1) / 2e0 AS ry
      FROM (SELECT m.horizon, g.rate, m.target, coalesce(sum(s.sentiment_compound * {_CW} * exp(-g.rate * (m.date - s.date)))
              / nullif(sum({_CW} * exp(-g.rate * (m.date - s.date))), 0), 0) AS x
            FROM m JOIN {grid} g USING (horizon) LEFT JOIN daily s ON s.symbol = m.symbol AND s.date <= m.date
            WHERE m.target IS NOT NULL GROUP BY m.symbol, m.date, m.horizon, g.rate, m.target)) GROUP BY horizon, rate)"""


_COARSE = ", ".join(f"({h}, {r!r})" for h, rates in decay.rate_grid().items() for r in rates)
_BOUNDS = ", ".join(f"({h}, {lo!r}, {hi!r})" for h, (lo, hi) in decay.RATE_BOUNDS.items())


@query(
    "decay_rate_search",
    f"""WITH {CTE['targets']}, {CTE['daily']}, {_DATES}, coarse(horizon, rate) AS (VALUES {_COARSE}), bounds(horizon, lo, hi) AS (VALUES {_BOUNDS}),
    m AS (SELECT t.symbol, t.date, horizon, CASE horizon WHEN 5 THEN target_5d WHEN 22 THEN target_22d ELSE target_90d END AS target
          FROM targets t, cuts, (VALUES (5), (22), (90)) h(horizon) WHERE t.date <= train_end),
    {_rate_scores('coarse', 'first_scores')},
    finer AS (SELECT DISTINCT horizon, round(least(hi, greatest(lo, rate + (hi::DOUBLE - lo::DOUBLE) / 5 * k / 3)), 6) AS rate
              FROM (SELECT horizon, max_by(rate::DOUBLE, abs(s)) AS rate FROM first_scores GROUP BY horizon) JOIN bounds USING (horizon), range(-2, 3) r(k)),
    {_rate_scores('finer', 'last_scores')}
    SELECT CAST(horizon AS INTEGER) AS horizon, {rnd('max_by(rate, abs(s))')} AS rate FROM last_scores GROUP BY horizon""",
)
def _(spark, sf):
    """Best rate per horizon on training rows after refining the grid, as rows."""
    panel = splits.temporal_split(ind.horizon_returns(bars(spark, sf))).filter(F.col("split") == "train")
    best = decay.best_rates(panel, daily(spark, sf))
    return spark.createDataFrame(sorted(best.items()), "horizon int, rate double")


_SEQ = f"WITH {CTE['daily']}, seq AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM daily)"


@query(
    "recursive_decay",
    f"{_SEQ} SELECT a.symbol, a.date, "
    + ", ".join(
        rnd(f"sum(b.sentiment_compound * exp(-{math.log(2.0) / h!r} * (a.k - b.k)))") + f" AS sentiment_decay_{h}d"
        for h in decay.HALF_LIVES
    )
    + " FROM seq a JOIN seq b ON a.symbol = b.symbol AND b.k <= a.k GROUP BY a.symbol, a.date",
)
def _(spark, sf):
    d = decay.recursive_decay(daily(spark, sf), "sentiment_compound")
    return pick(d, KEY, [f"sentiment_decay_{h}d" for h in decay.HALF_LIVES])


@query(
    "volatility_adjusted_decay",
    f"""WITH {CTE['daily']}, f AS (SELECT *, 4e-1 + 5e-1 * (1 - (confidence - min(confidence) OVER p) / nullif(max(confidence) OVER p - min(confidence) OVER p, 0)) AS rho
          FROM daily WINDOW p AS (PARTITION BY symbol)),
    c AS (SELECT *, sum(-ln(rho)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS u FROM f)
    SELECT a.symbol, a.date, {rnd('sum(b.sentiment_compound * exp(b.u - a.u))')} AS sentiment_vol_adjusted
    FROM c a JOIN c b ON a.symbol = b.symbol AND b.date <= a.date GROUP BY a.symbol, a.date""",
)
def _(spark, sf):
    return pick(decay.volatility_adjusted_decay(daily(spark, sf), "sentiment_compound", "confidence"), KEY, ["sentiment_vol_adjusted"])


def _mean(n: int) -> str:
    return f"CASE WHEN k >= {n} THEN avg(sentiment_compound) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"


@query(
    "momentum_means",
    f"{_SEQ} SELECT symbol, date, {rnd(_mean(3))} AS sentiment_momentum_3d, {rnd(_mean(10))} AS sentiment_momentum_10d,"
    f" {rnd('sentiment_compound - ' + _mean(20))} AS sentiment_mean_reversion FROM seq",
)
def _(spark, sf):
    d = decay.momentum_means(daily(spark, sf), "sentiment_compound")
    return pick(d, KEY, ["sentiment_momentum_3d", "sentiment_momentum_10d", "sentiment_mean_reversion"])


# ---- flagship ----


@query(
    "market_news_summary",
    f"""WITH {CTE['returns']}, {CTE['daily']},
    states AS (SELECT m.symbol, m.date, {_decayed('s.sentiment_compound', 0.1)} AS mood {_PAIRS}),
    panel AS (SELECT r.symbol, r.date, r.returns, CASE WHEN rn >= 21 THEN stddev_samp(returns) OVER (PARTITION BY r.symbol ORDER BY r.date
                ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol, states.mood,
                lag(states.mood) OVER (PARTITION BY r.symbol ORDER BY r.date) AS yhat
              FROM rets r JOIN states USING (symbol, date))
    SELECT symbol, count(*) AS rows, {rnd('avg(returns)')} AS mean_return, {rnd('avg(vol)')} AS mean_volatility, {rnd('avg(mood)')} AS mean_sentiment,
           {rnd('sqrt(252e0) * (avg(returns) - 2e-2 / 252) / nullif(stddev_pop(returns), 0)')} AS sharpe_ratio,
           {rnd('coalesce(avg(CASE WHEN abs(returns) > 5e-4 THEN CAST(sign(returns) = sign(yhat) AS DOUBLE) END), 5e-1)')} AS directional_accuracy
    FROM panel GROUP BY symbol""",
)
def _(spark, sf):
    s = market_news.market_news_summary(bars(spark, sf), daily(spark, sf))
    return pick(
        s, ["symbol", "rows"], ["mean_return", "mean_volatility", "mean_sentiment", "sharpe_ratio", "directional_accuracy"]
    )
