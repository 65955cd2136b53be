"""Splits, imputation, clipping, scaling, selection and sequence queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tapeloom.operators import indicators as ind, neighbours, prepare, quality, registry, selection, sequences, splits, summary
from tapeloom.session import durable, stage_path
from tapeloom.sources import files, standardize

from .base import CTE, bars, daily, pick, query, rnd

KEY = ["symbol", "date"]
FEATURES = ["close", "volume", "returns", "sma_20", "volatility_20d"]
_DATES = """ordered AS (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)),
cuts AS (SELECT max(date) FILTER (r <= n * 70 // 100) AS train_end, max(date) FILTER (r <= n * 90 // 100) AS val_end FROM ordered)"""
_W20 = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
CTE["panel"] = CTE["returns"] + f""", {_DATES},
panel AS (SELECT symbol, date, close, CAST(volume AS DOUBLE) AS volume, returns,
                 CASE WHEN rn >= 20 THEN avg(close) {_W20} END AS sma_20, CASE WHEN rn >= 21 THEN stddev_samp(returns) {_W20} END AS volatility_20d,
                 close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY date) - 1 AS target_5,
                 CASE WHEN date <= train_end THEN 'train' WHEN date <= val_end THEN 'val' ELSE 'test' END AS split
          FROM rets, cuts)"""


def panel(spark, sf):
    df = ind.simple_averages(ind.volatility(bars(spark, sf)), [20])
    df = ind.horizon_returns(df, [5])
    df = df.select(*KEY, *[F.col(c).cast("double").alias(c) for c in FEATURES], "target_5")
    return splits.temporal_split(df)


def once(cte: str, *names: str) -> str:
    """The CTEs with the named ones computed a single time, whoever reads them."""
    for name in names:
        cte = cte.replace(f"{name} AS (", f"{name} AS MATERIALIZED (", 1)
    return cte


def unpivoted(made: dict[str, str], source: str, *names: str) -> str:
    """One SQL row per feature from per-feature expressions."""
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, " + ", ".join(f"{e} AS {n}" for n, e in zip(names, [x] if isinstance(x, str) else x)) + f" FROM {source}"
        for f, x in made.items()
    )


# ---- splits ----


@query("temporal_split", f"WITH {CTE['panel']} SELECT symbol, date, split FROM panel")
def _(spark, sf):
    return splits.temporal_split(bars(spark, sf)).select(*KEY, "split")


@query("even_split", f"""WITH {CTE['panel']}, c2 AS (SELECT max(date) FILTER (r <= n * 60 // 100) AS a, max(date) FILTER (r <= n * 80 // 100) AS b FROM ordered)
    SELECT symbol, date, CASE WHEN date <= a THEN 'train' WHEN date <= b THEN 'val' ELSE 'test' END AS split FROM bars, c2""")
def _(spark, sf):
    return splits.temporal_split(bars(spark, sf), 60, 80).select(*KEY, "split")


@query("fixed_date_split", f"WITH {CTE['bars']} SELECT symbol, date, CASE WHEN date < DATE '1999-07-01' THEN 'train' ELSE 'val' END AS split FROM bars")
def _(spark, sf):
    return splits.split_at_date(bars(spark, sf), "1999-07-01").select(*KEY, "split")


@query("fallback_split", f"""WITH {CTE['panel']}, c2 AS (SELECT max(date) FILTER (r <= n * 80 // 100) AS a FROM ordered)
    SELECT symbol, date, CASE WHEN date <= a THEN 'train' ELSE 'val' END AS split FROM bars, c2""")
def _(spark, sf):
    return splits.split_at_date(bars(spark, sf), None).select(*KEY, "split")


@query("first_validation_split", f"""WITH {CTE['panel']}, v AS (SELECT min(date) AS a FROM panel WHERE split = 'val')
    SELECT symbol, date, CASE WHEN date < a THEN 'train' ELSE 'val' END AS split FROM panel, v""")
def _(spark, sf):
    """Cut at the first validation date of an earlier split."""
    b = splits.temporal_split(bars(spark, sf))
    return splits.split_at_first(b.drop("split"), b.filter(F.col("split") == "val")).select(*KEY, "split")


@query(
    "leakage_report",
    f"""WITH {CTE['panel']} SELECT count(DISTINCT split) = 3 AS all_present,
    max(date) FILTER (split = 'train') < min(date) FILTER (split = 'val') AND max(date) FILTER (split = 'val') < min(date) FILTER (split = 'test') AS ordered,
    count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows, count(*) FILTER (split = 'test') AS test_rows FROM panel""",
)
def _(spark, sf):
    return splits.leakage_report(splits.temporal_split(bars(spark, sf)))


@query("written_splits", f"WITH {CTE['panel']} SELECT split, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, max(CAST(close AS FLOAT)) AS highest, 'float' AS kind FROM panel GROUP BY split")
def _(spark, sf):
    """The panel written partitioned by split and read back."""
    path = stage_path(spark, "splits")
    files.write_splits(standardize.narrow_floats(splits.require_no_leakage(splits.temporal_split(bars(spark, sf)))), path)
    back = files.read_table(spark, path)
    highest = back.groupBy("split").agg(F.max("close").alias("highest"), F.max(F.typeof("close")).alias("kind"))
    return splits.split_bounds(back).join(highest, "split")


# ---- null handling ----

CTE["holes"] = CTE["panel"] + """,
holes AS (SELECT symbol, date, split, CASE WHEN symbol < 'S0090' THEN returns END AS returns, sma_20, volatility_20d FROM panel)"""
_HOLED = ["returns", "sma_20", "volatility_20d"]


def holes(spark, sf):
    return panel(spark, sf).select(*KEY, "split", F.when(F.col("symbol") < "S0090", F.col("returns")).alias("returns"), "sma_20", "volatility_20d")


@query(
    "imputed_panel",
    f"""WITH {CTE['holes']}, own AS (SELECT symbol, {', '.join(f"quantile_cont({f}, 5e-1) AS m_{f}" for f in _HOLED)} FROM holes WHERE split = 'train' GROUP BY symbol),
    everyone AS (SELECT {', '.join(f"quantile_cont({f}, 5e-1) AS a_{f}" for f in _HOLED)} FROM holes WHERE split = 'train')
    SELECT symbol, date, """
    + ", ".join(
        rnd(f"coalesce(last_value({f} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), m_{f}, a_{f}, 0)", 4) + f" AS {f}"
        for f in _HOLED
    )
    + " FROM holes LEFT JOIN own USING (symbol), everyone",
)
def _(spark, sf):
    return pick(prepare.impute(holes(spark, sf), _HOLED), KEY, _HOLED, 4)


def _fitted_sql(value: str) -> str:
    """One row of fitted numbers beside the rows they fill."""
    fitted = ", ".join(f"{value.format(f=f)} AS v_{f}" for f in _HOLED)
    filled = ", ".join(rnd(f"coalesce({f}, v_{f})", 4) + f" AS {f}" for f in _HOLED)
    return f"WITH {once(CTE['holes'], 'panel', 'holes')}, fitted AS MATERIALIZED (SELECT {fitted} FROM holes WHERE split = 'train') SELECT symbol, date, {filled} FROM holes, fitted"


@query(
    "median_imputed",
    _fitted_sql("quantile_cont({f}, 5e-1)"),
)
def _(spark, sf):
    return pick(prepare.impute_simple(holes(spark, sf), _HOLED), KEY, _HOLED, 4)


@query(
    "mean_imputed",
    _fitted_sql("avg({f})"),
)
def _(spark, sf):
    return pick(prepare.impute_simple(holes(spark, sf), _HOLED, "mean"), KEY, _HOLED, 4)


@query("null_columns_dropped", f"WITH {CTE['panel']} SELECT symbol, date, {rnd('coalesce(returns, 0)')} AS returns FROM panel")
def _(spark, sf):
    """Mostly-NULL columns leave, the rest is filled with 0."""
    p = panel(spark, sf).select(*KEY, "returns", F.when(F.col("volume") <= 5, F.col("close")).alias("mostly_null"), F.lit(None).cast("double").alias("empty"))
    kept = prepare.drop_null_columns(prepare.drop_empty_columns(p, ["returns", "mostly_null", "empty"]), ["returns", "mostly_null"])
    return pick(kept, KEY, [c for c in kept.columns if c not in KEY])


@query("constant_columns_dropped", f"WITH {CTE['panel']} SELECT symbol, date, {rnd('returns')} AS returns FROM panel")
def _(spark, sf):
    p = panel(spark, sf).select(*KEY, "returns", F.lit(3.5).alias("constant"))
    kept = prepare.drop_constant_columns(p, ["returns", "constant"])
    return pick(kept, KEY, [c for c in kept.columns if c not in KEY])


@query("training_rows", f"WITH {CTE['panel']} SELECT symbol, date, {rnd('coalesce(returns, 0)')} AS returns, {rnd('target_5')} AS target_5 FROM panel WHERE target_5 IS NOT NULL")
def _(spark, sf):
    return pick(prepare.ready_for_training(panel(spark, sf), ["returns"], "target_5"), KEY, ["returns", "target_5"])


# ---- clipping and scaling ----

_CLIPPED = ["close", "returns", "volume"]


def _clip_sql(low: str, high: str) -> str:
    return (
        f"WITH {once(CTE['panel'], 'panel')}, b AS MATERIALIZED (SELECT "
        + ", ".join(f"{low.format(f=f)} AS lo_{f}, {high.format(f=f)} AS hi_{f}" for f in _CLIPPED)
        + " FROM panel WHERE split = 'train') SELECT symbol, date, "
        + ", ".join(rnd(f"CASE WHEN {f} IS NOT NULL THEN least(greatest({f}, lo_{f}), hi_{f}) END", 5) + f" AS {f}" for f in _CLIPPED)
        + " FROM panel, b"
    )


_Q1, _Q3 = "quantile_cont({f}, 25e-2)", "quantile_cont({f}, 75e-2)"


@query("clipped_iqr", _clip_sql(f"{_Q1} - 15e-1 * ({_Q3} - {_Q1})", f"{_Q3} + 15e-1 * ({_Q3} - {_Q1})").replace(", 5)", ", 8)"))
def _(spark, sf):
    return pick(prepare.clip_outliers(panel(spark, sf), _CLIPPED), KEY, _CLIPPED, 8)


@query("clipped_zscore", _clip_sql("avg({f}) - 3 * stddev_samp({f})", "avg({f}) + 3 * stddev_samp({f})").replace(", 5)", ", 8)"))
def _(spark, sf):
    return pick(prepare.clip_outliers(panel(spark, sf), _CLIPPED, "zscore"), KEY, _CLIPPED, 8)


@query("clipped_percentile", _clip_sql("quantile_cont({f}, 1e-2)", "quantile_cont({f}, 99e-2)").replace(", 5)", ", 8)"))
def _(spark, sf):
    return pick(prepare.clip_outliers(panel(spark, sf), _CLIPPED, "percentile"), KEY, _CLIPPED, 8)


def _scale_sql(shift: str, divisor: str) -> str:
    return (
        f"WITH {once(CTE['panel'], 'panel')}, b AS MATERIALIZED (SELECT "
        + ", ".join(f"{shift.format(f=f)} AS s_{f}, coalesce(nullif({divisor.format(f=f)}, 0), 1) AS d_{f}" for f in _CLIPPED)
        + " FROM panel WHERE split = 'train') SELECT symbol, date, "
        + ", ".join(rnd(f"({f} - s_{f}) / d_{f}") + f" AS {f}" for f in _CLIPPED) + " FROM panel, b"
    )


@query("scaled_robust", _scale_sql("quantile_cont({f}, 5e-1)", f"{_Q3} - {_Q1}"))
def _(spark, sf):
    return pick(prepare.scale_features(panel(spark, sf), _CLIPPED), KEY, _CLIPPED)


@query("scaled_standard", _scale_sql("avg({f})", "stddev_pop({f})"))
def _(spark, sf):
    return pick(prepare.scale_features(panel(spark, sf), _CLIPPED, "standard"), KEY, _CLIPPED)


@query("scaled_minmax", _scale_sql("min({f})", "max({f}) - min({f})"))
def _(spark, sf):
    return pick(prepare.scale_features(panel(spark, sf), _CLIPPED, "minmax"), KEY, _CLIPPED)


@query("scaled_zscore", _scale_sql("avg({f})", "stddev_samp({f})"))
def _(spark, sf):
    return pick(prepare.scale_features(panel(spark, sf), _CLIPPED, "zscore"), KEY, _CLIPPED)


@query("unscaled_predictions", f"WITH {CTE['panel']} SELECT symbol, date, {rnd('returns')} AS prediction FROM panel")
def _(spark, sf):
    """A scaled column taken as prediction and brought back to its units."""
    p = panel(spark, sf)
    scales = prepare.fit_scales(p, ["returns"], "standard")
    scaled = prepare.apply_scales(p, scales).withColumnRenamed("returns", "prediction")
    return pick(prepare.undo_scales(scaled, scales, {"prediction": "returns"}), KEY, ["prediction"])


# ---- scores and selection ----


@query(
    "correlation_scores",
    f"WITH {CTE['panel']}, t AS (SELECT * FROM panel WHERE split = 'train') " + unpivoted({f: rnd(f"abs(corr({f}, target_5))") for f in FEATURES}, "t", "score"),
)
def _(spark, sf):
    return pick(selection.correlation_scores(panel(spark, sf), FEATURES, "target_5"), ["feature"], ["score"])


@query(
    "f_scores",
    f"WITH {CTE['panel']}, t AS (SELECT * FROM panel WHERE split = 'train') "
    + unpivoted(
        {f: rnd(f"pow(corr({f}, target_5), 2) / (1 - pow(corr({f}, target_5), 2)) * (count(*) FILTER ({f} IS NOT NULL AND target_5 IS NOT NULL) - 2)", 3) for f in FEATURES},
        "t", "score",
    ),
)
def _(spark, sf):
    return pick(selection.f_scores(panel(spark, sf), FEATURES, "target_5"), ["feature"], ["score"], 3)


_MI = FEATURES


def _bin(c: str) -> str:
    return " + ".join(f"CAST({c} > (SELECT quantile_cont({c}, {i / 10!r}) FROM t) AS INT)" for i in range(1, 10))


@query(
    "mutual_information",
    f"""WITH {CTE['panel']}, t AS (SELECT * FROM panel WHERE split = 'train' AND target_5 IS NOT NULL),
    cells AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {_bin(f)} AS x, {_bin('target_5')} AS y, count(*) AS n FROM t GROUP BY 2, 3" for f in _MI)}),
    m AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS s, sum(n) OVER (PARTITION BY feature, x) AS sx, sum(n) OVER (PARTITION BY feature, y) AS sy FROM cells)
    SELECT feature, {rnd('sum(CAST(n AS DOUBLE) / s * ln(CAST(n AS DOUBLE) * s / (CAST(sx AS DOUBLE) * sy)))')} AS score FROM m GROUP BY feature""",
)
def _(spark, sf):
    return pick(selection.mutual_information(panel(spark, sf), _MI, "target_5"), ["feature"], ["score"])


@query("neighbour_information")
def _(spark, sf):
    """The same by three nearest neighbours, without bins: all features."""
    return pick(neighbours.neighbour_information(panel(spark, sf), FEATURES, "target_5"), ["feature", "n"], ["score"])


@query(
    "top_correlated",
    f"WITH {CTE['panel']}, t AS (SELECT * FROM panel WHERE split = 'train'), s AS ("
    + unpivoted({f: rnd(f"abs(corr({f}, target_5))") for f in FEATURES}, "t", "score") + ") SELECT * FROM s ORDER BY score DESC, feature LIMIT 3",
)
def _(spark, sf):
    scores = selection.correlation_scores(panel(spark, sf), FEATURES, "target_5")
    return pick(selection.top_features(scores, min(3, selection.top_count(len(FEATURES)))), ["feature"], ["score"])


@query("selected_features")
def _(spark, sf):
    """k-best selection: protected features first, the rest by score, as ordered rows."""
    kept = selection.select_k_best(panel(spark, sf), FEATURES, "target_5", True, "correlation", k=4)
    return spark.createDataFrame(list(enumerate(kept)), "position int, feature string")


_PAIRED = ["open", "high", "low", "close", "returns"]
_CORR_CTE = f"""{CTE['returns']}, {_DATES}, t AS (SELECT r.*, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY date) - 1 AS target_5, train_end FROM rets r, cuts),
  train AS (SELECT * FROM t WHERE date <= train_end), complete AS (SELECT * FROM train WHERE returns IS NOT NULL)"""
_PAIRS = [(a, b) for i, a in enumerate(_PAIRED) for b in _PAIRED[i + 1:]]


def correlated(spark, sf):
    return splits.temporal_split(ind.horizon_returns(ind.returns(bars(spark, sf)), [5]))


@query(
    "correlation_pairs",
    f"WITH {_CORR_CTE} " + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {rnd(f'corr({a}, {b})')} AS correlation FROM complete" for a, b in _PAIRS),
)
def _(spark, sf):
    pairs = selection.correlation_pairs(prepare.train_rows(correlated(spark, sf)), _PAIRED)
    return pick(pairs, ["left", "right"], ["correlation"])


@query(
    "near_identical_features",
    f"WITH {_CORR_CTE}, pairs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS c FROM complete" for a, b in _PAIRS)
    + f") SELECT \"left\", \"right\", {rnd('c')} AS correlation FROM pairs WHERE abs(c) > 8e-1",
)
def _(spark, sf):
    """Feature pairs that say nearly the same; daily prices of few trades do."""
    pairs = selection.correlation_pairs(prepare.train_rows(correlated(spark, sf)), _PAIRED)
    return pick(selection.near_identical(pairs, 0.8), ["left", "right"], ["correlation"])


@query(
    "pairwise_correlations",
    f"WITH {CTE['panel']} " + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", 'target_5' AS \"right\", {rnd(f'corr({a}, target_5)')} AS correlation FROM panel" for a in FEATURES),
)
def _(spark, sf):
    return pick(selection.pairwise_correlations(panel(spark, sf), [(f, "target_5") for f in FEATURES]), ["left", "right"], ["correlation"])




#: A column and its twin, which follows the target more closely; tests cover each branch of the rule.
_TWINS = [("returns", "returns", "returns_up", "returns + target_5 / 10")]


@query(
    "pruned_pairs",
    f"WITH {CTE['panel']}, feats AS (SELECT * FROM panel WHERE split = 'train' AND returns IS NOT NULL AND target_5 IS NOT NULL) "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS "left", '{b}' AS "right", {rnd(f'corr({x}, {y})')} AS correlation,
        CASE WHEN abs(corr({x}, target_5)) >= abs(corr({y}, target_5)) THEN '{b}' ELSE '{a}' END AS removed FROM feats"""
        for a, x, b, y in _TWINS
    ),
)
def _(spark, sf):
    """Near-duplicates are found and each pair loses the feature further from the target."""
    p = prepare.train_rows(panel(spark, sf)).filter(F.col("returns").isNotNull() & F.col("target_5").isNotNull())
    made = {name: F.expr(e).alias(name) for a, x, b, y in _TWINS for name, e in ((a, x), (b, y))}
    feats = p.select(*made.values(), "volume", "target_5")
    names = [*made, "volume"]
    d = selection.prune_decisions(
        selection.correlation_pairs(feats, names), selection.correlation_scores(feats, names, "target_5"), names, False
    )
    return pick(d, ["left", "right", "removed"], ["correlation"])


@query("pruned_features")
def _(spark, sf):
    """Columns that survive correlation pruning on training rows."""
    names = ["open", "high", "low", "close", "returns", "log_returns"]
    kept = selection.prune_correlated(correlated(spark, sf), names, "target_5", False)
    return spark.createDataFrame([(k,) for k in kept], "feature string")


@query(
    "protected_inventory",
    f"""WITH {CTE['panel']} SELECT "group", found, expected, (SELECT count(*) FROM panel) AS rows FROM (VALUES ('core_technical', 2, 27), ('ohlc_basic', 2, 6),
    ('price_derived', 1, 4), ('sentiment_core', 0, 6), ('time_essential', 0, 6), ('volume_essential', 0, 5)) v("group", found, expected)""",
)
def _(spark, sf):
    """Protected features found and expected per group, beside the size of the panel."""
    p = panel(spark, sf)
    groups = F.explode(F.array(*[
        F.struct(F.lit(g).alias("group"), F.lit(found).alias("found"), F.lit(expected).alias("expected"))
        for g, (found, expected) in sorted(registry.protected_inventory(p.columns).items())
    ]))
    return p.agg(F.count(F.lit(1)).alias("rows")).select("rows", groups.alias("g")).select("rows", "g.*")


@query("ordered_feature_table", f"WITH {CTE['bars']} SELECT symbol, date, CAST(year(date) AS INTEGER) AS year, volume FROM bars")
def _(spark, sf):
    """Columns put in order by role."""
    df = bars(spark, sf).select("volume", F.year("date").alias("year"), "date", "symbol")
    return df.select(*registry.ordered_columns(df.columns))


# ---- sequences, scoring and models ----

_L = 60
_STEPS = ["returns", "close", "volatility_20d"]


def _contents(sequence: str = "sequence"):
    """Per feature of a window: first and last value, and the sum weighted by place, which tells any two orders apart."""

    def of(i: int):
        def value(step):
            return F.coalesce(step[i].cast("double"), F.lit(0.0))

        placed = F.transform(sequence, lambda step, at: value(step) * (at + 1))
        return value(F.get(sequence, F.lit(0))), value(F.element_at(sequence, -1)), F.aggregate(placed, F.lit(0.0), lambda x, y: x + y)

    return {f"{f}_{part}": c for i, f in enumerate(_STEPS) for part, c in zip(("first", "last", "placed"), of(i))}


def _contents_sql(place: str, last: str) -> str:
    return ", ".join(
        f"any_value({x}) FILTER ({place} = 1) AS {f}_first, any_value({x}) FILTER ({place} = {last}) AS {f}_last, sum({x} * ({place})) AS {f}_placed"
        for f in _STEPS for x in [f"CAST(coalesce(b.{f}, 0) AS FLOAT)::DOUBLE"]
    )


_CONTENTS = [f"{f}_{part}" for f in _STEPS for part in ("first", "last", "placed")]
_NUMBERED = f"WITH {CTE['panel']}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k, count(*) OVER (PARTITION BY symbol) AS m FROM panel)"


@query(
    "training_windows",
    f"""{_NUMBERED},
    w AS (SELECT a.symbol, a.date, any_value(a.target_5) AS y, count(b.k) AS steps, min(least({', '.join(f'CAST(b.{f} IS NOT NULL AS INTEGER)' for f in _STEPS)})) AS known,
                 {', '.join(f'list(CAST(b.{f} AS FLOAT)::DOUBLE) AS l_{f}' for f in _STEPS)}, {_contents_sql(f'b.k - a.k + {_L} + 1', str(_L))}
          FROM n a JOIN n b ON a.symbol = b.symbol AND b.k BETWEEN a.k - {_L} AND a.k - 1 GROUP BY a.symbol, a.date)
    SELECT symbol, date, steps, {rnd('CAST(y AS FLOAT)', 4)} AS label, {', '.join(f'{rnd(c, 3)} AS {c}' for c in _CONTENTS)} FROM w
    WHERE steps = {_L} AND known = 1 AND y IS NOT NULL AND abs(y) < 5 AND list_var_pop({' || '.join(f'l_{f}' for f in _STEPS)}) > 1e-8""",
)
def _(spark, sf):
    w = sequences.training_windows(panel(spark, sf), _STEPS, "target_5", _L)
    w = w.withColumns({**_contents(), "steps": F.size("sequence").cast("bigint")})
    return pick(w, [*KEY, "steps"], ["label", *_CONTENTS], 3, {"label": 4})


@query(
    "inference_windows",
    f"""{_NUMBERED}
    SELECT symbol, date, {', '.join(f'{rnd(c, 3)} AS {c}' for c in _CONTENTS)} FROM (
      SELECT a.symbol, a.date, {_contents_sql(f'b.k - a.k + {_L}', str(_L))}
      FROM n a JOIN n b ON a.symbol = b.symbol AND b.k BETWEEN a.k - {_L - 1} AND a.k GROUP BY a.symbol, a.date HAVING count(*) = {_L})""",
)
def _(spark, sf):
    w = sequences.inference_windows(panel(spark, sf), _STEPS, _L)
    return pick(w.withColumns(_contents()), KEY, _CONTENTS, 3)


def _decoder_sql(encoder: int, horizon: int) -> str:
    return f"""{_NUMBERED},
    fit AS (SELECT symbol, avg(target_5) AS target_center, stddev_samp(target_5) AS target_scale FROM panel WHERE split = 'train' GROUP BY symbol),
    d AS (SELECT a.symbol, a.date, count(*) AS decoder_rows, count(b.target_5) AS known_targets, coalesce(sum(CAST((b.target_5 - target_center) / target_scale AS FLOAT)::DOUBLE * (b.k - a.k)), 0) AS decoder_placed
          FROM n a JOIN n b ON a.symbol = b.symbol AND b.k BETWEEN a.k + 1 AND a.k + {horizon} LEFT JOIN fit ON fit.symbol = a.symbol GROUP BY a.symbol, a.date)
    SELECT n.symbol, n.date, least(k, {encoder}) AS encoder_rows, decoder_rows, known_targets, {rnd('target_center')} AS target_center, {rnd('decoder_placed', 2)} AS decoder_placed
    FROM n JOIN d USING (symbol, date) LEFT JOIN fit ON fit.symbol = n.symbol WHERE k >= {encoder} // 3 AND decoder_rows >= 3"""


def _decoders(spark, sf, encoder: int, horizon: int):
    w = sequences.encoder_decoder_windows(panel(spark, sf), ["returns", "volume"], "target_5", encoder, horizon)
    placed = F.transform("decoder", lambda y, at: F.coalesce(y.cast("double"), F.lit(0.0)) * (at + 1))
    w = w.withColumns({
        "encoder_rows": F.size("encoder").cast("bigint"), "decoder_rows": F.size("decoder").cast("bigint"),
        "known_targets": F.size(F.filter("decoder", lambda y: y.isNotNull())).cast("bigint"),
        "decoder_placed": F.aggregate(placed, F.lit(0.0), lambda a, b: a + b),
    })
    return pick(w, [*KEY, "encoder_rows", "decoder_rows", "known_targets"], ["target_center", "decoder_placed"], 6, {"decoder_placed": 2})


@query("encoder_decoder_windows", _decoder_sql(80, 16))
def _(spark, sf):
    """Windows of the forecasting model, unknown targets in their places."""
    return _decoders(spark, sf, 80, 16)


@query("long_encoder_decoder_windows", _decoder_sql(90, 18))
def _(spark, sf):
    """Windows of the enhanced model."""
    return _decoders(spark, sf, 90, 18)


def _load_mean():
    """A stand-in for a loaded network: the mean of the last three steps."""
    return lambda tensor: np.asarray(tensor, dtype=float)[:, -3:, 0].mean(axis=1)


@query(
    "scored_windows",
    f"""WITH {CTE['panel']}, n AS (SELECT symbol, date, CAST(coalesce(returns, 0) AS FLOAT)::DOUBLE AS x, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM panel)
    SELECT symbol, date, {rnd('p', 5)} AS prediction FROM (SELECT symbol, date, k, avg(x) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p FROM n) WHERE k >= {_L}""",
)
def _(spark, sf):
    return pick(sequences.score_windows(sequences.inference_windows(panel(spark, sf), ["returns"], _L), _load_mean), KEY, ["prediction"], 5)


@query("fitted_regressors")
def _(spark, sf):
    """The three distributed regressors fitted on train rows and measured on every split."""
    from tapeloom.operators import metrics

    p = durable(prepare.impute(panel(spark, sf).filter(F.col("target_5").isNotNull()), FEATURES).select(*KEY, *FEATURES, "target_5", "split"))
    out = None
    for kind in sequences.REGRESSORS:
        model = sequences.fit_regressor(prepare.train_rows(p), FEATURES, "target_5", kind)
        scored = sequences.predict(model, p, FEATURES).select(F.lit(kind).alias("model"), "split", F.col("target_5").alias("y"), F.col("prediction").alias("yhat"))
        out = scored if out is None else out.unionByName(scored)
    return metrics.forecast_metrics(out, ["model", "split"])


def _over(n: str) -> str:
    return f"avg(target_5) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n} AND 1 PRECEDING)"


@query(
    "naive_forecasts",
    f"""WITH {CTE['panel']} SELECT symbol, date, {rnd('lag(target_5) OVER (PARTITION BY symbol ORDER BY date)')} AS last_value,
    {rnd(_over('UNBOUNDED PRECEDING'))} AS historical_mean, {rnd(_over('22 PRECEDING'))} AS moving_average_22, {rnd(_over('66 PRECEDING'))} AS moving_average_66 FROM panel""",
)
def _(spark, sf):
    f = sequences.naive_forecasts(panel(spark, sf), "target_5")
    return pick(f, KEY, ["last_value", "historical_mean", "moving_average_22", "moving_average_66"])


@query(
    "preparation_report",
    f"""WITH {CTE['panel']} SELECT 5 AS features, true AS enough_features, 13 AS missing_critical, true AS enough_sentiment, true AS enough_decay,
    {rnd("avg(CAST(split = 'train' AS DOUBLE))")} AS train_share, avg(CAST(split = 'train' AS DOUBLE)) BETWEEN 6e-1 AND 8e-1 AS usual_train_share FROM panel""",
)
def _(spark, sf):
    r = quality.preparation_report(panel(spark, sf), FEATURES, 6, False)
    return pick(r, [c for c in r.columns if c != "train_share"], ["train_share"])


@query("feature_categories", f"WITH {CTE['panel']} SELECT feature, CASE feature WHEN 'volume' THEN 'volume' WHEN 'close' THEN 'price' WHEN 'returns' THEN 'price' ELSE 'technical' END AS category, rows FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS rows FROM panel" for f in FEATURES) + ")")
def _(spark, sf):
    """Category of each feature by name, with its number of known values."""
    counts = summary.feature_statistics(panel(spark, sf), FEATURES)
    label = F.lit("other")
    for f in FEATURES:
        label = F.when(F.col("feature") == f, registry.category(f)).otherwise(label)
    return counts.select("feature", label.alias("category"), F.col("count").alias("rows"))
