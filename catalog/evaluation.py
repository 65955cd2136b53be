"""Folds, intervals and tests: how sure the forecasts of the panel are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tapeloom.functions import chance
from tapeloom.operators import folds, indicators as ind, inference, sequences

from .base import CTE, bars, pick, query, rnd
from .prep import KEY, panel

HORIZONS = [5, 22, 90]

# ---- walk-forward and two-sided folds ----

CTE["dates"] = CTE["numbered"] + """,
dates AS (SELECT date, row_number() OVER (ORDER BY date) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"""


def _roles_sql(horizon: int, walk: bool, tag: str = "") -> str:
    """Roles by comparing positions of dates, fold by fold."""
    runs, first = (6, 1) if walk else (5, 0)
    later = "AND l.p <= f.z" if walk else ""
    return f"""spans{tag} AS (SELECT symbol, b.date, close, d.p, e.p AS q, b.stop FROM (
    SELECT *, lead(date, {horizon}) OVER (PARTITION BY symbol ORDER BY date) AS stop FROM numbered) b JOIN dates d USING (date) JOIN dates e ON e.date = b.stop),
  folds{tag} AS (SELECT (l.p - 1) * {runs} // n + {1 - first} AS fold, min(l.p) AS a, max(q) AS reach, max(l.z) AS z
               FROM spans{tag} JOIN (SELECT p, n, max(p) OVER (PARTITION BY (p - 1) * {runs} // n) AS z FROM dates) l USING (p)
               WHERE (l.p - 1) * {runs} // n >= {first} GROUP BY ALL),
  starts{tag} AS (SELECT (p - 1) * {runs} // n + {1 - first} AS fold, min(p) AS a FROM dates GROUP BY ALL),
  roles{tag} AS (SELECT symbol, l.date, close, l.stop AS label_end, f.fold,
               CASE WHEN l.p BETWEEN s.a AND f.z THEN 'test' WHEN l.p <= reach AND q >= s.a THEN 'purged'
                    WHEN l.p <= reach + 5 AND q >= s.a - 5 THEN 'embargoed' ELSE 'train' END AS role
             FROM spans{tag} l, folds{tag} f JOIN starts{tag} s USING (fold) WHERE true {later})"""


@query("walk_forward_roles", f"WITH {CTE['dates']}, {_roles_sql(22, True)} SELECT symbol, date, CAST(fold AS INTEGER) AS fold, role, label_end FROM roles")
def _(spark, sf):
    """Every row of the panel in every fold, labels over the next 22 rows."""
    return folds.fold_roles(bars(spark, sf).select(*KEY), 22).select(*KEY, "fold", "role", "label_end")


def _summary_sql(walk: bool) -> str:
    one = " UNION ALL ".join(
        f"SELECT {h} AS horizon, fold, role, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, max(label_end) AS last_label FROM roles{h} GROUP BY ALL"
        for h in HORIZONS
    )
    return f"WITH {CTE['dates']}, {', '.join(_roles_sql(h, walk, str(h)) for h in HORIZONS)} SELECT * REPLACE (CAST(fold AS INTEGER) AS fold) FROM ({one})"


def _summaries(spark, sf, walk: bool):
    b = bars(spark, sf).select(*KEY)
    parts = [folds.fold_summary(folds.fold_roles(b, h, walk_forward=walk)).select(F.lit(h).alias("horizon"), "*") for h in HORIZONS]
    return reduce(lambda a, c: a.unionByName(c), parts)


@query("walk_forward_folds", _summary_sql(True))
def _(spark, sf):
    """Rows that train, test or leave each fold, for each horizon of the labels."""
    return _summaries(spark, sf, True)


@query("purged_folds", _summary_sql(False))
def _(spark, sf):
    """The same with training rows on both sides of the test dates."""
    return _summaries(spark, sf, False)


@query("fold_leaks", "SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS fold, CAST(0 AS BIGINT) AS leaks")
def _(spark, sf):
    return folds.fold_leaks(folds.fold_roles(bars(spark, sf).select(*KEY), 22, walk_forward=False))


_LABELLED = "fl AS (SELECT r.*, x.label FROM roles r JOIN (SELECT symbol, date, lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS label FROM bars) x USING (symbol, date))"


@query(
    "walk_forward_scores",
    f"""WITH {CTE['dates']}, {_roles_sql(5, True)}, {_LABELLED},
    own AS (SELECT fold, symbol, avg(label) AS m FROM fl WHERE role = 'train' GROUP BY ALL), everyone AS (SELECT fold, avg(label) AS m FROM fl WHERE role = 'train' GROUP BY ALL),
    scored AS (SELECT fl.fold, label AS y, coalesce(own.m, everyone.m) AS yhat FROM fl LEFT JOIN own USING (fold, symbol) LEFT JOIN everyone ON everyone.fold = fl.fold WHERE role = 'test')
    SELECT CAST(fold AS INTEGER) AS fold, count(*) AS rows, {rnd('sqrt(avg((y - yhat) * (y - yhat)))')} AS rmse, {rnd('avg(abs(y - yhat))')} AS mae,
           {rnd('avg(y - yhat)')} AS residual_mean FROM scored WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY fold""",
)
def _(spark, sf):
    """The mean label of each symbol's training rows, scored on the test rows of each fold."""
    labelled = ind.forward_returns(bars(spark, sf), [5]).select(*KEY, "label_5d")
    scores = folds.fold_mean_scores(folds.fold_roles(labelled, 5), "label_5d")
    return pick(scores, ["fold", "rows"], ["rmse", "mae", "residual_mean"])


# ---- the naive forecasts as competing models ----

MODELS = ["random_walk", "last_value", "historical_mean", "moving_average_22", "moving_average_66"]
_BEFORE = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
CTE["naive"] = CTE["panel"] + f""",
naive AS (SELECT symbol, date, returns AS y1, target_5 AS y5, volatility_20d AS x1, close / sma_20 - 1 AS x2, 0e0 AS random_walk,
  lag(target_5) OVER (PARTITION BY symbol ORDER BY date) AS last_value, avg(target_5) {_BEFORE.format('UNBOUNDED')} AS historical_mean,
  avg(target_5) {_BEFORE.format(22)} AS moving_average_22, avg(target_5) {_BEFORE.format(66)} AS moving_average_66 FROM panel)"""


def naive(spark, sf):
    return sequences.naive_forecasts(panel(spark, sf), "target_5")


# ---- bootstrap ----


def _hash_sql(block: str, replicate: str, seed: int) -> str:
    """Columns h0, h1 ... of a select list; each step uses the one before."""
    word = chance.WORD
    step = lambda x, shift, factor: f"(xor({x}, {x} >> {shift}) * {factor}) & {word}"
    made = [f"({block} * {chance.BLOCK_STEP}) & {word} AS h0", f"{step('h0', 15, chance.REPLICATE_STEP)} AS h1", f"(h1 + {replicate} * {chance.REPLICATE_STEP} + {seed}) & {word} AS h2"]
    made += [f"{step(f'h{i + 2}', shift, factor)} AS h{i + 3}" for i, (shift, factor) in enumerate(chance.STEPS)]
    return ", ".join(made) + ", xor(h5, h5 >> 15) AS h6"


_DRAW = " + ".join(f"CAST(h6 >= {limit} AS INTEGER)" for limit in chance.poisson_limits())
_BLOCK = f"(date_diff('day', DATE '1970-01-01', date) + 25567) // {inference.BLOCK_DAYS}"


def _drawn_sql(blocks: str, keys: str, sums: list[str]) -> str:
    weighted = ", ".join(f"sum({s} * w) AS {s}" for s in sums)
    return f"""(SELECT {keys} r, {weighted} FROM (
      SELECT *, {_hash_sql('block', 'r', inference.SEED)}, {_DRAW} AS w FROM {blocks}, (SELECT unnest(range(0, {inference.REPLICATES})) AS r)) GROUP BY {keys} r)"""


_STATS = "abs_e / n AS mae, sqrt(252) * (ret / n - 2e-2 / 252) / nullif(sqrt(greatest(rr / n - (ret / n) * (ret / n), 0)), 0) AS sharpe_ratio"
_LOW, _HIGH = (
    "CASE level " + " ".join(f"WHEN {v!r}::DOUBLE THEN quantile_cont(value, {(1 + side * v) / 2!r})" for v in inference.LEVELS) + " END" for side in (-1, 1)
)
_SUMS = ["n", "abs_e", "ret", "rr"]


@query(
    "bootstrap_intervals",
    f"""WITH {CTE['naive']},
    long AS ({' UNION ALL '.join(f"SELECT '{m}' AS model, date, y5 AS y, {m} AS yhat FROM naive" for m in MODELS)}),
    blocks AS (SELECT model, {_BLOCK} AS block, CAST(count(*) AS DOUBLE) AS n, sum(abs(y - yhat)) AS abs_e, sum(sign(yhat) * y) AS ret, sum(pow(sign(yhat) * y, 2)) AS rr
               FROM long WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY ALL),
    whole AS (SELECT model, {_STATS} FROM (SELECT model, {', '.join(f'sum({s}) AS {s}' for s in _SUMS)} FROM blocks GROUP BY model)),
    drawn AS (SELECT model, {_STATS} FROM {_drawn_sql('blocks', 'model,', _SUMS)} WHERE n > 0),
    tall AS (SELECT model, unnest(['mae', 'sharpe_ratio']) AS statistic, unnest([mae, sharpe_ratio]) AS value FROM drawn),
    ones AS (SELECT model, unnest(['mae', 'sharpe_ratio']) AS statistic, unnest([mae, sharpe_ratio]) AS value FROM whole),
    limits AS (SELECT model, statistic, level, {_LOW} AS low, {_HIGH} AS high FROM (SELECT *, unnest({list(inference.LEVELS)}::DOUBLE[]) AS level FROM tall) GROUP BY model, statistic, level)
    SELECT model, statistic, level, {rnd('any_value(o.value)')} AS value, {rnd('any_value(low)')} AS low, {rnd('any_value(high)')} AS high
    FROM ones o JOIN limits USING (model, statistic) GROUP BY model, statistic, level""",
)
def _(spark, sf):
    """Limits of error and yearly Sharpe ratio of every naive forecast, dates drawn in blocks, all models alike."""
    f = naive(spark, sf).withColumnRenamed("target_5", "y").unpivot(["date", "y"], MODELS, "model", "yhat")
    return pick(inference.bootstrap_intervals(f, ["model"]), ["model", "statistic", "level"], ["value", "low", "high"])


# ---- Newey-West ----

_LAGS, _T = 5, ["c", "a", "b"]


def _sandwich_sql() -> str:
    """Three-term regressions per symbol, the inverse by cofactors."""
    g = {("c", "c"): "n", ("c", "a"): "sa", ("c", "b"): "sb", ("a", "a"): "saa", ("a", "b"): "sab", ("b", "b"): "sbb"}
    at = lambda i, j: g.get((i, j)) or g[(j, i)]

    def cofactor(i: int, j: int) -> str:
        (r, s), (u, v) = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        sign = "" if (i + j) % 2 == 0 else "-"
        return f"{sign}({at(_T[r], _T[u])} * {at(_T[s], _T[v])} - {at(_T[r], _T[v])} * {at(_T[s], _T[u])})"

    inverse = ", ".join(f"{cofactor(j, i)} / det AS i{i}{j}" for i in range(3) for j in range(3))
    beta = ", ".join(f"i{i}0 * sy + i{i}1 * say + i{i}2 * sby AS b{i}" for i in range(3))
    lagged = ", ".join(f"lag(u{i}, {k}) OVER (PARTITION BY symbol ORDER BY date) AS u{i}_{k}" for i in range(3) for k in range(1, _LAGS + 1))
    middle = ", ".join(
        f"sum(u{i} * u{j})" + "".join(f" + {1 - k / (_LAGS + 1)!r} * coalesce(sum(u{i} * u{j}_{k} + u{j} * u{i}_{k}), 0)" for k in range(1, _LAGS + 1)) + f" AS m{i}{j}"
        for i in range(3) for j in range(3)
    )
    error = lambda t: "sqrt(greatest(" + " + ".join(f"i{t}{i} * m{i}{j} * i{j}{t}" for i in range(3) for j in range(3)) + ", 0))"
    names = ["intercept", "x1", "x2"]
    terms = " UNION ALL ".join(f"SELECT symbol, '{names[t]}' AS term, n, b{t} AS coefficient, {error(t)} AS std_error FROM middles JOIN betas USING (symbol)" for t in range(3))
    return f"""rows AS (SELECT symbol, date, y1 AS y, x1 AS a, x2 AS b FROM naive WHERE y1 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
    sums AS (SELECT symbol, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS saa, sum(a * b) AS sab, sum(b * b) AS sbb,
             sum(y) AS sy, sum(a * y) AS say, sum(b * y) AS sby FROM rows GROUP BY symbol HAVING count(*) > 3),
    dets AS (SELECT *, n * (saa * sbb - sab * sab) - sa * (sa * sbb - sab * sb) + sb * (sa * sab - saa * sb) AS det FROM sums),
    inverses AS (SELECT *, {inverse} FROM dets), betas AS (SELECT *, {beta} FROM inverses),
    errors AS (SELECT symbol, date, e AS u0, a * e AS u1, b * e AS u2 FROM (SELECT symbol, date, a, b, y - b0 - b1 * a - b2 * b AS e FROM rows JOIN betas USING (symbol))),
    lagged AS (SELECT *, {lagged} FROM errors), middles AS (SELECT symbol, {middle} FROM lagged GROUP BY symbol), terms AS ({terms})"""


@query(
    "newey_west",
    f"WITH {CTE['naive']}, {_sandwich_sql()} SELECT symbol, term, n, {rnd('coefficient', 5)} AS coefficient, {rnd('std_error', 5)} AS std_error, {rnd('coefficient / std_error', 4)} AS t_value FROM terms",
)
def _(spark, sf):
    """Daily returns on volatility and distance from the 20-row mean, errors robust over 5 rows."""
    p = panel(spark, sf).withColumns({"x1": F.col("volatility_20d"), "x2": F.col("close") / F.col("sma_20") - 1})
    made = inference.newey_west(p, "returns", ["x1", "x2"], _LAGS)
    return pick(made.filter("n > 3"), ["symbol", "term", "n"], ["coefficient", "std_error", "t_value"], 5, {"t_value": 4})


# ---- Diebold-Mariano ----

_TOP, _BOTTOM = chance.NORMAL_TOP, chance.NORMAL_BOTTOM


def _two_sided_sql(z: str) -> str:
    horner = lambda terms: reduce(lambda a, b: f"({a} * abs({z}) + {b!r})", terms[1:], repr(terms[0]))
    return f"least(2 * exp(-({z}) * ({z}) / 2) * {horner(_TOP)} / {horner(_BOTTOM)}, 1)"


def _pairs_sql(horizon: int) -> str:
    pairs = [(a, b) for i, a in enumerate(MODELS) for b in MODELS[i + 1:]]
    daily = " UNION ALL ".join(
        f"SELECT date, '{a}' AS model_a, '{b}' AS model_b, avg(pow(y5 - {a}, 2) - pow(y5 - {b}, 2)) AS d FROM naive WHERE y5 IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY date"
        for a, b in pairs
    )
    lags = range(1, horizon)
    w = "OVER (PARTITION BY model_a, model_b ORDER BY date)"
    return f"""daily AS ({daily}), centred AS (SELECT *, d - avg(d) OVER (PARTITION BY model_a, model_b) AS c FROM daily),
    lagged AS (SELECT *{''.join(f', lag(c, {j}) {w} AS c{j}' for j in lags)} FROM centred),
    sums AS (SELECT model_a, model_b, count(*) AS n, avg(d) AS mean_difference, avg(c * c) AS g0{''.join(f', coalesce(sum(c * c{j}), 0) / count(*) AS g{j}' for j in lags)}
             FROM lagged GROUP BY ALL),
    variances AS (SELECT *, g0{''.join(f' + 2 * g{j}' for j in lags)} AS flat, g0{''.join(f' + 2 * {1 - j / horizon!r} * g{j}' for j in lags)} AS falling FROM sums),
    tested AS (SELECT *, mean_difference / sqrt(CASE WHEN flat > 1e-12 * g0 THEN flat ELSE falling END / n) * sqrt((n + 1 - {2 * horizon} + {horizon * (horizon - 1)} / n) / n) AS statistic FROM variances)"""


@query(
    "diebold_mariano",
    f"WITH {CTE['naive']}, {_pairs_sql(5)} SELECT model_a, model_b, n, {rnd('mean_difference')} AS mean_difference, {rnd('statistic', 4)} AS statistic, {rnd(_two_sided_sql('statistic'))} AS p_value FROM tested",
)
def _(spark, sf):
    """Every pair of naive forecasts of the five-row return; their errors overlap over five dates."""
    made = inference.diebold_mariano(naive(spark, sf), "target_5", MODELS, horizon=5)
    return pick(made, ["model_a", "model_b", "n"], ["mean_difference", "statistic", "p_value"], 6, {"statistic": 4})


# ---- reality check ----

_RIVALS = [m for m in MODELS if m != "historical_mean"]
_G = [f"f{i}" for i in range(len(_RIVALS))]


@query(
    "reality_check",
    f"""WITH {CTE['naive']},
    daily AS (SELECT date, {', '.join(f'avg(pow(y5 - historical_mean, 2) - pow(y5 - {m}, 2)) AS {g}' for m, g in zip(_RIVALS, _G))} FROM naive
              WHERE y5 IS NOT NULL AND {' AND '.join(f'{m} IS NOT NULL' for m in MODELS)} GROUP BY date),
    blocks AS (SELECT {_BLOCK} AS block, CAST(count(*) AS DOUBLE) AS n, {', '.join(f'sum({g}) AS {g}' for g in _G)} FROM daily GROUP BY block),
    own AS (SELECT sum(n) AS n, {', '.join(f'sum({g}) / sum(n) AS {g}' for g in _G)} FROM blocks),
    drawn AS (SELECT {', '.join(f'd.{g} / d.n - o.{g} AS {g}' for g in _G)} FROM {_drawn_sql('blocks', '', ['n', *_G])} d, own o WHERE d.n > 0),
    most AS (SELECT *, greatest({', '.join(_G)}) AS top FROM drawn),
    tests AS ({' UNION ALL '.join(f"SELECT '{m}' AS model, CAST(any_value(o.n) AS BIGINT) AS n, any_value(o.{g}) AS gain, any_value(o.{g}) * sqrt(any_value(o.n)) AS statistic, avg(CAST(t.{g} >= o.{g} AS DOUBLE)) AS p_value, avg(CAST(top >= o.{g} AS DOUBLE)) AS p_reality FROM most t, own o" for m, g in zip(_RIVALS, _G))}),
    placed AS (SELECT *, least(p_value * ({len(_RIVALS)} + 1 - row_number() OVER (ORDER BY p_value, model)), 1) AS raised FROM tests),
    held AS (SELECT *, max(raised) OVER (ORDER BY p_value, model ROWS UNBOUNDED PRECEDING) AS p_holm FROM placed)
    SELECT model, n, {rnd('gain', 8)} AS gain, {rnd('statistic')} AS statistic, {rnd('p_value')} AS p_value, {rnd('p_reality')} AS p_reality, {rnd('p_holm')} AS p_holm, p_holm <= 5e-2 AS rejected FROM held""",
)
def _(spark, sf):
    """Whether any other naive forecast beats the running mean by more than luck."""
    made = inference.reality_check(naive(spark, sf), "target_5", "historical_mean", _RIVALS)
    out = pick(made.select("*", F.col("rejected").alias("__r")), ["model", "n", "__r"], ["gain", "statistic", "p_value", "p_reality", "p_holm"], 6, {"gain": 8})
    return out.withColumnRenamed("__r", "rejected")
