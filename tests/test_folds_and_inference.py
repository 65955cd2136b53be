"""Purged folds, bootstrap, robust errors and forecast tests against plain versions."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.chance import normal_tail, poisson_limits, poisson_weight, with_counter_hash
from tapeloom.operators import folds, inference

START = date(2020, 1, 1)


def days_of(n, gap=1):
    return [START + timedelta(days=i * gap) for i in range(n)]


def panel_of(spark, symbols, dates, seed=0, holes=0.0):
    rng = np.random.default_rng(seed)
    rows = [(s, d, float(rng.normal())) for s in symbols for d in dates if rng.random() >= holes]
    return spark.createDataFrame(rows, "symbol string, date date, v double"), rows


# ---- folds ----


def plain_roles(rows, horizon, runs, embargo, walk):
    dates = sorted({d for _, d, _ in rows})
    pos, n = {d: i for i, d in enumerate(dates)}, len(dates)
    total = runs + walk
    spans = []
    for s in {s for s, _, _ in rows}:
        own = sorted(d for t, d, _ in rows if t == s)
        spans += [(s, d, own[i + horizon]) for i, d in enumerate(own) if i + horizon < len(own)]
    out = set()
    for run in range(int(walk), total):
        test = [p for p in range(n) if p * total // n == run]
        ends = [pos[e] for _, d, e in spans if pos[d] in set(test)]
        if not ends:
            continue
        reach = max(ends)
        for s, d, e in spans:
            p, q = pos[d], pos[e]
            if p in range(test[0], test[-1] + 1):
                role = "test"
            elif walk and p > test[-1]:
                continue
            elif p <= reach and q >= test[0]:
                role = "purged"
            elif p <= reach + embargo and q >= test[0] - embargo:
                role = "embargoed"
            else:
                role = "train"
            out.add((s, d, run + (not walk), role))
    return out


@pytest.mark.parametrize("walk", [True, False])
@pytest.mark.parametrize("horizon, embargo, n, holes", [(5, 5, 120, 0.0), (22, 5, 200, 0.2), (1, 0, 37, 0.0), (90, 5, 140, 0.1)])
def test_roles(spark, walk, horizon, embargo, n, holes):
    df, rows = panel_of(spark, ["A", "B", "C"], days_of(n, 3), horizon, holes)
    made = folds.fold_roles(df, horizon, 5, embargo, walk)
    assert {(r.symbol, r.date, r.fold, r.role) for r in made.collect()} == plain_roles(rows, horizon, 5, embargo, walk)
    assert made.count() == len({(r.symbol, r.date, r.fold) for r in made.collect()})
    assert all(r.leaks == 0 for r in folds.fold_leaks(made).collect())


def test_no_training_label_reaches_the_embargo(spark):
    df, _ = panel_of(spark, ["A", "B"], days_of(300))
    for r in folds.fold_roles(df, 22).groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("label_end"))).alias("train"), F.min(F.when(F.col("role") == "test", F.col("date"))).alias("test")
    ).collect():
        assert (r.test - r.train).days > folds.EMBARGO


def test_folds_of_odd_panels(spark):
    empty = spark.createDataFrame([], "symbol string, date date, v double")
    assert folds.fold_roles(empty, 5).count() == 0 and folds.fold_bounds(folds.label_spans(empty, 5)) == []
    short, _ = panel_of(spark, ["A"], days_of(5))
    assert folds.fold_roles(short, 5).count() == 0  # no row has a label
    few, rows = panel_of(spark, ["A"], days_of(4))
    assert {(r.symbol, r.date, r.fold, r.role) for r in folds.fold_roles(few, 1).collect()} == plain_roles(rows, 1, 5, 5, True)


def test_mean_is_fitted_on_training_rows_alone(spark):
    df, rows = panel_of(spark, ["A", "B"], days_of(120), 3)
    rows += [("NEW", START + timedelta(days=i), 2.0) for i in range(100, 120)]  # without training rows in any fold but the last
    df = spark.createDataFrame(rows, "symbol string, date date, v double")
    roles = plain_roles(rows, 5, 5, 5, True)
    value = {(s, d): v for s, d, v in rows}
    for r in folds.fold_mean_scores(folds.fold_roles(df, 5), "v").collect():
        train = [(s, value[s, d]) for s, d, k, role in roles if k == r.fold and role == "train"]
        everyone = np.mean([v for _, v in train])
        fit = {s: np.mean([v for t, v in train if t == s] or [everyone]) for s in ("A", "B", "NEW")}
        errors = [abs(value[s, d] - fit[s]) for s, d, k, role in roles if k == r.fold and role == "test"]
        assert r.mae == pytest.approx(np.mean(errors)) and r.rows == len(errors)


# ---- random numbers and tails ----


def plain_hash(block, replicate, seed=0):
    word, x = 0xFFFFFFFF, (block * 0x1B873593) & 0xFFFFFFFF
    x = ((x ^ x >> 15) * 0x27D4EB2F) & word
    x = (x + replicate * 0x27D4EB2F + seed) & word
    for shift, factor in [(16, 0x7FEB352D), (15, 0x31848BAB), (16, 0x7FEB352D)]:
        x = ((x ^ x >> shift) * factor) & word
    return x ^ x >> 15


def test_counter_hash(spark):
    df = spark.range(200).withColumnRenamed("id", "b").crossJoin(spark.range(500).withColumnRenamed("id", "r"))
    df = with_counter_hash(df, "h", F.col("b"), F.col("r"), 7)
    pdf = df.withColumn("w", poisson_weight(F.col("h"))).toPandas()
    assert all(plain_hash(b, r, 7) == h for b, r, h in pdf[["b", "r", "h"]].head(3000).itertuples(index=False))
    u = pdf["h"].to_numpy() / 2**32
    assert abs(u.mean() - 0.5) < 0.003 and abs(u.var() - 1 / 12) < 0.001 and pdf["h"].nunique() > 99_900
    w = pdf.pivot(index="b", columns="r", values="w").to_numpy()
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    for a, b in [(w[1:], w[:-1]), (w[:, 1:], w[:, :-1]), (w[2:], w[:-2]), (w[:, 8:], w[:, :-8])]:  # neighbours hang together in no direction
        assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.012
    assert abs(np.corrcoef(w)[np.triu_indices(200, 1)]).mean() < 0.045


def test_poisson_limits():
    limits, below = poisson_limits(), 0.0
    for k, limit in enumerate(limits):
        below += math.exp(-1) / math.factorial(k)
        assert abs(limit / 2**32 - below) < 1e-9


def test_normal_tail(spark):
    z = [-40.0, -8.0, -3.3, -1.0, 0.0, 1e-9, 0.3, 1.96, 4.0, 7.0710, 7.0711, 7.08, 9.0, 20.0, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(normal_tail(F.col("z"))).collect()]
    assert got[-1] is None
    for x, p in zip(z[:-1], got):
        assert p == pytest.approx(math.erfc(x / math.sqrt(2)) / 2, rel=1e-8)


# ---- bootstrap ----


def forecasts(n=900, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"date": [d for d in days_of(n)], "y": rng.normal(0.001, 0.02, n)})
    pdf["yhat"] = pdf["y"] * 0.1 + rng.normal(0, 0.01, n)
    return pdf


def test_bootstrap_equals_resampled_rows(spark):
    """Weights summed over blocks are the same as repeating every row of a block."""
    pdf = forecasts(200)
    made = {(r.statistic, r.level): r for r in inference.bootstrap_intervals(spark.createDataFrame(pdf), [], ["mae", "rmse", "sharpe_ratio"], replicates=60, days=10).collect()}
    block = [(d - date(1970, 1, 1)).days + 25567 for d in pdf["date"]]
    stats = {"mae": [], "rmse": [], "sharpe_ratio": []}
    limits = np.array(poisson_limits())
    for r in range(60):
        weight = [int((plain_hash(b // 10, r, inference.SEED) >= limits).sum()) for b in block]
        rows = pdf.loc[pdf.index.repeat(weight)]
        e, gain = rows["y"] - rows["yhat"], np.sign(rows["yhat"]) * rows["y"]
        stats["mae"].append(e.abs().mean())
        stats["rmse"].append(math.sqrt((e**2).mean()))
        stats["sharpe_ratio"].append(math.sqrt(252) * (gain.mean() - 0.02 / 252) / gain.std(ddof=0))
    for (s, level), r in made.items():
        assert [r.low, r.high] == pytest.approx(list(np.quantile(stats[s], [(1 - level) / 2, (1 + level) / 2])), rel=1e-9)
    assert made["mae", 0.9].value == pytest.approx((pdf["y"] - pdf["yhat"]).abs().mean()) and len(made) == 9


def test_bootstrap_limits_have_the_right_width(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"date": days_of(2000), "y": rng.normal(0, 1, 2000), "yhat": 0.0})
    made = {r.level: r for r in inference.bootstrap_intervals(spark.createDataFrame(pdf), [], ["mae"], days=1).collect()}
    error = np.abs(pdf["y"]).std() / math.sqrt(2000)
    for level, z in [(0.9, 1.645), (0.95, 1.96), (0.99, 2.576)]:
        assert (made[level].high - made[level].low) / 2 == pytest.approx(z * error, rel=0.15)


def test_bootstrap_odd_groups(spark):
    rows = [("a", START, 1.0, 1.0), ("a", None, 2.0, 1.0), ("b", START, None, 1.0), ("c", START, 1.0, float("nan")), (None, START, 3.0, 1.0), ("d", START, 1.0, 0.0)]
    made = {(r.g, r.statistic): r for r in inference.bootstrap_intervals(spark.createDataFrame(rows, "g string, date date, y double, yhat double"), ["g"], levels=(0.9,)).collect()}
    assert set(made) == {(g, s) for g in ("a", None, "d") for s in ("mae", "sharpe_ratio")}
    assert made["a", "mae"].low == made["a", "mae"].high == 0.0 and made[None, "mae"].high == 2.0
    assert made["a", "sharpe_ratio"].value is None and made["a", "sharpe_ratio"].low is None


# ---- Newey-West ----


def plain_newey_west(x, y, lags):
    x = np.column_stack([np.ones(len(x)), x])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    u = x * (y - x @ beta)[:, None]
    s = u.T @ u
    for lag in range(1, lags + 1):
        g = u[lag:].T @ u[:-lag]
        s += (1 - lag / (lags + 1)) * (g + g.T)
    return beta, np.sqrt(np.diag(inverse @ s @ inverse))


@pytest.mark.parametrize("k, lags", [(1, 0), (2, 5), (4, 3)])
def test_newey_west(spark, k, lags):
    rng, rows, want = np.random.default_rng(k), [], {}
    for s, n in [("A", 150), ("B", 60)]:
        x, noise = rng.normal(size=(n, k)), np.convolve(rng.normal(size=n + 4), np.ones(5), "valid")
        y = x @ np.arange(1, k + 1) + noise + 0.5
        rows += [(s, START + timedelta(days=i), float(y[i]), *map(float, x[i])) for i in range(n)]
        want[s] = plain_newey_west(x, y, lags)
    names = [f"x{i}" for i in range(k)]
    rows += [("A", START + timedelta(days=500), None, *[1.0] * k), ("A", START + timedelta(days=501), float("inf"), *[1.0] * k), ("FEW", START, 1.0, *[1.0] * k)]
    rows += [("SAME", START + timedelta(days=i), float(i), *[2.0] * k) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, date date, y double, " + ", ".join(f"{n} double" for n in names))
    made = {(r.symbol, r.term): r for r in inference.newey_west(df, "y", names, lags).collect()}
    for s, (beta, error) in want.items():
        for i, term in enumerate(["intercept", *names]):
            r = made[s, term]
            assert r.coefficient == pytest.approx(beta[i], abs=1e-9) and r.std_error == pytest.approx(error[i], rel=1e-8)
            assert r.p_value == pytest.approx(math.erfc(abs(beta[i] / error[i]) / math.sqrt(2)), rel=1e-6, abs=1e-300)
    for s in ("FEW", "SAME"):
        assert all(made[s, t].coefficient is None and made[s, t].p_value is None for t in ["intercept", *names])


# ---- tests of forecasts ----


def plain_dm(d, h):
    n, c = len(d), d - d.mean()
    g = [c @ c / n, *[c[j:] @ c[:-j] / n for j in range(1, h)]]
    v = g[0] + 2 * sum(g[1:])
    if v <= 1e-12 * g[0]:
        v = g[0] + 2 * sum((1 - j / h) * g[j] for j in range(1, h))
    return d.mean() / math.sqrt(v / n) * math.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)


@pytest.mark.parametrize("horizon, power", [(1, 2), (5, 2), (3, 1)])
def test_diebold_mariano(spark, horizon, power):
    rng, n = np.random.default_rng(horizon), 300
    pdf = pd.DataFrame({"date": np.repeat(days_of(n), 2), "y": rng.normal(size=2 * n)})
    for m, spread in [("a", 0.5), ("b", 0.9), ("c", 0.9)]:
        pdf[m] = pdf["y"] + np.repeat(np.convolve(rng.normal(size=n + horizon - 1), np.ones(horizon), "valid"), 2) * spread
    pdf.loc[pdf.index < 40, "c"] = np.nan  # a shorter history
    made = {(r.model_a, r.model_b): r for r in inference.diebold_mariano(spark.createDataFrame(pdf), "y", ["a", "b", "c"], horizon, power).collect()}
    for (a, b), r in made.items():
        d = ((pdf["y"] - pdf[a]).abs() ** power - (pdf["y"] - pdf[b]).abs() ** power).groupby(pdf["date"]).mean().dropna().to_numpy()
        assert r.n == len(d) and r.statistic == pytest.approx(plain_dm(d, horizon), rel=1e-8)
        assert r.p_value == pytest.approx(math.erfc(abs(r.statistic) / math.sqrt(2)), rel=1e-6)
    assert made["a", "b"].statistic < -2 and made["a", "b"].p_value < 0.05


def test_equal_forecasts_have_no_statistic(spark):
    pdf = forecasts(50).assign(a=0.1, b=0.1)
    r = inference.diebold_mariano(spark.createDataFrame(pdf), "y", ["a", "b"]).first()
    assert r.mean_difference == 0 and r.statistic is None and r.p_value is None


def test_holm(spark):
    p = {"a": 0.01, "b": 0.04, "c": 0.03, "d": 0.5, "e": None, "f": 0.03}
    made = {r.model: r for r in inference.holm(spark.createDataFrame(list(p.items()), "model string, p_value double")).collect()}
    assert {m: made[m].p_holm for m in "acfbd"} == pytest.approx({"a": 0.05, "c": 0.12, "f": 0.12, "b": 0.12, "d": 0.5})
    assert made["a"].rejected and not made["c"].rejected and made["e"].p_holm is None and not made["e"].rejected


def test_reality_check(spark):
    rng, n = np.random.default_rng(2), 660
    pdf = pd.DataFrame({"date": days_of(n), "y": rng.normal(size=n)})
    pdf["none"] = 0.0
    pdf["good"] = pdf["y"] * 0.4
    luck = [f"luck{i}" for i in range(8)]
    for m in luck:
        pdf[m] = rng.normal(0, 0.05, n)
    made = {r.model: r for r in inference.reality_check(spark.createDataFrame(pdf), "y", "none", ["good", *luck], replicates=400).collect()}
    assert made["good"].p_reality <= 0.01 and made["good"].rejected and not any(made[m].rejected for m in luck)
    gains = {m: pdf["y"] ** 2 - (pdf["y"] - pdf[m]) ** 2 for m in made}
    block = np.array([((d - date(1970, 1, 1)).days + 25567) // 22 for d in pdf["date"]])
    limits, draws = np.array(poisson_limits()), {m: [] for m in made}
    for r in range(400):
        w = np.array([int((plain_hash(int(b), r, inference.SEED) >= limits).sum()) for b in block])
        for m in made:
            draws[m].append((gains[m] * w).sum() / w.sum() - gains[m].mean())
    most = np.max([draws[m] for m in made], axis=0)
    for m, r in made.items():
        assert r.n == n and r.gain == pytest.approx(gains[m].mean()) and r.statistic == pytest.approx(gains[m].mean() * math.sqrt(n))
        assert r.p_value == pytest.approx(np.mean(np.array(draws[m]) >= gains[m].mean())) and r.p_reality == pytest.approx(np.mean(most >= gains[m].mean()))


def test_reality_check_without_rows(spark):
    empty = spark.createDataFrame([], "date date, y double, a double, b double")
    assert inference.reality_check(empty, "y", "a", ["b"], replicates=5).count() == 0
    assert inference.diebold_mariano(empty, "y", ["a", "b"]).count() == 0
