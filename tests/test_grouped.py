"""Exact quantiles of many groups, one of them holding a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import grouped

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def check(df, pdf, by, probs=PROBS):
    made = {tuple("none" if r[c] is None else r[c] for c in by): r for r in grouped.grouped_quantiles(df, by, "v", probs).collect()}
    fine = pdf[np.isfinite(pdf["v"].astype(float))].fillna({c: "none" for c in by})
    want = dict(list(fine.groupby(by)))
    assert len(made) == len(want)
    for key, part in want.items():
        assert made[key].n == len(part) and made[key].quantiles == pytest.approx(list(np.quantile(part["v"], probs)), rel=1e-12, abs=1e-300)


def test_groups_of_all_sizes(spark):
    rng = np.random.default_rng(4)
    n = 30_000
    pdf = pd.DataFrame({"a": np.where(rng.random(n) < 0.34, "hot", "s" + pd.Series(rng.integers(0, 900, n)).astype(str)), "b": rng.integers(0, 3, n), "v": rng.normal(size=n)})
    pdf.loc[pdf["a"] == "s5", "v"] = 7.0
    pdf.loc[pdf["a"] == "s6", "v"] = rng.choice([0.0, -0.0, 1e300, -1e300, 5e-324], (pdf["a"] == "s6").sum())
    pdf.loc[pdf["a"] == "s7", "v"] = 100 + rng.random((pdf["a"] == "s7").sum()) * 1e-9
    pdf.loc[rng.random(n) < 0.02, "a"] = None
    pdf.loc[rng.random(n) < 0.02, "v"] = np.nan
    pdf.loc[rng.random(n) < 0.01, "v"] = np.inf
    check(spark.createDataFrame(pdf).repartition(6), pdf, ["a"])
    check(spark.createDataFrame(pdf), pdf, ["a", "b"], [0.5])


def test_close_values_of_one_group(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": "x", "v": 5 + rng.random(20_000) * 1e-4})
    check(spark.createDataFrame(pdf), pdf, ["a"])


def test_no_rows(spark):
    empty = spark.createDataFrame([], "a string, v double")
    assert grouped.grouped_quantiles(empty, ["a"], "v", [0.5]).count() == 0
    only = spark.createDataFrame([("a", None), ("b", float("nan"))], "a string, v double")
    assert grouped.grouped_quantiles(only, ["a"], "v", [0.5]).count() == 0


def test_shape(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"symbol": rng.choice(["A", "B"], 300), "date": rng.choice(["d1", "d2"], 300), "sentiment_compound": rng.normal(size=300).round(2)})
    pdf = pd.concat([pdf, pd.DataFrame({"symbol": ["C"] * 3 + ["D"], "date": "d1", "sentiment_compound": [0.5, 0.5, 0.5, None]})])
    made = {(r.symbol, r.date): r for r in grouped.sentiment_shape(spark.createDataFrame(pdf)).collect()}
    for key, part in pdf.groupby(["symbol", "date"])["sentiment_compound"]:
        r, v = made.get(key), part.dropna()
        if v.empty:
            assert r is None or r.article_count == 0
            continue
        assert r.article_count == len(v) and r.sentiment_median == pytest.approx(v.median()) and r.sentiment_range == pytest.approx(v.max() - v.min())
        assert r.sentiment_iqr == pytest.approx(v.quantile(0.75) - v.quantile(0.25)) and r.sentiment_std == pytest.approx(v.std())
        assert (r.sentiment_skewness is None) if v.nunique() == 1 else r.sentiment_skewness == pytest.approx(v.skew())
