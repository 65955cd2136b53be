"""Passes over many columns in whole arrays, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import columns, positions, selection


def table(spark, n=4000, width=90):
    """More columns than are read together, some with holes, one constant, one of few values, one of two signs over many magnitudes."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({f"x{i}": rng.normal(10.0**(i % 7), 1.0, n) for i in range(width)})
    pdf["x3"], pdf["x4"], pdf["x5"] = 0.1, rng.integers(0, 3, n).astype(float), rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n)
    pdf["y"] = pdf["x0"] + rng.normal(size=n)
    holes = pdf.astype(object)
    for c in ("x7", "x50", "y"):
        holes[c] = np.where(rng.random(n) < 0.2, None, pdf[c])
    df = spark.createDataFrame(holes, ", ".join(f"{c} double" for c in holes)).repartition(5)
    return holes.astype(float), df


def test_null_shares_and_quantiles_of_many_columns(spark):
    pdf, df = table(spark)
    names = [c for c in pdf if c != "y"]
    assert columns.null_shares(df, names) == pytest.approx(pdf[names].isna().mean().to_dict())
    assert columns.null_shares(df.limit(0), names[:2]) == {"x0": 1.0, "x1": 1.0}
    assert columns.null_shares(spark.createDataFrame([("a", None), (None, 1)], "s string, n int"), ["s", "n"]) == {"s": 0.5, "n": 0.5}
    probs = [0.01, 0.25, 0.5, 0.99]
    got = positions.exact_quantiles(df, names, probs)
    for c in names:
        assert got[c] == pytest.approx(list(np.nanquantile(pdf[c], probs)), rel=1e-12, abs=1e-300), c


def test_quantiles_of_crowded_buckets(spark):
    """Far more equal and neighbouring values than a bucket may hold undivided, and neighbours that no step parts."""
    crowd = np.concatenate([np.full(9000, 1.0), 1.0 + np.arange(9000) * 2.0**-52, [2.0, -5.0]])
    tiny = np.concatenate([np.full(9000, 5e-324), np.full(9000, 1e-323), [0.0, -0.0]])
    df = spark.createDataFrame(pd.DataFrame({"crowd": crowd, "tiny": tiny})).repartition(3)
    probs = [0.0, 0.3, 0.5, 0.75, 0.999, 1.0]
    got = positions.exact_quantiles(df, ["crowd", "tiny"], probs)
    assert got["crowd"] == list(np.quantile(crowd, probs)) and got["tiny"] == list(np.quantile(tiny, probs))


def test_counted_buckets_are_merged_within_a_task(spark, monkeypatch):
    monkeypatch.setattr(columns, "HELD", 50)
    xs = np.random.default_rng(1).normal(size=30_000)
    df = spark.createDataFrame(pd.DataFrame({"x": xs})).coalesce(1)
    counted = columns.histogram(df, ["x"])
    assert counted.agg(F.sum("n")).first()[0] == len(xs)
    assert positions.exact_quantiles(df, ["x"], [0.1, 0.5])["x"] == pytest.approx(list(np.quantile(xs, [0.1, 0.5])), rel=1e-12)


def test_many_columns_are_neither_spread_to_rows_nor_to_expressions(spark):
    """A row per value or an aggregate expression per column is what made these passes slow."""
    _, df = table(spark, 50)
    names = [c for c in df.columns if c != "y"]
    for made in (columns.histogram(df, names), selection.correlation_scores(df, names, "y"), selection.f_scores(df, names, "y")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan and "Generate explode" not in plan and "posexplode" not in plan
        assert plan.count("MapInArrow") == 5


def test_correlations_of_many_columns(spark):
    pdf, df = table(spark)
    names = [c for c in pdf if c not in ("y", "x5")]
    made = {r.place: r for r in columns.correlations(df, names, "y").collect()}
    for i, c in enumerate(names):
        both = pdf[[c, "y"]].dropna()
        assert made[i].n == len(both)
        assert made[i].r is None if c == "x3" else made[i].r == pytest.approx(np.corrcoef(both[c], both["y"])[0, 1], abs=1e-9), c
    full = pdf[names].dropna()
    with np.errstate(all="ignore"):
        want = np.corrcoef(full.to_numpy(), rowvar=False)
    pairs = selection.correlation_pairs(df, names).collect()
    assert len(pairs) == len(names) * (len(names) - 1) // 2
    for r in pairs:
        if "x3" in (r.left, r.right):
            assert r.correlation is None
        else:
            assert r.correlation == pytest.approx(want[names.index(r.left), names.index(r.right)], abs=1e-9)
    with pytest.raises(ValueError):
        selection.correlation_pairs(df.limit(1), names[:2]).collect()


def test_means_of_many_columns(spark):
    pdf, df = table(spark)
    names = [c for c in pdf if c != "x5"]
    assert {r.feature: r["mean"] for r in columns.means(df, names).collect()} == pytest.approx(pdf[names].mean().to_dict())
    assert [r["mean"] for r in columns.means(df.limit(0), ["x0", "x1"]).collect()] == [None, None]
    assert [r["mean"] for r in columns.means(spark.createDataFrame([(None,)], "x double"), ["x"]).collect()] == [None]


def test_long_chains_are_parted_for_one_write_only(spark, monkeypatch):
    from tapeloom.plans import prepared

    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(name)
    monkeypatch.setattr(prepared, "written", lambda df, stage="stage", real=prepared.written: (seen.append(spark.conf.get(name)), real(df, stage))[1])
    rows = spark.range(40).select(F.lit("A").alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("a"))
    table, features, empty = prepared.clean_panel(rows)
    assert (table.count(), features, empty) == (40, ["a"], [])
    assert seen[0] == "8000" and spark.conf.get(name) == before
