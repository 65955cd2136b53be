"""Mutual information by neighbours against brute force over all pairs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import neighbours


def digamma(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain(x, y, k=3):
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    radius = np.sort(d, axis=1)[:, k - 1]
    # the ends of an interval as the operator has them
    nx = [int(((x > a - r) & (x < a + r)).sum()) - 1 for a, r in zip(x, radius)]
    ny = [int(((y > a - r) & (y < a + r)).sum()) - 1 for a, r in zip(y, radius)]
    terms = np.mean([digamma(a + 1) + digamma(b + 1) for a, b in zip(nx, ny)])
    return max(0.0, digamma(len(x)) + digamma(k) - terms), radius


def sample(n=400, seed=2):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=n)
    pdf = pd.DataFrame({
        "target": y, "linear": y + rng.normal(size=n), "square": y**2 + 0.1 * rng.normal(size=n), "noise": rng.normal(size=n),
        "days": rng.integers(0, 5, n).astype(float), "constant": 3.0, "large": 1e9 + 1e6 * y, "split": np.where(np.arange(n) % 5 < 4, "train", "val"),
    })
    pdf["gaps"] = np.where(rng.random(n) < 0.3, np.nan, pdf["linear"])
    pdf["none"] = np.nan
    pdf.loc[3, "target"], pdf.loc[4, "linear"] = np.nan, np.inf
    return pdf


FEATURES = ["linear", "square", "noise", "days", "large", "gaps", "none"]


@pytest.mark.parametrize("run, k", [(16, 3), (100_000, 3), (40, 1), (16, 5)])
def test_information(spark, run, k):
    df = spark.createDataFrame(sample())
    points = neighbours.neighbour_points(df, FEATURES, "target")
    held = points.toPandas()
    radii = {(r.feature, r.id): r.radius for r in neighbours.radii_of(points, k, run).collect()}
    made = {r.feature: r for r in neighbours.information_of(points, k, run).collect()}
    assert set(made) == set(FEATURES) - {"none"}
    for f, part in held.groupby("feature"):
        want, radius = plain(part["x"].to_numpy(), part["y"].to_numpy(), k)
        assert np.array([radii[f, i] for i in part["id"]]) == pytest.approx(radius, abs=0)
        assert made[f].n == len(part) and made[f].score == pytest.approx(want, abs=1e-9)
    assert made["square"].score > 0.5 and made["linear"].score > made["noise"].score + 0.1


def test_known_information(spark):
    """A pair of normals with correlation r has -log(1 - r^2) / 2."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=6000)
    pdf = pd.DataFrame({"x": x, "target": 0.8 * x + 0.6 * rng.normal(size=6000)})
    r = neighbours.neighbour_information(spark.createDataFrame(pdf), ["x"], "target").first()
    assert r.score == pytest.approx(-math.log(1 - 0.64) / 2, abs=0.04)


def test_few_points(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, None)], "x double, target double")
    (r,) = neighbours.neighbour_information(df, ["x"], "target").collect()
    assert r.n == 2 and r.score is None
    assert neighbours.neighbour_information(df.limit(0), ["x"], "target").count() == 0


def test_digamma(spark):
    rows = [(1.0,), (2.0,), (3.0,), (10.0,), (1000.0,)]
    for x, v in spark.createDataFrame(rows, "x double").select("x", neighbours.digamma(F.col("x"))).collect():
        assert v == pytest.approx(digamma(int(x)), abs=1e-11)


def test_a_point_asks_few_cells_at_any_size(spark):
    """A feature with eight values: cells are narrow in both coordinates, so the cells a radius reaches do not grow with the rows."""
    asked = []
    for n in (4_096, 32_768):
        rng = np.random.default_rng(n)
        x, y = rng.integers(0, 8, n) + rng.uniform(0, 1e-10, n), rng.normal(size=n)
        points = spark.createDataFrame([("f", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "feature string, id long, x double, y double")
        cells = neighbours._cells(points, 64)
        placed = points.mapInArrow(neighbours._in_cells(cells), "feature string, id long, x double, y double, run int")
        assert placed.groupBy("run").count().agg({"count": "max"}).first()[0] < 4 * 64
        near = placed.groupBy("feature", "run").applyInArrow(neighbours._in_own_run(3), "feature string, id long, x double, y double, run int, near array<double>")
        asks = near.mapInArrow(neighbours._reached(cells), "feature string, id long, x double, y double, run int, radius double")
        asked.append(asks.count() / n)
    assert max(asked) < 2, asked
