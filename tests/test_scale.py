"""Skewed keys, exact quantiles and ranks, and the shape of plans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import decay, indicators as ind, news, positions
from tapeloom.sources.bars import daily_bars, order_number, symbol_dimension

from .conftest import SF_DIR


def values(spark, xs, name="x"):
    return spark.createDataFrame(pd.DataFrame({name: np.asarray(xs, dtype=float)}))


@pytest.mark.parametrize(
    "xs",
    [
        [3.0], [1.0, 2.0], [0.0] * 50 + [1.0], list(range(101)), [-5.5, -1e-300, 0.0, 1e-300, 7e200, -3e150],
        [0.62, 0.9, 0.8, 0.65, 0.55], [1.0 + i * 1e-12 for i in range(500)], [(-1) ** i * 1.7**(i % 90) for i in range(400)],
    ],
)
def test_quantiles_are_exact(spark, xs):
    probs = [0.0, 0.05, 0.25, 0.3, 0.5, 0.75, 0.99, 1.0]
    got = positions.exact_quantiles(values(spark, xs), ["x"], probs)["x"]
    assert got == pytest.approx(list(np.quantile(np.asarray(xs, dtype=float), probs)), rel=1e-12, abs=1e-300)


def test_quantiles_refine_large_buckets(spark):
    xs = np.concatenate([np.full(400, 5.0), 5.0 + np.random.default_rng(1).random(600) * 1e-3])
    got = positions.exact_quantiles(values(spark, xs), ["x"], [0.1, 0.5, 0.9])["x"]
    assert got == pytest.approx(list(np.quantile(xs, [0.1, 0.5, 0.9])), rel=1e-12)


def test_quantiles_ignore_nulls_and_handle_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "x double, y double")
    assert positions.exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [2.0], "y": [None]}


def test_rank_correlation_with_a_pair_on_a_third_of_the_rows(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"feature": np.where(rng.random(3000) < 0.5, "a", "b"), "x": rng.normal(size=3000).round(2), "y": rng.normal(size=3000).round(2)})
    pdf.loc[pdf.index % 3 == 0, ["x", "y"]] = 0.0
    got = {r.feature: r for r in positions.spearman(spark.createDataFrame(pdf), ["feature"], "feature", "x", "y").collect()}
    for name, part in pdf.groupby("feature"):
        assert got[name].rows == len(part) and got[name].spearman == pytest.approx(part["x"].rank().corr(part["y"].rank()), abs=1e-12)


def test_rank_correlation_is_one_short_plan(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0)], "feature string, x double, y double")
    assert plan_of(positions.spearman(df, ["feature"], "feature", "x", "y")).count("Exchange") < 15


def test_quantiles_ignore_nan_and_infinite(spark):
    xs = [1.0, 2.0, 3.0, 4.0, float("nan"), float("inf"), float("-inf")]
    assert positions.exact_quantiles(values(spark, xs), ["x"], [0.0, 0.5, 1.0])["x"] == [1.0, 2.5, 4.0]


def test_quantiles_of_many_columns(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(300, 120)), columns=[f"c{i}" for i in range(120)])
    probs = [i / 17 for i in range(18)]
    got = positions.exact_quantiles(spark.createDataFrame(pdf), list(pdf.columns), probs)
    assert all(got[c] == pytest.approx(list(np.quantile(pdf[c], probs)), rel=1e-12) for c in pdf)


def test_bars_are_a_panel(spark):
    from catalog.base import bars, scored
    from tapeloom.operators.quality import panel_violations

    assert panel_violations(bars(spark, SF_DIR)).isEmpty()
    one = scored(spark, SF_DIR)
    assert panel_violations(one.unionByName(one)).count() == one.select("symbol", "date").distinct().count()


def test_symbol_ids_follow_the_global_order(spark):
    symbols = spark.range(500).select(F.format_string("T%03d", F.pmod(F.col("id") * 37, F.lit(250))).alias("symbol"))
    got = {r.symbol: r.stock_id for r in symbol_dimension(symbols).collect()}
    assert len(got) == 250 and got["T000"] == "stock_0001" and got["T249"] == "stock_0250"


def trades(spark, hot):
    """Trades of which symbol HOT makes a third."""
    return spark.range(hot * 3).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.format_string("C%04d", F.col("id") % 997)).alias("s"),
        F.timestamp_seconds(F.lit(1577836800) + F.col("id") % 5 * 86400).alias("t"),
        (F.col("id") % 101 + 1).cast("double").alias("p"), F.lit(1.0).alias("v"), "id",
    )


def test_hot_symbol_is_reduced_before_the_shuffle(spark):
    df = daily_bars(trades(spark, 20_000), F.col("s"), F.col("t"), F.col("p"), F.col("v"), [("id", 18)])
    hot = df.filter(F.col("symbol") == "HOT").orderBy("date").collect()
    assert len(hot) == 5 and sum(r.volume for r in hot) == 20_000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and plan.count("Exchange") == 1
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort [" not in plan


def test_an_order_key_that_does_not_fit_is_an_error(spark):
    df = spark.createDataFrame([(12345,), (-1,)], "id long")
    for bad in (df.filter("id > 0"), df.filter("id < 0")):
        with pytest.raises(Exception, match="does not fit"):
            bad.select(order_number([("id", 4)])).collect()
    with pytest.raises(ValueError):
        order_number([("id", 20), ("id", 20)])


def test_copies_are_folded_before_the_shuffle(spark):
    rows = spark.range(30_000).select(
        F.lit("2020-01-01").alias("date"), F.lit("A").alias("symbol"),
        F.when(F.col("id") % 3 == 0, "the same headline").otherwise(F.concat(F.lit("h"), F.col("id"))).alias("headline"),
        F.col("id").alias("article_id"),
    )
    got = news.distinct_articles(rows)
    assert got.count() == 20_001
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "partial_min" in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_indicators_share_one_shuffle(closes_of):
    plan = plan_of(ind.add_indicators(closes_of(range(1, 50))))
    assert plan.count("Exchange") == 1


def test_no_query_plan_has_a_cartesian_product(spark):
    from __spark_entry__ import queries

    for name in ("relevance_scores", "multi_company_records", "decay_features", "imputed_panel", "temporal_split", "time_index", "risk_table"):
        plan = plan_of(queries()[name](spark, SF_DIR))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scan_reads_only_needed_columns(spark):
    from __spark_entry__ import queries

    plan = plan_of(queries()["daily_bars"](spark, SF_DIR))
    assert "l_tax" not in plan and "l_returnflag" not in plan


def test_headline_is_normalised_once_per_row(spark):
    from __spark_entry__ import queries

    plan = plan_of(queries()["lexicon_scores"](spark, SF_DIR))
    assert plan.count("UNABLE_TO_") <= 2  # the expression and its output attribute


def test_rates_are_scored_without_a_cross_join(spark):
    grid = decay.rate_grid(steps=4)
    assert grid[5] == [0.05, 0.133333, 0.216667, 0.3]


def test_series_are_dealt_by_their_number_of_rows(spark, closes_of):
    """Twice the rows are twice the tasks, and all indicators are computed where the rows lie."""
    from tapeloom.operators.windows import TASK_ROWS, dealt

    bars = closes_of(range(1, 50))
    assert [dealt(bars, n * TASK_ROWS).rdd.getNumPartitions() for n in (1, 20, 40)] == [8, 20, 40]
    plan = plan_of(ind.add_indicators(dealt(bars, 20 * TASK_ROWS)))
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1


def test_all_indicators_are_dealt(spark):
    from __spark_entry__ import queries

    assert "REPARTITION_BY_NUM" in plan_of(queries()["all_indicators"](spark, SF_DIR))


def test_windows_are_scored_as_they_lie_in_a_batch(spark):
    """A model gets the numbers of a batch without a Python object per step; uneven windows are an error."""
    from tapeloom.operators.sequences import score_windows

    def load():
        return lambda x: x[:, -1, 0] + 10 * x[:, 0, 1] if x.dtype == np.float32 and x.shape[1:] == (2, 2) else 1 / 0

    rows = [("A", [[1.0, 2.0], [3.0, 4.0]]), ("B", [[5.0, 6.0], [float("nan"), 8.0]])]
    scored = score_windows(spark.createDataFrame(rows, "symbol string, sequence array<array<float>>"), load)
    assert {r.symbol: r.prediction for r in scored.collect()} == {"A": 23.0, "B": None}
    assert "MapInArrow" in plan_of(scored)
    uneven = spark.createDataFrame([("A", [[1.0]]), ("B", [[1.0], [2.0]])], "symbol string, sequence array<array<float>>").coalesce(1)
    with pytest.raises(Exception, match="differ in their numbers"):
        score_windows(uneven, load).collect()


def test_targets_are_ranked_once_for_all_rates(spark, monkeypatch):
    """The returns of a horizon have the same ranks under each of its rates."""
    calls, plain = [], positions.rank_dictionary

    def noted(long, by, value, *more):
        calls.append((by, value))
        return plain(long, by, value, *more)

    monkeypatch.setattr(positions, "rank_dictionary", noted)
    monkeypatch.setattr(decay, "rank_dictionary", noted, raising=False)
    rows = [("A", f"2020-01-{d:02d}", float(d * d % 7)) for d in range(1, 29)]
    market = spark.createDataFrame(rows, "symbol string, date string, target_5d double").withColumn("date", F.to_date("date"))
    daily = market.select("symbol", "date", (F.col("target_5d") / 7).alias("sentiment_compound"), F.lit(0.8).alias("confidence"), F.lit(1).alias("article_count"))
    got = decay.score_rates(market, daily, {5: [0.05, 0.1, 0.3]}).collect()
    assert len(got) == 3 and all(r.rows == 28 for r in got)
    assert sorted(calls) == [("feature", "value"), ("horizon", "target")]
