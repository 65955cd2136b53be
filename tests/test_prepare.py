"""Fitting on training rows only, splits, metrics and quality rules by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import metrics, prepare, quality, registry, selection, sequences, splits
from tapeloom.plans import market_news

from .conftest import day


def series(spark, xs, split=None, symbol="A"):
    rows = [(symbol, day(i), None if x is None else float(x), split(i) if split else "train") for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, date date, x double, split string")


def test_split_cuts_by_distinct_dates(spark):
    df = spark.createDataFrame([(s, day(i)) for i in range(100) for s in ("A", "B")], "symbol string, date date")
    got = {r.split: r.rows for r in splits.split_bounds(splits.temporal_split(df)).collect()}
    assert got == {"train": 140, "val": 40, "test": 20}
    splits.require_no_leakage(splits.temporal_split(df))
    with pytest.raises(ValueError):
        splits.require_no_leakage(df.withColumn("split", F.lit("train")))


def test_fitted_numbers_ignore_later_rows(spark):
    def label(i):
        return "train" if i < 10 else "test"

    a = series(spark, range(20), label)
    b = series(spark, [*range(10), *([1e6] * 10)], label)
    for method in ("robust", "standard", "minmax", "zscore"):
        assert prepare.fit_scales(a, ["x"], method) == prepare.fit_scales(b, ["x"], method)
    for method in ("iqr", "zscore", "percentile"):
        assert prepare.clip_bounds(a, ["x"], method) == prepare.clip_bounds(b, ["x"], method)


def test_imputation_order(spark):
    a = series(spark, [None, 2.0, None, 4.0])
    b = series(spark, [None, None], symbol="B")
    got = [(r.symbol, r.x) for r in prepare.impute(a.unionByName(b), ["x"]).orderBy("symbol", "date").collect()]
    assert got == [("A", 3.0), ("A", 2.0), ("A", 2.0), ("A", 4.0), ("B", 3.0), ("B", 3.0)]



def test_impute_derives_its_rows_once(spark):
    derived = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            derived.add(batch.num_rows)
            yield batch

    rows = series(spark, [None, 1, None, 3, 5])
    assert [r.x for r in prepare.impute(rows.mapInArrow(count, rows.schema), ["x"]).orderBy("date").collect()] == [3, 1, 1, 3, 5]
    assert derived.value == 5


def test_constant_column_scales_by_one(spark):
    assert prepare.fit_scales(series(spark, [5, 5, 5]), ["x"])["x"] == prepare.Scale(5.0, 1.0)


def test_scaling_round_trip(spark):
    df = series(spark, [1, 2, 4, 8])
    scales = prepare.fit_scales(df, ["x"], "minmax", (-1.0, 1.0))
    back = prepare.undo_scales(prepare.apply_scales(df, scales), scales)
    assert [r.x for r in back.orderBy("date").collect()] == pytest.approx([1, 2, 4, 8])


def pairs(spark, rows):
    return spark.createDataFrame([("m", float(a), float(b)) for a, b in rows], "model string, y double, yhat double")


def test_metrics_by_hand(spark):
    df = pairs(spark, [(0.01, 0.02), (-0.02, 0.01), (0.0003, -0.01), (-0.01, -0.03), (0.02, 0.01)])
    m = metrics.forecast_metrics(df, ["model"], "y").first()
    assert m.directional_accuracy == 0.75
    assert m.rmse == pytest.approx(math.sqrt(np.mean(np.square([-0.01, -0.03, 0.0103, 0.02, 0.01]))))
    flat = metrics.forecast_metrics(pairs(spark, [(0.0, 1.0), (0.0, 2.0)]), ["model"], "y").first()
    assert (flat.r2, flat.directional_accuracy, flat.sharpe_ratio, flat.mape) == (0.0, 0.5, 0.0, math.inf)


def test_drawdown_and_sharpe(spark):
    df = series(spark, [0.01, -0.02, 0.03, -0.01, 0.0])
    assert metrics.max_drawdown(df, "x").first().max_drawdown == pytest.approx(-0.02)
    assert df.agg(metrics.sharpe(F.col("x"))).first()[0] == pytest.approx(1.772145, abs=1e-6)


@pytest.mark.parametrize("q,df,want", [(18.307038, 10, 0.05), (3.841459, 1, 0.05), (7.814728, 3, 0.05), (5.991465, 2, 0.05), (0.0, 5, 1.0)])
def test_chi_square_tail(spark, q, df, want):
    got = spark.range(1).select(metrics.chi_square_tail(F.lit(q), F.lit(float(df)))).first()[0]
    assert got == pytest.approx(want, abs=1e-6)


def test_short_residual_series_pass(spark):
    assert metrics.ljung_box(series(spark, [0.1, -0.1, 0.2]), "x").first().passed


def test_windows_skip_gaps_and_short_symbols(spark):
    xs = [0.1 * (i % 7) for i in range(8)]
    df = series(spark, xs).unionByName(series(spark, [1, 2], symbol="B"))
    got = sequences.training_windows(df, ["x"], "x", 5).orderBy("date").collect()
    assert [r.symbol for r in got] == ["A"] * 3
    assert [round(v[0], 4) for v in got[0].sequence] == [round(x, 4) for x in xs[:5]] and got[0].label == pytest.approx(xs[5])
    holed = series(spark, [*xs[:3], None, *xs[4:]])
    assert sequences.training_windows(holed, ["x"], "x", 5).count() == 0
    assert sequences.inference_windows(holed, ["x"], 5).count() == 4


def test_constant_windows_are_dropped(spark):
    assert sequences.training_windows(series(spark, [1.0] * 9), ["x"], "x", 4).count() == 0


def test_pruning_prefers_protected_features(spark):
    rng = np.random.default_rng(0)
    close, noise, target = rng.normal(size=200), rng.normal(size=200), rng.normal(size=200)
    rows = [(float(c), float(c + 8e-2 * n), float(n), float(t)) for c, n, t in zip(close, noise, target)]
    df = spark.createDataFrame(rows, "close double, odd double, noise double, target_5 double")
    assert selection.prune_correlated(df, ["close", "odd", "noise"], "target_5", False) == ["close", "noise"]


def test_every_target_is_kept_out_of_features():
    names = ["symbol", "date", "close", "target_5", "target_22d", "target_5_log", "label_5d", "split", "sentiment_decay_5d_compound"]
    assert registry.feature_columns(names) == ["close", "sentiment_decay_5d_compound"]
    assert registry.protected_features(names, True) == ["close", "sentiment_decay_5d_compound"]
    assert registry.ordered_columns(["target_5", "rsi_14", "close", "year", "symbol", "zzz"]) == ["symbol", "close", "rsi_14", "year", "target_5", "zzz"]


def test_selection_keeps_protected_first(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(float(v) for v in rng.normal(size=4)) for _ in range(60)]
    df = spark.createDataFrame([(a, b, c, b) for a, b, c, _ in rows], "close double, good double, bad double, target_5 double")
    assert selection.select_k_best(df, ["bad", "good", "close"], "target_5", False, "f_regression", k=2) == ["close", "good"]


def test_empty_targets_are_reported(spark):
    df = spark.createDataFrame([("A", day(0), None)], "symbol string, date date, target_5 double")
    rules = {(r.severity, r.rule, r.subject) for r in quality.validate_dataset(df, ["symbol", "close"]).collect()}
    assert ("error", "missing_column", "close") in rules and ("warning", "low_target_coverage", "target_5") in rules
    assert ("warning", "short_date_range", "date") in rules and ("warning", "sparse_symbol", "A") in rules


def test_observed_counts_without_an_extra_job(spark):
    df, watch = quality.observed(spark.range(10).filter("id > 3"), "stage")
    df.collect()
    assert watch.get == {"rows": 6}


def test_whole_feature_panel(spark):
    from catalog.base import bars, daily

    from .conftest import SF_DIR

    b, d = bars(spark, SF_DIR), daily(spark, SF_DIR)
    panel = market_news.feature_panel(b, d)
    want = b.groupBy("symbol").count().agg(F.sum(F.greatest(F.col("count") - 90, F.lit(0)))).first()[0]
    rows = panel.select("symbol", "date", "ema_20", "sentiment_decay_22d_compound", "article_count", "split").collect()
    assert len(rows) == want and {r.split for r in rows} == {"train", "val", "test"}
    assert all(r.article_count is not None and r.sentiment_decay_22d_compound is not None for r in rows)


def test_news_flow_ends_in_one_row_per_symbol_and_day(spark):
    from catalog.base import DICTIONARY, articles

    from .conftest import SF_DIR

    out = market_news.news_sentiment(articles(spark, SF_DIR), DICTIONARY).cache()
    assert out.count() == out.select("symbol", "date").distinct().count() > 0


def test_each_branch_of_pruning(spark):
    """Protected features, sentiment features and plain ones, on both sides of every limit."""
    pairs = [
        ("close", "open", 0.996), ("close", "open", 0.994),  # both protected
        ("close", "x", 0.995), ("x", "close", 0.995), ("close", "x", 0.989), ("close", "strong", 0.9995), ("close", "x", 0.9995),  # one
        ("sentiment_decay_a", "sentiment_decay_b", 0.985), ("sentiment_decay_a", "sentiment_decay_b", 0.979),  # both sentiment
        ("sentiment_decay_a", "x", 0.976), ("sentiment_decay_a", "strong", 0.976), ("strong", "sentiment_decay_a", -0.976),  # mixed
        ("x", "strong", 0.971), ("x", "strong", 0.969),  # plain
    ]
    score = {"close": 0.5, "open": 0.4, "x": 0.31, "strong": 0.6, "sentiment_decay_a": 0.3, "sentiment_decay_b": 0.2}
    want = [
        "open", "-", "x", "x", "-", "close", "x", "sentiment_decay_b", "-", "x", "sentiment_decay_a", "sentiment_decay_a", "x", "-",
    ]
    scores = spark.createDataFrame(list(score.items()), "feature string, score double")
    for (left, right, c), victim in zip(pairs, want):
        rows = spark.createDataFrame([(left, right, c)], "left string, right string, correlation double")
        got = selection.prune_decisions(rows, scores, list(score), False).collect()
        assert [r.removed for r in got if r.removed] == ([] if victim == "-" else [victim]), (left, right, c)


def test_unknown_targets_keep_their_place_in_the_horizon(spark):
    rows = [("A", i, float(i), None if i == 4 else float(i), "train" if i < 5 else "test") for i in range(9)]
    df = spark.createDataFrame(rows, "symbol string, n int, x double, y double, split string").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("n")))
    w = sequences.encoder_decoder_windows(df, ["x"], "y", 3, 4).orderBy("date").collect()
    assert w[2].target_center == 1.5  # 0, 1, 2, 3: training rows with a target
    assert [v is None for v in w[2].decoder] == [False, True, False, False] and len(w[2].decoder) == 4


def test_zoned_timestamps_become_utc(spark):
    """A zoned timestamp keeps its instant, a date in text its wall clock, whatever the zone of the session."""
    from tapeloom.sources.standardize import without_time_zone

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "Asia/Kolkata", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.sql("SELECT TIMESTAMP '2024-07-01 12:00:00 UTC' AS ts, '2024-07-01 12:00:00' AS event_date, 'x' AS other")
            r = without_time_zone(df).select(F.col("ts").cast("string").alias("ts"), F.col("event_date").cast("string").alias("d"), "other").first()
            assert tuple(r) == ("2024-07-01 12:00:00", "2024-07-01 12:00:00", "x")
            assert dict(without_time_zone(df).dtypes)["ts"] == "timestamp_ntz"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_whole_preparation(spark):
    """Empty columns leave, the rest is filled, clipped, chosen, pruned and scaled with numbers of the training rows."""
    import numpy as np
    import pandas as pd

    from tapeloom.plans import prepared

    rng = np.random.default_rng(3)
    n = 400
    dates = pd.date_range("2020-01-01", periods=n // 2).date
    pdf = pd.DataFrame({"symbol": np.repeat(["A", "B"], n // 2), "date": np.tile(dates, 2), "close": rng.normal(100, 5, n), "target_5": rng.normal(size=n)})
    pdf["good"] = pdf["target_5"] + 0.1 * rng.normal(size=n)
    pdf["twin"] = pdf["good"] * 2 + 1e-6 * rng.normal(size=n)
    pdf["holes"] = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n))
    pdf["noise"], pdf["empty"], pdf["wild"] = rng.normal(size=n), np.nan, rng.standard_cauchy(n)
    made = prepared.prepared_panel(spark.createDataFrame(pdf), with_sentiment=False, k=5)
    assert made.gone["empty"] == ["empty"] and len(made.gone["not selected"]) == 1 and set(made.gone["correlated"]) <= {"good", "twin"} and made.gone["correlated"]
    assert "close" in made.features and set(made.features) | set(sum(made.gone.values(), [])) == {"close", "good", "twin", "holes", "noise", "empty", "wild"}
    out = made.table.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    assert out["target_5"].to_numpy() == pytest.approx(pdf["target_5"].to_numpy())
    train = (out["split"] == "train").to_numpy()
    for f in set(made.features) & {"noise", "wild", "close"}:
        x = pdf[f].to_numpy()
        q1, q3 = np.quantile(x[train], [0.25, 0.75])
        x = np.clip(x, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        a, b, c = np.quantile(x[train], [0.25, 0.5, 0.75])
        assert out[f].to_numpy() == pytest.approx((x - b) / (c - a))
    assert out[made.features].notna().all().all()
    assert prepared.preparation_summary(made, False).first().features == len(made.features)


def test_constant_columns_have_no_correlation(spark):
    rows = [(float(i), 1.0, None if i % 2 else float(i), float(i * i)) for i in range(20)]
    df = spark.createDataFrame(rows, "x double, same double, holes double, target_5 double").withColumn("split", F.lit("train"))
    scores = {r.feature: r.score for r in selection.correlation_scores(df, ["x", "same", "holes"], "target_5").collect()}
    want = np.corrcoef([r[0] for r in rows[::2]], [r[3] for r in rows[::2]])[0, 1]
    assert scores["same"] is None and scores["holes"] == pytest.approx(want) and scores["x"] > 0.9
    assert {r.feature: r.score for r in selection.f_scores(df, ["x", "same"], "target_5").collect()}["same"] is None
    assert selection.prune_correlated(df, ["x", "same", "holes"], "target_5", False)


def test_scores_of_many_features_keep_one_small_aggregate(spark):
    """The number of aggregate expressions does not grow with the features, or the aggregate is too large to be compiled."""
    names = [f"x{i}" for i in range(60)]
    df = spark.range(200).select(F.lit("train").alias("split"), F.col("id").cast("double").alias("target_5"), *[F.sin(F.col("id") * (i + 1)).alias(c) for i, c in enumerate(names)])
    columns = {c: [r[c] for r in df.collect()] for c in ["target_5", *names]}
    for score in (selection.correlation_scores, selection.f_scores):
        made = score(df, names, "target_5")
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("covar_pop(") < 5 and plan.count("stddev_pop(") < 5
        assert score(df.limit(0), names, "target_5").filter("score is null").count() == len(names)
    got = {r.feature: r.score for r in selection.correlation_scores(df, names, "target_5").collect()}
    assert got == pytest.approx({c: abs(np.corrcoef(columns[c], columns["target_5"])[0, 1]) for c in names})


def test_cleaning_some_features_writes_them_once(spark, monkeypatch):
    """The features asked for come out as among all others, and nothing but the panel and its filled form is written."""
    from tapeloom.operators import prepare as p
    from tapeloom.plans import prepared

    rows = [(f"S{s}", day(d), float(d * 7 % 31 + s), None if d % 5 == 0 else float(d), float(s), "train" if d < 30 else "test") for s in range(3) for d in range(40)]
    panel = spark.createDataFrame(rows, "symbol string, date date, a double, b double, c double, split string")
    every, features, _ = prepared.clean_panel(panel)
    stages = []
    for module in (p, prepared):
        monkeypatch.setattr(module, "written", lambda df, name="stage", real=module.written: (stages.append((name, df.columns)), real(df, name))[1])
    some, kept, _ = prepared.clean_panel(panel, only=["b", "c"])
    assert kept == ["b", "c"] and {"a", "b", "c"} <= set(features)
    assert [n for n, _ in stages] == ["panel", "filled"] and all("a" not in columns for _, columns in stages)
    keys = ["symbol", "date", "b", "c"]
    assert sorted(map(tuple, some.select(*keys).collect())) == sorted(map(tuple, every.select(*keys).collect()))
