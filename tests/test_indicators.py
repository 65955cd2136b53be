"""Hand-worked indicator values and edge rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import decay, indicators as ind, windows

from .conftest import column, day


def approx(values):
    return [None if v is None else pytest.approx(v, abs=1e-6) for v in values]


def test_ema_needs_a_full_span(closes_of):
    got = column(ind.exponential_averages(closes_of([10, 11, 12, 11, 13]), [3]), "ema_3")
    assert got == approx([None, None, 11.25, 11.125, 12.0625])


def test_ema_of_a_long_series_matches_the_recursion(spark, closes_of):
    closes = [100 + (i * 37 % 101) / 7 for i in range(3000)]
    got = column(ind.exponential_averages(closes_of(closes), [5, 50]), "ema_5")
    want = pd.Series(closes).ewm(span=5, min_periods=5, adjust=False).mean()
    assert max(abs(a - b) for a, b in zip(got[4:], want[4:])) < 1e-9


def test_vwap_repeats_over_a_day_without_volume(bars_of):
    df = bars_of([(0, 8, 11, 8, 10, 100), (1, 9, 12, 9, 11, 0), (2, 10, 13, 10, 12, 200)])
    assert column(ind.vwap(df), "vwap") == approx([9.666667, 9.666667, 11.0])


def test_vwap_starts_with_the_typical_price_when_nothing_traded(bars_of):
    assert column(ind.vwap(bars_of([(0, 8, 11, 8, 10, 0)])), "vwap") == approx([9.666667])


def test_flat_range_gives_null_not_an_error(bars_of):
    df = ind.price_shape(bars_of([(0, 5, 5, 5, 5, 1)]))
    row = df.first()
    assert row.price_position is None and row.gap is None and row.intraday_return == 0


def test_rsi_is_100_when_nothing_falls(closes_of):
    assert column(ind.rsi(closes_of(range(10, 20)), [6]), "rsi_6")[5:] == [100.0] * 5


def test_true_range_does_not_look_into_another_symbol(spark, closes_of):
    both = closes_of([10] * 14, "A").unionByName(closes_of([1000] * 14, "B"))
    got = {r.symbol: r.atr for r in ind.true_range_average(both).filter(F.col("atr").isNotNull()).collect()}
    assert got == {"A": 0.0, "B": 0.0}


def test_direction_of_an_unknown_return_is_zero(closes_of):
    df = ind.horizon_returns(closes_of([1, 2, 3, 4, 5, 6, 1]), [5])
    assert column(df, "target_5_direction") == [0, 0, 0, 0, 0, 1, 0]


def test_warmup_removes_short_symbols(spark, closes_of):
    df = closes_of(range(1, 6), "A").unionByName(closes_of(range(1, 3), "B"))
    assert [r.symbol for r in ind.drop_warmup(df, 2).collect()] == ["A"] * 3


def test_no_feature_sees_the_future(closes_of):
    closes = [100 + (i * 13 % 17) for i in range(120)]
    full = ind.add_indicators(closes_of(closes)).filter(F.col("date") <= day(99))
    cut = ind.add_indicators(closes_of(closes[:100]))
    names = [c for c in full.columns if c not in ("symbol", "date")]
    a = [r.asDict() for r in full.orderBy("date").collect()]
    b = [r.asDict() for r in cut.orderBy("date").collect()]
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert {c: (None if x[c] is None else round(x[c], 6)) for c in names} == {
            c: (None if y[c] is None else round(y[c], 6)) for c in names
        }


def test_partitioning_does_not_change_results(closes_of):
    df = closes_of([50 + (i * 7 % 11) for i in range(80)]).unionByName(closes_of([20 + (i * 5 % 13) for i in range(80)], "B"))
    a = ind.macd(df.repartition(1)).orderBy("symbol", "date").collect()
    b = ind.macd(df.repartition(7, "volume", "close")).orderBy("symbol", "date").collect()
    assert a == b


def sentiment(spark, rows, symbol="A"):
    return spark.createDataFrame(
        [(symbol, day(d), x, max(x, 0.0), max(-x, 0.0), c, 1) for d, x, c in rows],
        "symbol string, date date, sentiment_compound double, sentiment_positive double, sentiment_negative double,"
        " confidence double, article_count bigint",
    )


def market(spark, days, symbol="A"):
    return spark.createDataFrame([(symbol, day(d)) for d in days], "symbol string, date date")


def test_decay_is_frozen_between_articles(spark):
    daily = sentiment(spark, [(0, 0.5, 0.8), (3, -0.2, 0.6), (7, 0.4, 0.9)])
    got = column(decay.decay_features(market(spark, [0, 2, 3, 6, 7, 20]), daily, {5: 0.1}), "sentiment_decay_5d_compound")
    assert got == approx([0.5, 0.5, 0.264747, 0.264747, 0.345987, 0.345987])


def test_decay_before_the_first_article_and_without_news_is_zero(spark):
    daily = sentiment(spark, [(5, 0.5, 0.8)])
    m = market(spark, [0, 4]).unionByName(market(spark, [3], "QUIET"))
    got = decay.all_decay_features(m, daily)
    for r in got.collect():
        assert r.sentiment_decay_5d_compound == 0.0 and r.confidence_mean == 0.5 and r.sentiment_volatility_5d == 0.0


def test_decay_over_decades_neither_overflows_nor_vanishes(spark):
    daily = sentiment(spark, [(i * 9, 0.1 if i % 2 else 0.3, 0.9) for i in range(1200)])
    got = column(decay.decay_features(market(spark, [9 * 1199, 9 * 1199 + 4000]), daily), "sentiment_decay_5d_compound")
    assert 0.1 < got[0] < 0.3 and got[0] == got[1]


def test_slope_over_positions(spark):
    daily = sentiment(spark, [(0, 0.1, 0.9), (1, 0.2, 0.9), (2, 0.4, 0.9)])
    got = decay.sentiment_dynamics(market(spark, [2]), daily).first()
    assert got.sentiment_momentum_3d == pytest.approx(0.15)
    flat = sentiment(spark, [(0, 0.1, 0.9), (1, 0.1, 0.9)])
    assert decay.sentiment_dynamics(market(spark, [1]), flat).first().sentiment_momentum_3d == 0.0


def test_windowed_decay_uses_both_blocks(spark):
    rows = [(d, 0.01 * (d % 50), 0.9) for d in range(0, 700, 3)]
    days = list(range(10, 700, 7))
    got = column(decay.windowed_decay(market(spark, days), sentiment(spark, rows)), "sentiment_decay_90d")
    import math

    for d, value in zip(days, got):
        seen = [(x, math.exp(-0.05 * (d - t)) * c) for t, x, c in rows if d - 60 <= t <= d]
        want = sum(x * w for x, w in seen) / sum(w for _, w in seen) if len(seen) >= 3 else 0.0
        assert value == pytest.approx(want, abs=1e-9)


def test_recursive_decay_matches_the_loop(spark):
    rows = [(i, ((i * 7) % 13 - 6) / 10, 0.8) for i in range(200)]
    got = column(decay.recursive_decay(sentiment(spark, rows), "sentiment_compound"), "sentiment_decay_2d")
    y, want = 0.0, []
    for _, x, _ in rows:
        y = x + y * 2 ** -0.5
        want.append(y)
    assert got == approx(want)


def test_asof_attach_keeps_every_left_row(spark):
    right = market(spark, [3]).withColumn("v", F.lit(1.5))
    got = windows.asof_attach(market(spark, [1, 3, 9]), right, ["v"])
    assert column(got, "v") == [None, 1.5, 1.5]


def test_combined_indicators_equal_the_single_ones(spark):
    from catalog.base import bars

    from .conftest import SF_DIR

    b = bars(spark, SF_DIR).cache()
    whole = ind.add_indicators(b, fill=False).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    for step in (
        ind.returns, ind.exponential_averages, ind.vwap, ind.bollinger, ind.rsi, ind.macd, ind.simple_averages, ind.volatility,
        ind.true_range_average, ind.stochastic, ind.rate_of_change, ind.volume_features, ind.price_shape,
    ):
        one = step(b).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
        for c in [c for c in one.columns if c not in b.columns]:
            pd.testing.assert_series_equal(one[c], whole[c], check_exact=False, rtol=1e-9, atol=1e-9)
    for c in ind.LAG_COLUMNS:
        for k in ind.LAG_STEPS:
            want = whole.groupby("symbol")[c].shift(k).astype(float)
            pd.testing.assert_series_equal(whole[f"{c}_lag_{k}"].astype(float), want, check_names=False)


def test_a_gap_keeps_the_exponential_mean(spark):
    from tapeloom.operators.windows import ewm_mean

    xs = [None, 1.0, 1.0, None, 1.0, 4.0, None, None, 2.0]
    df = spark.createDataFrame([("A", day(i), x) for i, x in enumerate(xs)], "symbol string, date date, x double")
    got = column(ewm_mean(df, {"m": ("x", 0.5, 1)}), "m")
    assert got == [None] + [pytest.approx(v) for v in (1, 1, 1, 1, 2.5, 2.5, 2.5, 2.25)]
