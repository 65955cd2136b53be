"""Technical indicators, lags, horizon returns and time indices of daily bars.

Input: panel rows with ``symbol, date, open, high, low, close, volume``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import add_calendar
from ..functions.numeric import eps_ratio, finite, flag, ratio
from .windows import ewm_mean, exp_scan, rolling, running, series, trailing, whole

# ---- fixed values: indicator parameters ----
EMA_SPANS = [5, 10, 20, 30, 50]
SMA_SPANS = [5, 10, 20, 50]
RSI_PERIODS = [6, 14, 21]
ROC_PERIODS = [5, 10, 20]
BOLLINGER_ROWS, BOLLINGER_WIDTH = 20, 2.0
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
ATR_ROWS = 14
STOCHASTIC_ROWS, STOCHASTIC_SMOOTH = 14, 3
VOLUME_ROWS, VOLUME_FAST_ROWS = 20, 5
VOLATILITY_ROWS = 20
LAG_COLUMNS = ["close", "volume", "returns", "vwap", "rsi_14"]
LAG_STEPS = [1, 2, 3, 5, 10]
HORIZONS = [5, 22, 90]
PRIMARY_HORIZON = 5
# ---- end of fixed values ----


Columns = dict[str, Column]


def previous(c: str, k: int = 1) -> Column:
    return F.lag(c, k).over(series())


# Column groups.  A group is a pair: window columns that depend only on the bars,
# and plain expressions over them.  The window columns of all groups are added
# together, so they share one pass; each window expression is written once,
# because the planner does not merge repeated ones.  Bars carry no NULLs, so a
# full window is told by the row number.


def _full(agg, column: str, rows: int) -> Column:
    return F.when(F.row_number().over(series()) >= rows, agg(F.col(column)).over(trailing(rows)))


def return_columns() -> Columns:
    return {"returns": ratio(F.col("close"), previous("close")) - 1.0}


def vwap_columns() -> Columns:
    """Volume-weighted price over the whole history; rows without volume repeat the last one."""
    price = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    volume = F.nullif(F.col("volume").cast("double"), F.lit(0.0))
    w = running()
    # A row without volume adds nothing to either sum, which is the carried-forward value.
    return {"vwap": F.coalesce(F.sum(price * volume).over(w) / F.sum(volume).over(w), price)}


def bollinger_columns(rows: int = BOLLINGER_ROWS, width: float = BOLLINGER_WIDTH) -> tuple[Columns, Columns]:
    middle, spread = F.col("bb_middle"), F.col("__sd") * width
    windows = {"bb_middle": _full(F.avg, "close", rows), "__sd": _full(F.stddev_pop, "close", rows)}
    return windows, {
        "bb_upper": middle + spread,
        "bb_lower": middle - spread,
        "bb_width": ratio(spread * 2.0, middle),
        "bb_position": ratio(F.col("close") - (middle - spread), spread * 2.0),
    }


def move_columns() -> Columns:
    move = F.col("close") - previous("close")
    return {"__up": F.when(move > 0, move).otherwise(0.0), "__down": F.when(move < 0, -move).otherwise(0.0)}


def simple_average_columns(spans: list[int] = SMA_SPANS) -> Columns:
    return {f"sma_{n}": _full(F.avg, "close", n) for n in spans}


def true_range_columns() -> Columns:
    before = previous("close")
    high, low = F.col("high"), F.col("low")
    return {"__tr": F.greatest(high - low, F.abs(high - before), F.abs(low - before))}


def stochastic_columns(rows: int = STOCHASTIC_ROWS) -> tuple[Columns, Columns]:
    low, high = F.col("__lowest"), F.col("__highest")
    windows = {"__lowest": _full(F.min, "low", rows), "__highest": _full(F.max, "high", rows)}
    return windows, {
        "stoch_k": ratio(F.col("close") - low, high - low) * 100.0,
        "williams_r": ratio(high - F.col("close"), high - low) * -100.0,
    }


def rate_of_change_columns(periods: list[int] = ROC_PERIODS) -> Columns:
    return {f"roc_{n}": (ratio(F.col("close"), previous("close", n)) - 1.0) * 100.0 for n in periods}


def volume_columns() -> tuple[Columns, Columns]:
    slow = f"volume_sma_{VOLUME_ROWS}"
    windows = {slow: _full(F.avg, "volume", VOLUME_ROWS), "__fast_volume": _full(F.avg, "volume", VOLUME_FAST_ROWS)}
    return windows, {
        "volume_ratio": eps_ratio(F.col("volume").cast("double"), F.col(slow)),
        "volume_trend": eps_ratio(F.col("__fast_volume"), F.col(slow)),
    }


def price_shape_columns() -> tuple[Columns, Columns]:
    o, h, low, c, before = (F.col(x) for x in ("open", "high", "low", "close", "__before"))
    return {"__before": previous("close")}, {
        "price_position": ratio(c - low, h - low),
        "gap": eps_ratio(o - before, before),
        "intraday_return": eps_ratio(c - o, o),
    }


def _with_group(df: DataFrame, *groups: tuple[Columns, Columns]) -> DataFrame:
    windows = {n: c for g in groups for n, c in g[0].items()}
    plain = {n: c for g in groups for n, c in g[1].items()}
    return df.withColumns(windows).withColumns(plain)


def second_layer_columns(df: DataFrame) -> Columns:
    """Windows over first-layer columns: volatility, average true range, smoothed stochastic."""
    out: Columns = {}
    if "returns" in df.columns:
        out["log_returns"] = F.log1p("returns")
        out["volatility_20d"] = rolling(F.stddev_samp, F.col("returns"), VOLATILITY_ROWS)
    if "__tr" in df.columns:
        out["atr"] = rolling(F.avg, F.col("__tr"), ATR_ROWS)
    if "stoch_k" in df.columns:
        out["stoch_d"] = rolling(F.avg, F.col("stoch_k"), STOCHASTIC_SMOOTH)
    return out


def ema_specs(spans: list[int] = EMA_SPANS) -> dict:
    return {f"ema_{n}": ("close", 2.0 / (n + 1), n) for n in spans}


def rsi_specs(periods: list[int] = RSI_PERIODS) -> dict:
    return {f"__{side}_{n}": (f"__{side}", 1.0 / n, n) for n in periods for side in ("up", "down")}


def macd_specs() -> dict:
    return {
        "__fast": ("close", 2.0 / (MACD_FAST + 1), MACD_FAST),
        "__slow": ("close", 2.0 / (MACD_SLOW + 1), MACD_SLOW),
    }


def rsi_columns(periods: list[int] = RSI_PERIODS) -> Columns:
    """100 where nothing fell."""
    return {
        f"rsi_{n}": F.when(F.col(f"__down_{n}") == 0, 100.0).otherwise(
            100.0 - 100.0 / (1.0 + ratio(F.col(f"__up_{n}"), F.col(f"__down_{n}")))
        )
        for n in periods
    }


def _macd_from_means(df: DataFrame) -> DataFrame:
    df = ewm_mean(df, {"macd_signal": ("macd_line", 2.0 / (MACD_SIGNAL + 1), MACD_SIGNAL)})
    return df.withColumn("macd_diff", F.col("macd_line") - F.col("macd_signal"))


def _visible(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def lag_columns(columns: list[str] = LAG_COLUMNS, steps: list[int] = LAG_STEPS) -> Columns:
    return {f"{c}_lag_{k}": previous(c, k) for c in columns for k in steps}


# Single indicators.


def returns(df: DataFrame) -> DataFrame:
    return df.withColumns(return_columns()).withColumn("log_returns", F.log1p("returns"))


def exponential_averages(df: DataFrame, spans: list[int] = EMA_SPANS) -> DataFrame:
    return ewm_mean(df, ema_specs(spans))


def vwap(df: DataFrame) -> DataFrame:
    return df.withColumns(vwap_columns())


def bollinger(df: DataFrame) -> DataFrame:
    return _visible(_with_group(df, bollinger_columns()))


def rsi(df: DataFrame, periods: list[int] = RSI_PERIODS) -> DataFrame:
    """Relative strength with Wilder smoothing."""
    return _visible(ewm_mean(df.withColumns(move_columns()), rsi_specs(periods)).withColumns(rsi_columns(periods)))


def macd(df: DataFrame) -> DataFrame:
    means = ewm_mean(df, macd_specs()).withColumn("macd_line", F.col("__fast") - F.col("__slow"))
    return _visible(_macd_from_means(means))


def simple_averages(df: DataFrame, spans: list[int] = SMA_SPANS) -> DataFrame:
    return df.withColumns(simple_average_columns(spans))


def volatility(df: DataFrame) -> DataFrame:
    df = df.withColumns(return_columns())
    return df.withColumn("volatility_20d", rolling(F.stddev_samp, F.col("returns"), VOLATILITY_ROWS))


def true_range_average(df: DataFrame) -> DataFrame:
    df = df.withColumns(true_range_columns())
    return _visible(df.withColumn("atr", rolling(F.avg, F.col("__tr"), ATR_ROWS)))


def stochastic(df: DataFrame) -> DataFrame:
    df = _visible(_with_group(df, stochastic_columns()))
    return df.withColumn("stoch_d", rolling(F.avg, F.col("stoch_k"), STOCHASTIC_SMOOTH))


def rate_of_change(df: DataFrame, periods: list[int] = ROC_PERIODS) -> DataFrame:
    return df.withColumns(rate_of_change_columns(periods))


def volume_features(df: DataFrame) -> DataFrame:
    return _visible(_with_group(df, volume_columns()))


def price_shape(df: DataFrame) -> DataFrame:
    return _visible(_with_group(df, price_shape_columns()))


def lagged(df: DataFrame, columns: list[str] = LAG_COLUMNS, steps: list[int] = LAG_STEPS) -> DataFrame:
    return df.withColumns(lag_columns([c for c in columns if c in df.columns], steps))


def technical_columns(df: DataFrame) -> list[str]:
    base = {"symbol", "stock_id", "date", "open", "high", "low", "close", "volume"}
    return [c for c in df.columns if c not in base]


def add_indicators(df: DataFrame, fill: bool = True) -> DataFrame:
    """Every indicator and lag; non-finite values become NULL and are then carried forward.

    Two exponential scans and three layers of plain windows, all on one hash
    partitioning by symbol.  The scans sort the rows several times, so they come
    first, while a row holds little more than the bar.  Remaining NULLs (the start of each series) are left
    for the imputation step, whose medians are fitted on training rows only.
    """
    before = set(df.columns)
    df = ewm_mean(df.withColumns(move_columns()), {**ema_specs(), **rsi_specs(), **macd_specs()})
    df = df.withColumns({**rsi_columns(), "macd_line": F.col("__fast") - F.col("__slow")})
    df = _macd_from_means(_visible(df))
    smoothed = [c for c in df.columns if c not in before]
    plain_windows = {
        **return_columns(), **vwap_columns(), **simple_average_columns(),
        **true_range_columns(), **rate_of_change_columns(),
    }
    df = _with_group(
        df, (plain_windows, {}), bollinger_columns(), stochastic_columns(), volume_columns(), price_shape_columns()
    )
    df = _visible(df.withColumns(second_layer_columns(df)))
    df = df.select(*[c for c in df.columns if c not in smoothed], *smoothed).withColumns(lag_columns())
    added = [c for c in df.columns if c not in before]
    if not fill:
        return df.withColumns({c: finite(c) for c in added})
    w = running()
    return df.withColumns({c: F.last(finite(c), ignorenulls=True).over(w) for c in added})


def horizon_returns(df: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """Trailing returns over each horizon, plus copy, log and direction of the primary one."""
    out = {f"target_{h}d": ratio(F.col("close"), previous("close", h)) - 1.0 for h in horizons}
    if PRIMARY_HORIZON in horizons:
        change = ratio(F.col("close"), previous("close", PRIMARY_HORIZON))
        out["target_5"] = change - 1.0
        out["target_5_log"] = F.ln(change)
        out["target_5_direction"] = flag(change - 1.0 > 0)
    return df.withColumns(out)


def forward_returns(df: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """True labels: the return over the next ``h`` rows, NULL at the end of a series."""
    return df.withColumns(
        {f"label_{h}d": ratio(F.lead("close", h).over(series()), F.col("close")) - 1.0 for h in horizons}
    )


def drop_warmup(df: DataFrame, rows: int = max(HORIZONS)) -> DataFrame:
    """Remove the first ``rows`` rows of every symbol; shorter symbols disappear."""
    return df.withColumn("__row", F.row_number().over(series())).filter(F.col("__row") > rows).drop("__row")


def time_index(df: DataFrame) -> DataFrame:
    """Zero-based row of the symbol, running trading day of the month, days since the first date."""
    month = Window.partitionBy("symbol", F.year("date"), F.month("date")).orderBy("date")
    first = df.agg(F.min("date")).scalar()
    return df.withColumns(
        {
            "time_idx": F.row_number().over(series()) - 1,
            "trading_day_of_month": F.row_number().over(month),
            "days_since_start": F.datediff("date", first),
        }
    )


def add_time_features(df: DataFrame) -> DataFrame:
    return time_index(add_calendar(df))


def base_100(df: DataFrame) -> DataFrame:
    start = F.first("close").over(series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("close_base100", ratio(F.col("close"), start) * 100.0)


def sentiment_averages(df: DataFrame, spans: tuple[int, ...] = (3, 7, 14)) -> DataFrame:
    """Short means of daily compound that start with the first row."""
    return df.withColumns(
        {f"sentiment_ma_{n}d": rolling(F.avg, F.col("sentiment_compound"), n, need=1) for n in spans}
    )


def smooth_sentiment(df: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Weighted exponential mean of compound over rows; the raw value is kept beside it.

    A row without a value has no weight and keeps the mean of the rows before it;
    before the first value there is none.
    """
    rate = -math.log(1.0 - alpha)
    raw = F.col("sentiment_original")
    df = df.withColumns({"sentiment_original": F.col("sentiment_compound"), "__row": F.row_number().over(series())})
    weight = F.when(raw.isNotNull(), F.lit(1.0))
    df = exp_scan(df, {"__num": (raw, rate), "__den": (weight, rate)}, F.col("__row"))
    mean = F.when(raw.isNotNull(), F.col("__num") / F.nullif(F.col("__den"), F.lit(0.0)))
    return df.withColumns(
        {
            "sentiment_compound": F.last(mean, ignorenulls=True).over(running()),
            "smoothed": F.count(F.lit(1)).over(whole()) > 1,
        }
    ).drop("__row", "__num", "__den")
