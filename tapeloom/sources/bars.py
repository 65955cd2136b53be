"""Daily bars from trades, bar normalisation and the symbol dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import total
from ..operators.positions import dense_positions

BAR_COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume"]


#: Decimal digits that one order number can hold, and those of a plain long.
ORDER_DIGITS, LONG_DIGITS = 38, 18


def order_number(order: list[tuple[str, int]]) -> Column:
    """The integral order columns of a trade as one number, the first column counting most.

    Each column comes with the digits it may need; a negative or longer value is an
    error, never a wrong order.  One number keeps the aggregation buffers fixed in
    size, so trades are reduced in a hash table without being sorted first.  It is a
    long where the digits fit one, else a decimal put together by arithmetic.
    """
    digits = sum(d for _, d in order)
    if digits > ORDER_DIGITS:
        raise ValueError(f"order columns need more than {ORDER_DIGITS} digits")
    parts, behind = [], digits
    for name, width in order:
        value = F.col(name).cast("bigint")
        fits = value.between(0, 10**width - 1) if width <= LONG_DIGITS else value >= 0
        value = F.when(fits, value).when(value.isNotNull(), F.raise_error(F.lit(f"{name} does not fit {width} digits")))
        behind -= width
        if digits <= LONG_DIGITS:
            parts.append(value * 10**behind)
        else:
            step = F.lit("1" + "0" * behind).cast(f"decimal({behind + 1},0)")
            parts.append((value.cast(f"decimal({width},0)") * step).cast(f"decimal({ORDER_DIGITS},0)"))
    number = total(parts)
    return number if digits <= LONG_DIGITS else number.cast(f"decimal({ORDER_DIGITS},0)")


def daily_bars(
    trades: DataFrame, symbol: Column, time: Column, price: Column, size: Column, order: list[tuple[str, int]]
) -> DataFrame:
    """One open/high/low/close/volume row per symbol and day.

    ``order`` (see :func:`order_number`) must totally order the trades of a day.
    Every aggregate is a partial hash aggregate, so a day or symbol with a huge
    number of trades is reduced before the shuffle, and the result is unique per
    ``(symbol, date)``.
    """
    rank = F.col("__o")
    return (
        trades.select(
            symbol.alias("symbol"), time.cast("date").alias("date"), price.alias("__p"), size.alias("__v"), order_number(order).alias("__o")
        )
        .groupBy("symbol", "date")
        .agg(
            F.min_by("__p", rank).alias("open"),
            F.max("__p").alias("high"),
            F.min("__p").alias("low"),
            F.max_by("__p", rank).alias("close"),
            F.sum("__v").cast("bigint").alias("volume"),
        )
    )


def normalise_bars(raw: DataFrame) -> DataFrame:
    """Lower-case names, ``date`` without time zone, corporate-action columns dropped."""
    named = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    named = named.drop("dividends", "stock_splits", "capital_gains")
    return named.withColumn("date", F.to_date("date"))


def with_min_observations(bars: DataFrame, least: int = 100) -> DataFrame:
    """Rows of the symbols that have at least ``least`` rows."""
    enough = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    return bars.join(enough, "symbol", "left_semi")


def collect_bars(frames: list[DataFrame], least: int = 100) -> DataFrame:
    """Union of bar tables read separately, short symbols dropped."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return with_min_observations(out, least)


def symbol_dimension(bars: DataFrame) -> DataFrame:
    """``symbol -> stock_0001...`` by rank of the sorted symbols."""
    symbols = bars.select("symbol").distinct()
    ranked = dense_positions(symbols, "symbol")
    return ranked.select("symbol", F.format_string("stock_%04d", F.col("position")).alias("stock_id"))


def tag_stock_id(bars: DataFrame) -> DataFrame:
    """Bars with their ``stock_id``; the planner broadcasts the dimension when it is small."""
    return bars.join(symbol_dimension(bars), "symbol")
