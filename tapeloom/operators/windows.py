"""Frames over a symbol's series, the exponential scan and the as-of attach.

All windows here run on panel rows (unique per ``(symbol, date)``), so one
window partition is bounded by the calendar, not by the size of the data.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.calendar import day_number

#: Largest exponent inside one block of a scan, and the exponent beyond which a
#: contribution is below the resolution of a double (exp(-40) = 4e-18).
BLOCK, NEGLIGIBLE = 160.0, 40.0
#: Panel rows of a task: the sorts of a row with all indicators take about 7 KB of its memory together.
TASK_ROWS = 100_000


def series(key: str = "symbol", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def trailing(n: int, key: str = "symbol", order: str = "date") -> WindowSpec:
    """The current row and the ``n - 1`` rows before it."""
    return series(key, order).rowsBetween(-(n - 1), Window.currentRow)


def running(key: str = "symbol", order: str = "date") -> WindowSpec:
    return series(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(key: str = "symbol") -> WindowSpec:
    return Window.partitionBy(key)


def trailing_days(days: int, key: str = "symbol", day: str = "day_no") -> WindowSpec:
    """Rows of the last ``days`` calendar days, the current day included."""
    return Window.partitionBy(key).orderBy(day).rangeBetween(-(days - 1), 0)


def rolling(agg, x: Column, n: int, need: int | None = None, **spec: str) -> Column:
    """``agg(x)`` over ``n`` rows, NULL until ``need`` (default ``n``) values are present."""
    w = trailing(n, **spec)
    need = n if need is None else need
    return F.when(F.count(x).over(w) >= need, agg(x).over(w))


def dealt(df: DataFrame, rows: int, key: str = "symbol") -> DataFrame:
    """Series dealt to tasks of about ``TASK_ROWS`` rows, however many there are; ``rows`` is their number or one above it.

    The windows below run where the rows lie then.  Left alone, a partition is judged by the size of the bars, not by
    the twenty times wider rows that are sorted, and a fixed number of partitions grows with the table.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(parts, key)


def forward_fill(df: DataFrame, columns: list[str], key: str = "symbol", order: str = "date") -> DataFrame:
    """Last known value within the symbol; never looks ahead."""
    w = running(key, order)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def exp_scan(
    df: DataFrame, terms: Mapping[str, tuple[Column, float]], clock: Column, key: str = "symbol"
) -> DataFrame:
    """Add ``y_t = sum over i <= t of value_i * exp(-rate * (clock_t - clock_i))`` per term.

    ``terms`` maps an output name to ``(value, rate)``; ``clock`` must not decrease
    along a series.  The clock is cut into blocks no longer than ``BLOCK / rate``.
    Inside a block the exponent stays in double range; earlier blocks enter as
    carry terms until their weight is negligible.  All terms share the same two
    windows on the hash partitioning by ``key``: one sort, no extra shuffle.
    """
    rates = [rate for _, rate in terms.values()]
    width = BLOCK / max(rates)
    carries = range(1, math.ceil(NEGLIGIBLE / (min(rates) * width)) + 1)
    s, b = "__clock", "__block"
    df = df.withColumn(s, clock.cast("double")).withColumn(b, F.floor(F.col(s) / width))
    df = df.withColumn("__within", F.col(s) - F.col(b) * width)
    df = df.withColumns(
        {
            f"__scaled_{n}": F.coalesce(v.cast("double"), F.lit(0.0)) * F.exp(F.col("__within") * rate)
            for n, (v, rate) in terms.items()
        }
    )
    inside = Window.partitionBy(key, b).orderBy(s).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = {j: Window.partitionBy(key).orderBy(b).rangeBetween(-j, -j) for j in carries}
    sums = {f"__in_{n}": F.sum(f"__scaled_{n}").over(inside) for n in terms}
    df = df.withColumns(sums).withColumns(
        {f"__pre{j}_{n}": F.sum(f"__scaled_{n}").over(w) for n in terms for j, w in earlier.items()}
    )
    out = {}
    for n, (_, rate) in terms.items():
        y = F.col(f"__in_{n}")
        for j in carries:
            y = y + F.coalesce(F.col(f"__pre{j}_{n}"), F.lit(0.0)) * math.exp(-rate * width * j)
        out[n] = y * F.exp(F.col("__within") * -rate)
    helpers = [s, b, "__within"]
    for n in terms:
        helpers += [f"__scaled_{n}", f"__in_{n}", *(f"__pre{j}_{n}" for j in carries)]
    return df.withColumns(out).drop(*helpers)


def ewm_mean(
    df: DataFrame, specs: Mapping[str, tuple[str, float, int]], key: str = "symbol", order: str = "date"
) -> DataFrame:
    """Recursive exponential means ``y = (1-a) y' + a x`` started at the first value.

    ``specs`` maps an output name to ``(column, alpha, least number of values)``.
    NULLs are skipped: time advances with the values of a column, and a row without
    one keeps the mean of the row before it.
    """
    inputs = dict.fromkeys(c for c, _, _ in specs.values())
    seen = {c: f"__seen_{c}" for c in inputs}
    df = df.withColumns({name: F.count(c).over(running(key, order)) for c, name in seen.items()})
    for c in inputs:
        first = F.col(seen[c]) == 1
        terms = {
            n: (F.col(c) * F.when(first, F.lit(1.0)).otherwise(F.lit(alpha)), -math.log(1.0 - alpha))
            for n, (of, alpha, _) in specs.items() if of == c
        }
        df = exp_scan(df, terms, F.col(seen[c]), key)
    full = {n: F.when(F.col(seen[c]) >= need, F.col(n)) for n, (c, _, need) in specs.items()}
    return df.withColumns(full).drop(*seen.values())


def asof_attach(
    left: DataFrame,
    right: DataFrame,
    columns: list[str],
    key: str = "symbol",
    date: str = "date",
) -> DataFrame:
    """For each left row, ``columns`` of the right row with the latest date at or before it.

    Both sides are panel tables.  They are stacked, and the last known right row
    is carried along the series: one shuffle, no range join.
    """
    state = "__state"
    stacked = left.withColumns({"__is_left": F.lit(True)}).unionByName(
        right.select(key, date, F.struct(*columns).alias(state), F.lit(False).alias("__is_left")),
        allowMissingColumns=True,
    )
    w = Window.partitionBy(key).orderBy("__day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    carried = stacked.withColumn("__day", day_number(date)).withColumn(state, F.last(state, ignorenulls=True).over(w))
    return carried.filter("__is_left").select(*left.columns, *[F.col(f"{state}.{c}").alias(c) for c in columns])
