"""Calendar columns of a trading date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .numeric import flag


def day_number(date: str | Column = "date") -> Column:
    """Days since 1970-01-01 as int: the clock of calendar-day frames."""
    d = F.col(date) if isinstance(date, str) else date
    return F.unix_date(d.cast("date"))


def _cycle(name: str, x: Column, period: float) -> dict[str, Column]:
    angle = F.lit(2.0) * F.pi() * x / F.lit(period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def calendar_columns(date: str = "date") -> dict[str, Column]:
    d = F.col(date).cast("date")
    month_end = d == F.last_day(d)
    parts = {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "day_of_week": F.weekday(d),  # Monday = 0
        "quarter": F.quarter(d),
        "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
        "is_month_end": flag(month_end),
        "is_month_start": flag(F.dayofmonth(d) == 1),
        "is_quarter_end": flag(month_end & (F.month(d) % 3 == 0)),
        "is_year_end": flag((F.month(d) == 12) & (F.dayofmonth(d) == 31)),
        "is_weekday": flag(F.weekday(d) < 5),
        "is_weekend": flag(F.weekday(d) >= 5),
    }
    parts.update(_cycle("month", F.month(d), 12.0))
    parts.update(_cycle("day_of_week", F.weekday(d), 7.0))
    parts.update(_cycle("day_of_year", F.dayofyear(d), 365.25))
    return parts


def add_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(calendar_columns(date))
