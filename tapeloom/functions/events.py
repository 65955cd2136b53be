"""Dates that follow from rules: market holidays, option expiration, ends of quarters and years, reporting seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .numeric import flag

# ---- fixed values: rules of the holiday calendar ----
MONDAY, THURSDAY, FRIDAY = 0, 3, 4
#: Month, day and first year of holidays on a date; on a Sunday they are kept on the Monday behind, on a Saturday (but for
#: New Year) on the Friday before.
FIXED = [(1, 1, 1900), (6, 19, 2022), (7, 4, 1900), (12, 25, 1900)]
#: Month, weekday, which one of the month, and first year.
FLOATING = [(1, MONDAY, 3, 1998), (2, MONDAY, 3, 1900), (9, MONDAY, 1, 1900), (11, THURSDAY, 4, 1900)]
LAST_MONDAY_OF = 5
REPORTING_DAYS = (10, 45)
# ---- end of fixed values ----


def _day(year: Column, month: int, day: int = 1) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def nth_weekday(first: Column, weekday: int, n: int) -> Column:
    """The n-th such weekday (Monday 0) of the month that starts at ``first``."""
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar."""
    div = lambda a, b: F.floor(a / b).cast("int")
    century, golden = div(year, 100), year % 19
    leap = century - div(century, 4) - div(8 * century + 13, 25)
    epact = (leap + 19 * golden + 15) % 30
    moon = epact - div(epact, 28) * (1 - div(epact, 28) * div(F.lit(29), epact + 1) * div(21 - golden, 11))
    weekday = (year + div(year, 4) + moon + 2 - century + div(century, 4)) % 7
    return F.date_add(_day(year, 3, 28), (moon - weekday).cast("int"))


def market_holidays(year: Column) -> Column:
    """Weekdays of a year on which the market rests, as an array of dates."""
    days = []
    for month, day, since in FIXED:
        d = _day(year, month, day)
        shifted = F.when(F.weekday(d) == 6, F.date_add(d, 1)).when(F.weekday(d) == 5, None if month == 1 else F.date_add(d, -1)).otherwise(d)
        days.append(F.when(year >= since, shifted))
    days += [F.when(year >= since, nth_weekday(_day(year, month), weekday, n)) for month, weekday, n, since in FLOATING]
    end = F.last_day(_day(year, LAST_MONDAY_OF))
    days += [F.date_add(end, -F.weekday(end)), F.date_add(easter(year), -2)]
    return F.array_compact(F.array(*days))


def option_expiration(date: Column) -> Column:
    """The third Friday of a date's month, or the day before it on a holiday."""
    third = nth_weekday(F.trunc(date, "month"), FRIDAY, 3)
    return F.when(F.array_contains(market_holidays(F.year(date)), third), F.date_add(third, -1)).otherwise(third)


def event_columns(date: str = "date") -> dict[str, Column]:
    d = F.col(date).cast("date")
    year = F.year(d)
    holidays = F.concat(market_holidays(year - 1), market_holidays(year), market_holidays(year + 1))
    expires = option_expiration(d)
    then = F.when(expires >= d, expires).otherwise(option_expiration(F.add_months(F.trunc(d, "month"), 1)))
    quarter = F.trunc(d, "quarter")
    return {
        "is_market_holiday": flag(F.array_contains(holidays, d)),
        "days_since_holiday": F.datediff(d, F.array_max(F.filter(holidays, lambda h: h <= d))),
        "days_until_holiday": F.datediff(F.array_min(F.filter(holidays, lambda h: h >= d)), d),
        "is_option_expiration": flag(expires == d),
        "days_until_expiration": F.datediff(then, d),
        "is_earnings_season": flag(F.datediff(d, quarter).between(*REPORTING_DAYS)),
        "days_until_quarter_end": F.datediff(F.add_months(quarter, 3), d) - 1,
        "days_until_year_end": F.datediff(_day(year, 12, 31), d),
    }


def add_event_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """The columns above, found once per distinct date (the calendar bounds the broadcast side)."""
    days = df.select(F.col(date).cast("date").alias("__date")).filter("__date IS NOT NULL").distinct()
    made = days.select("__date", *[c.alias(n) for n, c in event_columns("__date").items()])
    return df.join(F.broadcast(made), F.col(date).cast("date") == F.col("__date"), "left").drop("__date")
