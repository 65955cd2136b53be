"""Distances from events, windows around them, and how returns behave there.

Events (earnings days, meetings, orders) are reduced to distinct days per key first, so an event table of any skew becomes
panel rows, and windows per symbol stay bounded by the calendar.  Nothing here joins on ranges: distances are carried along
the stacked series in both directions, and windows around events meet the panel on row numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import day_number
from .windows import series

# ---- fixed values ----
ROWS_BEFORE, ROWS_AFTER = 5, 10
DAYS_BEFORE, DAYS_AFTER = 5, 5
# ---- end of fixed values ----


def event_days(events: DataFrame, key: str = "symbol", date: str = "date", kind: str | None = None) -> DataFrame:
    """Distinct ``symbol, date`` (and ``kind``) with the number of ``events``; rows without symbol or date are no events."""
    keys = [F.col(key).alias("symbol"), F.col(date).cast("date").alias("date"), *([F.col(kind).alias("kind")] if kind else [])]
    named = events.select(*keys).filter("symbol IS NOT NULL AND date IS NOT NULL")
    return named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("events"))


def _stacked(panel: DataFrame, days: DataFrame) -> DataFrame:
    """Panel rows and event days on one clock; ``__event`` is the day number of an event row."""
    marked = days.withColumn("__event", day_number()).withColumn("__row", F.lit(False))
    return panel.withColumn("__row", F.lit(True)).unionByName(marked, allowMissingColumns=True).withColumn("__day", day_number())


def attach_event_distance(panel: DataFrame, days: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``days_since_event`` and ``days_until_event`` in calendar days, 0 on the day itself, NULL without such an event.

    ``days`` comes from :func:`event_days`.  With ``kinds`` there are two columns per kind, ``days_since_<kind>`` and
    ``days_until_<kind>``.  Both directions look from the first row on (the second one in falling order): a frame that
    ends at the last row would be added up again for every row.
    """
    of = {"event": F.col("__event")} if kinds is None else {k: F.when(F.col("kind") == k, F.col("__event")) for k in kinds}
    slim = days.select("symbol", "date", *(["kind"] if kinds is not None else []))
    back = Window.partitionBy("symbol").orderBy("__day").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("symbol").orderBy(F.desc("__day")).rangeBetween(Window.unboundedPreceding, 0)
    made = _stacked(panel, slim).withColumns({f"days_since_{k}": F.col("__day") - F.max(c).over(back) for k, c in of.items()})
    made = made.withColumns({f"days_until_{k}": F.min(c).over(ahead) - F.col("__day") for k, c in of.items()})
    return made.filter("__row").select(*panel.columns, *[f"days_{way}_{k}" for k in of for way in ("since", "until")])


def attach_market_event_distance(panel: DataFrame, dates: DataFrame, name: str = "event") -> DataFrame:
    """The same for events of the whole market (a table with ``date``), found once per distinct date of the panel."""
    own = panel.select(F.col("date").cast("date").alias("date")).distinct().withColumn("symbol", F.lit(""))  # one series, at most a row a calendar day
    days = event_days(dates.withColumn("__all", F.lit("")), "__all")
    far = attach_event_distance(own, days).select("date", F.col("days_since_event").alias(f"days_since_{name}"), F.col("days_until_event").alias(f"days_until_{name}"))
    return panel.join(F.broadcast(far.withColumnRenamed("date", "__date")), F.col("date").cast("date") == F.col("__date"), "left").drop("__date")


def attach_event_overlap(panel: DataFrame, days: DataFrame, before: int = DAYS_BEFORE, after: int = DAYS_AFTER) -> DataFrame:
    """``events_around``: how many event windows, ``before`` days ahead of an event to ``after`` days behind it, cover a row's date."""
    over = Window.partitionBy("symbol").orderBy("__day").rangeBetween(-after, before)
    made = _stacked(panel, days.select("symbol", "date", "events")).withColumn("events_around", F.coalesce(F.sum("events").over(over), F.lit(0)))
    return made.filter("__row").select(*panel.columns, "events_around")


def event_windows(panel: DataFrame, days: DataFrame, before: int = ROWS_BEFORE, after: int = ROWS_AFTER) -> DataFrame:
    """Panel rows around each event day: ``event_date, offset`` and the row, offset 0 being the first row on or after the day.

    ``before`` rows ahead to ``after`` rows behind, as far as the series goes; an event behind the last row has no window.  A
    row lies in every window that covers it.
    """
    numbered = panel.withColumn("__n", F.row_number().over(series()))
    ahead = Window.partitionBy("symbol").orderBy(F.desc("__day")).rangeBetween(Window.unboundedPreceding, 0)
    stacked = _stacked(numbered.select("symbol", "date", "__n"), days.select("symbol", "date")).withColumn("__at", F.min("__n").over(ahead))
    anchors = stacked.filter(~F.col("__row") & F.col("__at").isNotNull()).select("symbol", F.col("date").alias("event_date"), "__at")
    placed = anchors.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("__n", F.col("__at") + F.col("offset"))
    joined = placed.join(numbered, ["symbol", "__n"])
    return joined.select("symbol", "event_date", "offset", *[c for c in panel.columns if c != "symbol"])


def event_study(windows: DataFrame, value: str, offset: str = "offset") -> DataFrame:
    """Per offset: ``rows``, mean and deviation of ``value``, its t-value, and the means added up from the first offset on."""
    made = windows.groupBy(offset).agg(F.count(value).alias("rows"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
    t = F.col("mean") / F.nullif(F.col("deviation") / F.sqrt("rows"), F.lit(0.0))
    upto = Window.orderBy(offset).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row an offset
    return made.withColumns({"t_value": t, "cumulated": F.sum("mean").over(upto)})


def abnormal(panel: DataFrame, value: str) -> Column:
    """The value of a row less the mean of all symbols on its date, as a column over ``panel``'s date."""
    return F.col(value) - F.avg(value).over(Window.partitionBy("date"))
