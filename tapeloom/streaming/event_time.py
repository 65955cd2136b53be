"""Bars and daily sentiment of endless tables, day by day in event time.

A watermark follows the latest event seen by ``delay``.  A row behind it is late and counts for nothing; a day ends once the
watermark passes it, is written once, and its state goes.  Copies of a row that arrive within the delay are recognised by
their id; older ids are forgotten, so state is bounded by the rows of the delay and the days still open.

Progress, state and written files are named by one checkpoint: a stream that is started again goes on behind the last
finished batch, and no day is written twice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import news
from ..sources.bars import order_number

#: How long a day waits for its rows.
DELAY = "2 days"


def _by_day(rows: DataFrame, ts: str):
    return rows.groupBy("symbol", F.window(ts, "1 day").alias("__day"))


def _dated(df: DataFrame) -> DataFrame:
    return df.select("symbol", F.to_date("__day.start").alias("date"), *[c for c in df.columns if c not in ("symbol", "__day")])


def watched(rows: DataFrame, delay: str, ids: list[str] | None = None) -> DataFrame:
    """The stream under its watermark, without a missing time ``ts`` and without copies (equal ``ids``) that arrive within the delay."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts IS NOT NULL").withWatermark("ts", delay)
    return rows.dropDuplicatesWithinWatermark(list(ids)) if ids else rows


def bars_in_event_time(trades: DataFrame, order: list[tuple[str, int]], delay: str = DELAY, ids: list[str] | None = None) -> DataFrame:
    """Daily bars of a stream of trades ``symbol, ts, price, size`` and the order columns; ``ids`` name a trade, if copies may come."""
    rows = watched(trades, delay, ids).filter("symbol IS NOT NULL AND price IS NOT NULL").withColumn("__o", order_number(order))
    return _dated(_by_day(rows, "ts").agg(
        F.min_by("price", "__o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "__o").alias("close"), F.sum("size").cast("bigint").alias("volume"),
    ))


def sentiment_in_event_time(scored: DataFrame, delay: str = DELAY, ids: list[str] | None = ("article_id",), quality: bool = False) -> DataFrame:
    """Daily sentiment of a stream of scored articles with a time ``ts``: the columns of :func:`news.daily_sentiment`."""
    weighed = news.weighed_articles(watched(scored, delay, ids), quality, keep=["symbol", "ts"]).filter("symbol IS NOT NULL")
    return _dated(_by_day(weighed, "ts").agg(*news.daily_columns(quality)))


class Written(NamedTuple):
    """What one run of a stream did: batches, rows read, rows dropped as late."""

    batches: int
    rows: int
    late: int


def write_closed_days(days: DataFrame, out: str, checkpoint: str) -> Written:
    """Append every day that is over to the table at ``out``, for all that has arrived; call again when more has."""
    query = days.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = [p for p in query.recentProgress]
    late = sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)
    return Written(len(progress), sum(p.numInputRows for p in progress), late)


def closed_days(days: DataFrame, out: str) -> DataFrame:
    """The days written so far."""
    return days.sparkSession.read.schema(days.schema).parquet(out)


def is_closed(date: Column, latest: Column, delay: str = DELAY) -> Column:
    """Whether a day is over, ``latest`` being the greatest time seen; for comparisons with whole tables."""
    return F.date_add(date, 1).cast("timestamp") <= latest - F.expr(f"interval {delay}")
