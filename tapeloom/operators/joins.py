"""Integration joins of the market panel with sentiment and split keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import day_number
from .indicators import sentiment_averages

#: Neutral sentiment of a market row without news.
NEUTRAL = {
    "sentiment_compound": 0.0, "sentiment_positive": 0.0, "sentiment_negative": 0.0, "sentiment_confidence": 0.5,
    "article_count": 0, "sentiment_ma_3d": 0.0, "sentiment_ma_7d": 0.0, "sentiment_ma_14d": 0.0, "source": "none",
}


def integration_columns(daily: DataFrame) -> DataFrame:
    """Daily sentiment under its integration names, with its short averages."""
    c = F.col("sentiment_compound")
    has = set(daily.columns)
    positive = F.col("sentiment_positive") if "sentiment_positive" in has else F.greatest(c, F.lit(0.0))
    negative = F.col("sentiment_negative") if "sentiment_negative" in has else F.greatest(-c, F.lit(0.0))
    count = F.col("article_count") if "article_count" in has else F.lit(1)
    return sentiment_averages(daily).select(
        "symbol", "date", "sentiment_compound", positive.alias("sentiment_positive"),
        negative.alias("sentiment_negative"), F.col("confidence").alias("sentiment_confidence"),
        count.cast("bigint").alias("article_count"), "sentiment_ma_3d", "sentiment_ma_7d", "sentiment_ma_14d",
        F.lit("news").alias("source"),
    )


def attach_sentiment(market: DataFrame, daily: DataFrame, fill: bool = True) -> DataFrame:
    """Left join on ``(symbol, date)``; market rows without news get the neutral values."""
    joined = market.join(integration_columns(daily), ["symbol", "date"], "left")
    return joined.fillna(NEUTRAL) if fill else joined


def join_coverage(market: DataFrame, daily: DataFrame) -> DataFrame:
    """Market rows, rows with news and their percentage per symbol, before any filling."""
    marked = daily.select("symbol", "date", F.lit(1).alias("__hit"))
    return (
        market.select("symbol", "date").join(marked, ["symbol", "date"], "left")
        .groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count("__hit").alias("matched"),
            (F.count("__hit") * 100.0 / F.count(F.lit(1))).alias("coverage_pct"),
        )
    )


def symbol_coverage(market: DataFrame, daily: DataFrame) -> DataFrame:
    """Each symbol as ``both``, ``market_only`` or ``sentiment_only``."""
    sides = market.select("symbol", F.lit(1).alias("m"), F.lit(0).alias("s")).unionByName(
        daily.select("symbol", F.lit(0).alias("m"), F.lit(1).alias("s"))
    )
    seen = sides.groupBy("symbol").agg(F.max("m").alias("m"), F.max("s").alias("s"))
    label = F.when(F.col("m") + F.col("s") == 2, "both").when(F.col("m") == 1, "market_only").otherwise("sentiment_only")
    return seen.select("symbol", label.alias("coverage"))


def assign_saved_splits(df: DataFrame, *keys: tuple[str, DataFrame]) -> DataFrame:
    """Split names from saved key tables; of several the one given last wins.

    Key tables are stacked and reduced to one row per key, so it is one join.
    """
    stacked = None
    for i, (name, table) in enumerate(keys):
        part = table.select("symbol", "date", F.lit(i).alias("__order"), F.lit(name).alias("__name"))
        stacked = part if stacked is None else stacked.unionByName(part)
    last = stacked.groupBy("symbol", "date").agg(F.max_by("__name", "__order").alias("split"))
    return df.join(last, ["symbol", "date"], "left")


def attach_features(df: DataFrame, features: DataFrame) -> DataFrame:
    """Features by ``(symbol, date)``, 0 where missing."""
    added = [c for c in features.columns if c not in ("symbol", "date")]
    return df.join(features, ["symbol", "date"], "left").fillna(0, subset=added)


def history_rows(market: DataFrame, daily: DataFrame) -> DataFrame:
    """How much sentiment history each market row can see: rows and latest date at or before it."""
    stacked = market.select("symbol", "date", F.lit(True).alias("__is_market")).unionByName(
        daily.select("symbol", "date", F.lit(False).alias("__is_market"))
    ).withColumn("__day", day_number())
    w = Window.partitionBy("symbol").orderBy("__day").rangeBetween(Window.unboundedPreceding, 0)
    news_date = F.when(~F.col("__is_market"), F.col("date"))
    return (
        stacked.withColumns({"history_rows": F.count(news_date).over(w), "last_news": F.max(news_date).over(w)})
        .filter("__is_market")
        .select("symbol", "date", "history_rows", "last_news")
    )
