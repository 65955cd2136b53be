"""From bars and articles to the joined feature panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import decay, indicators, joins, metrics, news, relevance, splits
from ..operators.windows import series


def market_features(bars: DataFrame, warmup: bool = True) -> DataFrame:
    """Indicators, horizon returns and calendar of daily bars, warm-up rows dropped."""
    df = indicators.horizon_returns(indicators.add_indicators(bars))
    df = indicators.add_time_features(df)
    return indicators.drop_warmup(df) if warmup else df


def news_sentiment(articles: DataFrame, dictionary: relevance.Dictionary, score=news.score_lexicon) -> DataFrame:
    """Raw articles to daily sentiment: gate, clean, deduplicate, validate, score, filter, aggregate."""
    clean = news.distinct_articles(news.clean_articles(articles))
    scored = score(relevance.validate_articles(clean, dictionary))
    return news.daily_sentiment(news.filter_confidence(scored))


def feature_panel(bars: DataFrame, daily: DataFrame, rates: dict[int, float] = decay.RATES) -> DataFrame:
    """Market features with decayed and same-day sentiment and the temporal split."""
    market = market_features(bars)
    key = market.select("symbol", "date")
    decayed = decay.all_decay_features(key, daily, rates)
    joined = joins.attach_features(market, decayed)
    return splits.temporal_split(joins.attach_sentiment(joined, daily))


def market_news_summary(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Return, volatility and decayed sentiment per market row, summarised per symbol.

    Directional accuracy asks whether the sentiment known the row before had the
    sign of the return.
    """
    market = indicators.volatility(bars.select("symbol", "date", "close"))
    panel = decay.decay_features(market, daily, {5: decay.RATES[5]})
    mood = F.col("sentiment_decay_5d_compound")
    panel = panel.withColumns({"y": F.col("returns"), "yhat": F.lag(mood).over(series())})
    return panel.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("returns").alias("mean_return"),
        F.avg("volatility_20d").alias("mean_volatility"),
        F.avg(mood).alias("mean_sentiment"),
        metrics.sharpe(F.col("returns")).alias("sharpe_ratio"),
        metrics.directional_accuracy().alias("directional_accuracy"),
    )
