"""Articles: gate, cleaning, deduplication, scoring and daily aggregation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import evaluate_once, text
from ..session import written
from .positions import exact_quantiles

# ---- fixed values: confidence limits and class bounds ----
BASE_CONFIDENCE, LEAST_CONFIDENCE = 0.7, 0.6
KEEP_SHARE, FALLBACK_PERCENTILE = 0.7, 0.3
ARTICLE_CLASS_BOUND, DAY_CLASS_BOUND = 0.1, 0.05
# ---- end of fixed values ----

#: Default lexicon; replace it by passing other lists.
POSITIVE = ["exceeded expectations", "improved outlook", "positive", "growth", "gain", "record", "profit", "strong"]
NEGATIVE = ["disappointed expectations", "reduced outlook", "disappointing", "loss", "failed", "decline", "weak", "NOT_"]

SCORES = ["sentiment_positive", "sentiment_neutral", "sentiment_negative"]


def with_quality_reason(articles: DataFrame) -> DataFrame:
    return articles.withColumn("quality_reason", text.quality_reason(F.col("headline")))


def clean_articles(articles: DataFrame) -> DataFrame:
    """Articles passing the gate, headline normalised and still long enough."""
    valid = with_quality_reason(articles).filter(F.col("quality_reason") == "valid").drop("quality_reason")
    cleaned = evaluate_once(valid, "headline", text.normalise_headline(F.col("headline")))
    return cleaned.filter(F.length("headline") >= text.MIN_HEADLINE)


def distinct_articles(articles: DataFrame, article_id: str = "article_id") -> DataFrame:
    """One row per date, symbol and headline: the whole row with the smallest id.

    Copies are folded on the map side by a hash aggregate with a numeric buffer,
    so a group holding a third of all rows sends one row per task to the shuffle.
    Other columns are fetched by the ids that are left; rows repeated with their
    id count once.
    """
    keys = ["date", "symbol", "headline"]
    first = articles.groupBy(*keys).agg(F.min(article_id).alias(article_id))
    if set(articles.columns) == {*keys, article_id}:
        return first
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (article_id, *keys)])
    rows = articles.alias("a").join(first.alias("f"), same, "left_semi")
    return rows.dropDuplicates([*keys, article_id]).select(articles.columns)


def sample_articles(articles: DataFrame, share: float, article_id: str = "article_id") -> DataFrame:
    """A repeatable sample by hash of the id: the same rows under any partitioning."""
    slots = 1 << 20  # five hexadecimal digits
    return articles.filter(F.substring(F.md5(F.col(article_id).cast("string")), 1, 5) < f"{math.ceil(share * slots):05x}")


def _probabilities(logits: dict[str, Column]) -> dict[str, Column]:
    weights = {n: F.exp(x) for n, x in logits.items()}
    total = sum(weights.values(), F.lit(0.0))
    return {n: w / total for n, w in weights.items()}


def with_scores(df: DataFrame) -> DataFrame:
    """Compound and confidence from the three class probabilities."""
    return df.withColumns(
        {
            "sentiment_compound": F.col("sentiment_positive") - F.col("sentiment_negative"),
            "confidence": F.greatest(*SCORES),
        }
    )


def score_lexicon(
    articles: DataFrame, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE
) -> DataFrame:
    """Class probabilities from the number of lexicon terms present, as plain expressions."""
    def hits(h: Column, terms: list[str]) -> Column:
        return sum((h.contains(t.lower()).cast("double") for t in terms), F.lit(0.0))

    p = _probabilities(
        {
            "sentiment_positive": F.col("__hits.up"),
            "sentiment_neutral": F.lit(0.0),
            "sentiment_negative": F.col("__hits.down"),
        }
    )
    both = F.transform(F.array(F.lower("headline")), lambda h: F.struct(hits(h, positive).alias("up"), hits(h, negative).alias("down")))
    counted = evaluate_once(articles, "__hits", F.get(both, F.lit(0)))
    return with_scores(counted.withColumns(p).drop("__hits"))


def score_with_model(
    articles: DataFrame, load: Callable[[], Callable[[pd.Series], pd.DataFrame]], text_column: str = "headline"
) -> DataFrame:
    """Scores from any model that maps a batch of texts to positive/neutral/negative columns.

    ``load`` runs once per task; batches arrive through Arrow.  Fields are taken by
    name, never by position.
    """
    schema = T.StructType(
        [*articles.schema.fields, *[T.StructField(c, T.DoubleType()) for c in SCORES]]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            p = predict(batch[text_column])
            yield batch.assign(**{c: p[c.removeprefix("sentiment_")].to_numpy() for c in SCORES})

    return with_scores(articles.mapInPandas(score, schema))


def adaptive_threshold(scored: DataFrame, adaptive: bool = True) -> float:
    """Confidence limit that keeps at least 70 % of the articles.

    One aggregate gives mean and deviation, a second the share kept; only if that
    share is too small is the exact 30th percentile located.  That makes several
    passes: pass written scores, as :func:`filter_confidence` does.
    """
    if not adaptive:
        return BASE_CONFIDENCE
    scored = scored.select("confidence")
    m = scored.agg(F.avg("confidence").alias("mu"), F.stddev_pop("confidence").alias("sd")).first()
    if m.mu is None:
        return BASE_CONFIDENCE
    limit = min(max(LEAST_CONFIDENCE, m.mu - 0.5 * m.sd), BASE_CONFIDENCE)
    share = scored.agg(F.avg((F.col("confidence") >= limit).cast("double")).alias("s")).first().s
    if share < KEEP_SHARE:
        limit = exact_quantiles(scored, ["confidence"], [FALLBACK_PERCENTILE])["confidence"][0]
    return limit


def filter_confidence(scored: DataFrame, adaptive: bool = True) -> DataFrame:
    """Articles at or above the confidence limit; scores are written once, so the scorer runs once per article."""
    scored = written(scored, "scores") if adaptive else scored
    return scored.filter(F.col("confidence") >= adaptive_threshold(scored, adaptive))


def weighed_articles(scored: DataFrame, quality: bool, keep: list[str | Column]) -> DataFrame:
    """The ``keep`` columns, scores and weights that :func:`daily_columns` aggregates."""
    has = set(scored.columns)
    relevance = F.col("relevance_confidence") if "relevance_confidence" in has else None
    weight = text.quality_weight(F.col("headline"), F.col("confidence"), relevance) if quality else F.lit(1.0)
    rows = scored.select(
        *keep, "sentiment_compound", *SCORES, "confidence",
        weight.alias("__q"),
        (relevance if relevance is not None else F.lit(0.5)).alias("__relevance"),
        (F.col("validated") if "validated" in has else F.lit(False)).alias("__validated"),
    )
    return rows.withColumn("__w", F.col("confidence") * F.col("__q"))


def daily_columns(quality: bool) -> list[Column]:
    """Aggregates of weighed articles: sums, counts and moments only, so articles are reduced on the map side."""
    weighted = [
        (F.sum(F.col(c) * F.col("__w")) / F.nullif(F.sum("__w"), F.lit(0.0))).alias(c)
        for c in ["sentiment_compound", *SCORES]
    ]
    return [
        *weighted,
        (F.sum(F.col("confidence") * F.col("__q")) / F.nullif(F.sum("__q"), F.lit(0.0))).alias("confidence"),
        F.count(F.lit(1)).alias("article_count"),
        F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("confidence_std"),
        F.coalesce(F.stddev_samp("sentiment_compound"), F.lit(0.0)).alias("sentiment_std"),
        F.avg("__q").alias("avg_quality_weight"),
        F.coalesce(F.avg("__relevance"), F.lit(0.5)).alias("avg_relevance_confidence"),
        F.lit(quality).alias("weighted_aggregation"),
        F.coalesce(F.bool_or("__validated"), F.lit(False)).alias("ticker_validated"),
    ]


def daily_sentiment(scored: DataFrame, quality: bool = True) -> DataFrame:
    """One row per symbol and day, weighted by confidence and article quality."""
    rows = weighed_articles(scored, quality, keep=["symbol", F.col("date").cast("date").alias("date")])
    return rows.groupBy("symbol", "date").agg(*daily_columns(quality))


def class_histogram(df: DataFrame, bound: float = ARTICLE_CLASS_BOUND) -> DataFrame:
    """Rows and percentage per sentiment class."""
    c = F.col("sentiment_compound")
    label = F.when(c > bound, "positive").when(c < -bound, "negative").otherwise("neutral")
    counts = df.groupBy(label.alias("sentiment_class")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("pct", F.col("rows") * 100.0 / counts.agg(F.sum("rows")).scalar())
