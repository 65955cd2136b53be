"""Feature scores, k-best selection and correlation pruning on training rows."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from . import registry
from .columns import correlations, covariances
from .neighbours import neighbour_information
from .positions import exact_quantiles
from .prepare import train_rows

# ---- fixed values: selection sizes and pruning thresholds ----
K_BASELINE, K_ENHANCED = 80, 120
PROTECTED_LIMIT, SENTIMENT_LIMIT, MIXED_LIMIT, TECHNICAL_LIMIT = 0.99, 0.98, 0.975, 0.97
NEAR_IDENTICAL = 0.95
BOTH_PROTECTED_LIMIT, PERFECT_LIMIT, SENTIMENT_ALLOWANCE = 0.995, 0.999, 0.03
LEAST_VARIANCE = 1e-12
# ---- end of fixed values ----


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows with both values; NULL where one of them does not vary (the built-in fails there)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def _by_feature(df: DataFrame, features: list[str], target: str, made: Column) -> DataFrame:
    """Rows ``(feature, score)``: ``made`` over the correlation ``r`` of a feature with the target and the number ``n`` of their pairs.

    Without rows every feature has the score NULL.
    """
    scores = correlations(df, features, target).select("place", made.alias("score"))
    found = scores.agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("found"))
    labels = F.array(*[F.struct(F.lit(f).alias("feature"), F.try_element_at("found", F.lit(i)).alias("score")) for i, f in enumerate(features)])
    return found.select(F.inline(labels))


def correlation_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Absolute Pearson correlation with the target, all features in one pass."""
    return _by_feature(train_rows(df), features, target, F.abs("r"))


def f_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Regression F statistic from the squared correlation and the pair count."""
    r2 = F.pow("r", F.lit(2))
    score = F.when(r2 < 1.0, r2 / F.nullif(1.0 - r2, F.lit(0.0)) * (F.col("n") - 2)).when(r2 >= 1.0, F.lit(float("inf")))
    return _by_feature(train_rows(df), features, target, score)


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information of quantile bins with the target's bins, in nats.

    Joint counts per feature have ``bins * bins`` cells and are summed on the map
    side; marginals are windows over those cells.
    """
    train = written(train_rows(df).select(target, *features).dropna(subset=[target]))
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(train, [target, *features], probs)

    def binned(c: str):
        return sum(((F.col(c) > e).cast("int") for e in edges[c]), F.lit(0))

    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), binned(f).alias("x")) for f in features if edges[f][0] is not None]))
    counts = (
        train.select(binned(target).alias("y"), cells.alias("c"))
        .groupBy("c.feature", "c.x", "y").agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("feature"))
    px, py = F.sum("n").over(Window.partitionBy("feature", "x")), F.sum("n").over(Window.partitionBy("feature", "y"))
    term = F.col("n") / total * F.ln(F.col("n") * total / (px * py))
    return counts.withColumn("term", term).groupBy("feature").agg(F.sum("term").alias("score"))


def top_features(scores: DataFrame, k: int) -> DataFrame:
    return scores.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), "feature").limit(k)


def top_count(available: int) -> int:
    """How many correlated features are kept for a given number available."""
    return 74 if available >= 70 else 50 if available > 60 else 40


def select_k_best(
    df: DataFrame, features: list[str], target: str, with_sentiment: bool, method: str = "mutual_info", k: int | None = None
) -> list[str]:
    """Protected features first, the remaining places by score; all when there are no more than ``k``."""
    k = k or (K_ENHANCED if with_sentiment else K_BASELINE)
    if len(features) <= k:
        return features
    kept = registry.protected_features(features, with_sentiment)[:k]
    rest = [f for f in features if f not in kept]
    score = {"mutual_info": mutual_information, "neighbours": neighbour_information, "correlation": correlation_scores, "f_regression": f_scores}[method]
    best = top_features(score(df, rest, target), k - len(kept)).collect() if k > len(kept) else []
    return kept + [r.feature for r in best]


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair as rows ``(left, right, correlation)``.

    One distributed pass forms the column-by-column matrix, whose size depends on
    the number of columns only.  Rows with a NULL in any column are left out,
    and a column whose variance is below the resolution of its sums has no correlation.
    """
    n, matrix = covariances(df, columns)
    if n < 2:
        raise ValueError(f"no correlations of {n} rows")
    size = np.sqrt(np.where(np.diag(matrix) > LEAST_VARIANCE, np.diag(matrix), np.nan))
    matrix = matrix / np.outer(size, size)
    rows = [
        (columns[i], columns[j], float(matrix[i, j]) if matrix[i, j] == matrix[i, j] else None)
        for i in range(len(columns))
        for j in range(i + 1, len(columns))
    ]
    return df.sparkSession.createDataFrame(rows, "left string, right string, correlation double")


def near_identical(pairs: DataFrame, limit: float = NEAR_IDENTICAL) -> DataFrame:
    """Pairs of :func:`correlation_pairs` whose absolute correlation is above the limit."""
    return pairs.filter(F.abs("correlation") > limit)


def pairwise_correlations(df: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Correlation over the rows where both columns are present, for listed pairs, in one aggregate."""
    listed = list(pairs)
    made = {f"p{i}": correlation(F.col(a).cast("double"), F.col(b).cast("double")) for i, (a, b) in enumerate(listed)}
    wide = df.agg(*[c.alias(n) for n, c in made.items()])
    labels = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"p{i}").alias("correlation")) for i, (a, b) in enumerate(listed)])
    return wide.select(F.explode(labels).alias("p")).select("p.*")


def prune_decisions(pairs: DataFrame, scores: DataFrame, columns: list[str], with_sentiment: bool) -> DataFrame:
    """For every pair above its threshold, which of the two features goes (NULL: none).

    Pairs are judged one by one: a feature already removed still counts elsewhere.
    """
    protected = registry.protected_features(columns, with_sentiment)
    sentiment = [c for c in columns if registry.is_sentiment(c)]

    def is_in(name: str, members: list[str]):
        return F.col(name).isin(members) if members else F.lit(False)

    target_of = scores.select("feature", F.col("score").alias("s"))
    judged = (
        pairs.withColumn("c", F.abs("correlation"))
        .join(target_of.toDF("left", "ls"), "left", "left")
        .join(target_of.toDF("right", "rs"), "right", "left")
        .withColumns(
            {
                "lp": is_in("left", protected), "rp": is_in("right", protected),
                "lt": is_in("left", sentiment), "rt": is_in("right", sentiment),
            }
        )
    )
    lp, rp, lt, rt, c = (F.col(x) for x in ("lp", "rp", "lt", "rt", "c"))
    limit = (
        F.when(lp | rp, PROTECTED_LIMIT).when(lt & rt, SENTIMENT_LIMIT).when(lt | rt, MIXED_LIMIT).otherwise(TECHNICAL_LIMIT)
    )
    left_wins = F.coalesce(F.col("ls") >= F.col("rs"), F.lit(False))
    right_wins = F.coalesce(F.col("rs") >= F.col("ls"), F.lit(False))
    weaker = F.when(left_wins, F.col("right")).otherwise(F.col("left"))
    victim = (
        F.when(lp & rp, F.when(c > BOTH_PROTECTED_LIMIT, weaker))
        .when(lp, F.when(c < PERFECT_LIMIT, F.col("right")).otherwise(weaker))
        .when(rp, F.when(c < PERFECT_LIMIT, F.col("left")).otherwise(F.when(right_wins, F.col("left")).otherwise(F.col("right"))))
        .when(lt & rt, weaker)
        .when(lt, F.when(F.col("rs") > F.col("ls") + SENTIMENT_ALLOWANCE, F.col("left")).otherwise(F.col("right")))
        .when(rt, F.when(F.col("ls") > F.col("rs") + SENTIMENT_ALLOWANCE, F.col("right")).otherwise(F.col("left")))
        .otherwise(weaker)
    )
    return judged.filter(c > limit).select("left", "right", "correlation", victim.alias("removed"))


def prune_correlated(df: DataFrame, columns: list[str], target: str, with_sentiment: bool) -> list[str]:
    """Columns that stay after pruning on training rows."""
    train = train_rows(df)
    decisions = prune_decisions(
        correlation_pairs(train, columns), correlation_scores(train, columns, target), columns, with_sentiment
    )
    gone = {r.removed for r in decisions.filter(F.col("removed").isNotNull()).select("removed").distinct().collect()}
    return [c for c in columns if c not in gone]
