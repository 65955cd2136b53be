"""Data-quality rules as aggregates returning small report tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..sources.schemas import FORBIDDEN_NAME_CHARACTERS, STAGES, missing_columns, type_issues
from ..sources.standardize import to_number
from . import registry
from .windows import series, whole

# ---- fixed values: limits of the rules ----
MOST_NULLS, EXTREME_SCORE, MOST_EXTREME = 0.5, 0.95, 0.1
LEAST_SYMBOL_ROWS, LEAST_TARGET_COVERAGE, LEAST_DAYS = 100, 0.8, 365
LOW_CONFIDENCE, MOST_LOW_CONFIDENCE = 0.5, 0.3
LEAST_KEPT_ROWS, LEAST_DEVIATION = 0.7, 0.01
LEAST_HORIZON_COVERAGE = 0.85
POOR_COVERAGE, MODERATE_COVERAGE = 20.0, 50.0
LEAST_FEATURE_SHARE, LEAST_SENTIMENT, LEAST_DECAY = 0.75, 10, 5
TRAIN_SHARE = (0.6, 0.8)
DATASET_REQUIRED = ["stock_id", "symbol", "date", "open", "high", "low", "close", "volume", "target_5"]
# ---- end of fixed values ----

_ISSUES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("severity", "rule", "subject")] + [T.StructField("value", T.DoubleType())]
)


def _schema_issues(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(*r, None) for r in rows], _ISSUES)


def panel_violations(df: DataFrame) -> DataFrame:
    """Keys that break the panel rule of one row per ``(symbol, date)``, with their row count.

    An empty result means every per-symbol window is bounded by the calendar.
    """
    counts = df.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("rows"))
    return counts.filter(F.col("rows") > 1)


def value_ranges(df: DataFrame, stage: str) -> DataFrame:
    """Smallest and largest value of each ranged column and whether they break the rule."""
    rules = {c: r for c, r in STAGES[stage].ranges.items() if c in df.columns}
    made = {}
    for c, (low, high) in rules.items():
        v = F.col(c).cast("double")
        below = (F.min(v) < low) if low is not None else F.lit(False)
        above = (F.max(v) > high) if high is not None else F.lit(False)
        made[c] = F.struct(
            F.min(v).alias("min_value"), F.max(v).alias("max_value"),
            F.coalesce(below, F.lit(False)).alias("below_minimum"), F.coalesce(above, F.lit(False)).alias("above_maximum"),
        )
    return df.agg(*[s.alias(c) for c, s in made.items()]).unpivot([], list(made), "column", "s").select("column", "s.*")


def general_quality(df: DataFrame, stage: str, key: list[str] | None = None) -> DataFrame:
    """Columns mostly NULL, repeated rows, and too many extreme scores, as one row of counts."""
    counts = df.groupBy(*(key or df.columns)).agg(
        F.count(F.lit(1)).alias("n"),
        *([F.sum((F.abs(F.col("sentiment_compound")) > EXTREME_SCORE).cast("bigint")).alias("extreme")]
          if stage in ("sentiment_analysis", "daily_sentiment") and "sentiment_compound" in df.columns else []),
    )
    made = [F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicate_rows")]
    if "extreme" in counts.columns:
        made += [
            F.coalesce(F.sum("extreme"), F.lit(0)).alias("extreme_rows"),
            F.coalesce(F.sum("extreme") > F.sum("n") * MOST_EXTREME, F.lit(False)).alias("too_many_extreme"),
        ]
    return counts.agg(*made)


def stage_issues(df: DataFrame, stage: str, checks: list[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Everything wrong with a stage table: ``(severity, rule, subject, value)``.

    ``checks`` are callables returning a one-row DataFrame with ``ok`` and ``message``.
    """
    spark = df.sparkSession
    known = [("error", "missing_column", c) for c in missing_columns(df, stage)]
    known += [("warning", "type", m) for m in type_issues(df, stage)]
    out = _schema_issues(spark, known)
    if any(c in df.columns for c in STAGES[stage].ranges):
        ranges = value_ranges(df, stage)
        for flag_name, rule, value in (
            ("below_minimum", "below_minimum", "min_value"), ("above_maximum", "above_maximum", "max_value")
        ):
            out = out.unionByName(
                ranges.filter(flag_name).select(
                    F.lit("warning").alias("severity"), F.lit(rule).alias("rule"), F.col("column").alias("subject"),
                    F.col(value).alias("value"),
                )
            )
    nulls = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).unpivot([], df.columns, "subject", "value")
    out = out.unionByName(
        nulls.filter(F.col("value") > MOST_NULLS).select(F.lit("warning").alias("severity"), F.lit("mostly_null").alias("rule"), "subject", "value")
    )
    for check in checks or []:
        out = out.unionByName(
            check(df).filter(~F.col("ok")).select(
                F.lit("error").alias("severity"), F.lit("custom").alias("rule"), F.col("message").alias("subject"),
                F.lit(None).cast("double").alias("value"),
            )
        )
    return out


def validate_dataset(df: DataFrame, required: list[str] = DATASET_REQUIRED) -> DataFrame:
    """Ten checks of a finished dataset as ``(severity, rule, subject, value)`` rows."""
    spark, names = df.sparkSession, df.columns
    known = [("error", "missing_column", c) for c in required if c not in names]
    known += [("warning", "forbidden_characters", c) for c in names if set(c) & set(FORBIDDEN_NAME_CHARACTERS)]
    known += [("warning", "duplicate_column", c) for c in sorted({c for c in names if names.count(c) > 1})]
    issues = _schema_issues(spark, known)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    prices = [c for c in ("open", "high", "low", "close", "volume") if c in names]
    n = F.count(F.lit(1))

    def entry(severity: str, rule: str, subject: str, value: Column, broken: Column) -> Column:
        return F.struct(
            F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(subject).alias("subject"),
            value.cast("double").alias("value"), F.coalesce(broken, F.lit(False)).alias("listed"),
        )

    made: list[Column] = []
    for c in prices:
        bad = F.count_if(F.col(c).isNotNull() & to_number(c).isNull() & ~F.col(c).cast("string").isin("Infinity", "-Infinity"))
        made.append(entry("error", "not_numeric", c, bad, bad > 0))
    if "date" in names:
        bad = F.count_if(F.col("date").isNotNull() & F.col("date").cast("string").try_cast("date").isNull())
        made.append(entry("error", "invalid_date", "date", bad, bad > 0))
    for c in names:
        share = F.avg(F.col(c).isNull().cast("double"))
        made.append(entry("warning", "mostly_null", c, share, share > MOST_NULLS))
    for c in floats:
        infinite = F.count_if(F.abs(F.col(c)) == float("inf"))
        made.append(entry("warning", "infinite", c, infinite, infinite > 0))
    for c in (c for c in names if registry.is_target(c)):
        coverage = F.count(c) / n
        made.append(entry("warning", "low_target_coverage", c, coverage, coverage < LEAST_TARGET_COVERAGE))
        made.append(entry("info", "good_target_coverage", c, coverage, coverage >= LEAST_TARGET_COVERAGE))
    if "date" in names:
        day = F.col("date").cast("string").try_cast("date")
        span = F.datediff(F.max(day), F.min(day))
        made.append(entry("warning", "short_date_range", "date", span, span < LEAST_DAYS))
        made.append(entry("info", "date_range", "date", span, span >= LEAST_DAYS))
    wide = df.agg(*[m.alias(f"m{i}") for i, m in enumerate(made)])
    found = wide.select(F.explode(F.array(*wide.columns)).alias("m")).select("m.*").filter("listed").drop("listed")
    sparse = df.groupBy("symbol").agg(n.alias("n")).filter(F.col("n") < LEAST_SYMBOL_ROWS).select(
        F.lit("warning").alias("severity"), F.lit("sparse_symbol").alias("rule"), F.col("symbol").alias("subject"),
        F.col("n").cast("double").alias("value"),
    )
    return issues.unionByName(found).unionByName(sparse)


def cross_source_check(market: DataFrame, daily: DataFrame) -> DataFrame:
    """One row comparing sentiment with market data: NULLs, weak scores, date ranges, missing symbols."""
    needed = ["sentiment_compound", "sentiment_positive", "sentiment_negative", "confidence", "article_count"]
    low = F.avg((F.col("confidence") < LOW_CONFIDENCE).cast("double"))
    nulls = sum((F.count_if(F.col(c).isNull()) for c in needed[1:]), F.count_if(F.col(needed[0]).isNull()))
    missing = market.select("symbol").distinct().join(daily.select("symbol").distinct(), "symbol", "left_anti")
    m = market.agg(F.struct(F.min("date").alias("a"), F.max("date").alias("b"))).scalar()
    return daily.agg(
        nulls.alias("null_values"), low.alias("low_confidence_share"),
        (low > MOST_LOW_CONFIDENCE).alias("too_many_low_confidence"),
        F.min("date").alias("sentiment_first"), F.max("date").alias("sentiment_last"),
    ).withColumns(
        {
            "market_first": m["a"], "market_last": m["b"],
            "symbols_without_sentiment": missing.agg(F.count(F.lit(1))).scalar(),
        }
    )


def enhancement_safety(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row of checks that new daily sentiment may replace the old."""
    lost = old.select("symbol").distinct().join(new.select("symbol").distinct(), "symbol", "left_anti")
    o = old.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"))).scalar()
    s, c = F.col("sentiment_compound"), F.col("confidence")
    n = F.count(F.lit(1))
    return (
        new.agg(
            n.alias("rows"), F.coalesce(F.bool_and(s.between(-1, 1)), F.lit(False)).alias("valid_sentiment_range"),
            F.coalesce(F.bool_and(c.between(0, 1)), F.lit(False)).alias("valid_confidence_range"),
            (F.count_if(s.isNull() | c.isNull()) == 0).alias("no_critical_nulls"),
            F.coalesce(F.stddev_samp(s) > LEAST_DEVIATION, F.lit(False)).alias("reasonable_distribution"),
            F.avg(c).alias("__c"),
        )
        .withColumns(
            {
                "record_count": F.col("rows") >= o["n"] * LEAST_KEPT_ROWS,
                "same_symbols": lost.agg(F.count(F.lit(1)) == 0).scalar(),
                "record_improvement": F.col("rows") - o["n"],
                "confidence_improvement": F.col("__c") - o["c"],
            }
        )
        .drop("__c", "rows")
    )


def target_integrity(df: DataFrame, horizons: list[int]) -> DataFrame:
    """Per horizon: targets known too early (must be none) and coverage of the later rows.

    Run it before the warm-up rows are dropped.
    """
    rows = df.withColumns({"__row": F.row_number().over(series()), "__n": F.count(F.lit(1)).over(whole())})
    made = {}
    for h in horizons:
        t, row = F.col(f"target_{h}d"), F.col("__row")
        early = F.count_if((row <= h) & t.isNotNull() & (F.col("__n") >= h + 10))
        coverage = F.avg(F.when(row > h, t.isNotNull().cast("double")))
        made[f"target_{h}d"] = F.struct(
            early.alias("early_targets"), coverage.alias("coverage"),
            ((early == 0) & (coverage >= LEAST_HORIZON_COVERAGE)).alias("passed"),
        )
    return rows.agg(*[c.alias(n) for n, c in made.items()]).unpivot([], list(made), "target", "s").select("target", "s.*")


def integration_report(df: DataFrame, sentiment_column: str = "sentiment_compound") -> DataFrame:
    """One row on an integrated table that still has its NULLs: sizes, coverage, status."""
    sentiment = [c for c in df.columns if c.startswith("sentiment_") and "decay" not in c]
    decay = [c for c in df.columns if "sentiment_decay_" in c]
    coverage = F.count(sentiment_column) * 100.0 / F.count(F.lit(1))
    base_missing = [c for c in ("symbol", "date", "close", "target_5") if c not in df.columns]
    status = F.lit("not_ready") if base_missing or not sentiment else (
        F.when(coverage < POOR_COVERAGE, "warning").otherwise("success")
    )
    return df.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_distinct("symbol").alias("unique_symbols"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        coverage.alias("sentiment_coverage"), (coverage < MODERATE_COVERAGE).alias("moderate_coverage"),
        F.lit(len(sentiment)).alias("sentiment_features"), F.lit(len(decay)).alias("decay_features"),
        status.alias("status"),
    )


def preparation_report(df: DataFrame, features: list[str], goal: int, with_sentiment: bool) -> DataFrame:
    """One row: feature counts against their goals and the share of training rows."""
    critical = registry.PROTECTED["ohlc_basic"] + registry.PROTECTED["core_technical"][:10]
    sentiment = [f for f in features if "sentiment" in f]
    decay = [f for f in features if "sentiment_decay" in f]
    share = F.avg((F.col("split") == "train").cast("double"))
    return df.agg(
        F.lit(len(features)).alias("features"), F.lit(len(features) >= goal * LEAST_FEATURE_SHARE).alias("enough_features"),
        F.lit(sum(f not in features for f in critical)).alias("missing_critical"),
        F.lit(not with_sentiment or len(sentiment) >= LEAST_SENTIMENT).alias("enough_sentiment"),
        F.lit(not with_sentiment or len(decay) >= LEAST_DECAY).alias("enough_decay"),
        share.alias("train_share"), share.between(*TRAIN_SHARE).alias("usual_train_share"),
    )


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """The table with a row counter that is filled by whatever action runs next; no extra job."""
    watch = Observation(stage)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch


def logged(
    name: str, before: DataFrame, build: Callable[[DataFrame], DataFrame], operations: list[str], columns: str | None = None
) -> tuple[DataFrame, dict]:
    """A stage and its log entry, filled by the action that runs the stage; nothing is counted apart.

    ``columns`` names a declared stage whose required columns the result is checked for.
    """
    seen, rows_in = observed(before, f"{name}-in")
    after, rows_out = observed(build(seen), f"{name}-out")
    issues = missing_columns(after, columns) if columns else []
    return after, {"stage": name, "in": rows_in, "out": rows_out, "operations": operations, "issues": issues}


def stage_log(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Rows in and out, operations and missing columns per stage, after the stages have run."""
    rows = [
        (e["stage"], e["in"].get["rows"], e["out"].get["rows"], ",".join(e["operations"]), ",".join(e["issues"])) for e in entries
    ]
    return spark.createDataFrame(rows, "stage string, input_rows bigint, output_rows bigint, operations string, issues string")


def pipeline_summary(log: DataFrame) -> DataFrame:
    """One row: stages, stages with issues, and the share of rows that the narrowest stage kept."""
    kept = F.try_divide("output_rows", "input_rows") * 100.0
    return log.agg(
        F.count(F.lit(1)).alias("stages"), F.count_if(F.length("issues") > 0).alias("stages_with_issues"),
        F.sum("output_rows").alias("rows_written"), F.min(kept).alias("least_kept_pct"),
    )


def choose_sentiment(spark: SparkSession, primary: DataFrame | None, market: DataFrame) -> tuple[str, DataFrame]:
    """The daily sentiment table if it fits its schema, else neutral values for every market row."""
    if primary is not None and not missing_columns(primary, "daily_sentiment"):
        return "primary", primary
    neutral = market.select(
        "symbol", "date", F.lit(0.0).alias("sentiment_compound"), F.lit(0.5).alias("confidence"),
        F.lit(0).cast("bigint").alias("article_count"),
    )
    return "neutral", neutral
