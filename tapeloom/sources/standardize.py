"""Column, date, symbol, text and value standardisation of incoming tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numeric import clip, finite
from ..functions.text import clean_symbol, plain_text
from .schemas import FORBIDDEN_NAME_CHARACTERS, NULL_TOKENS, SYNONYMS, require_columns

#: Accepted date layouts, the first that parses wins.
DATE_LAYOUTS = [
    "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "yyyy/M/d H:m:s", "yyyy/M/d", "M/d/yyyy H:m:s", "M/d/yyyy", "d/M/yyyy",
    "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy",
]
#: A zone behind a time, fractions of a second, and the T between date and time.
ZONE, FRACTION, ISO_T = r"\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})$", r"(:\d{2})[.,]\d+$", r"(\d)T(\d)"
PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close"]


def standardize_names(df: DataFrame) -> DataFrame:
    """Known synonyms renamed; two sources of one name are an error, not a silent overwrite."""
    names = [SYNONYMS.get(c, c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"several columns map to {clash}")
    return df.toDF(*names)


def parse_date(x: Column) -> Column:
    """Date of a string in any accepted layout, as it is written there; NULL when none fits.

    The zone does not move the date.  A zone needs a time before it, so ``2020-06-05``
    keeps its day.
    """
    text = F.trim(x)
    timed = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ZONE, ""), FRACTION, "$1"), ISO_T, "$1 $2")
    text = F.when(text.contains(":"), timed).otherwise(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in DATE_LAYOUTS]).cast("date")


def standardize_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """The column as ``yyyy-MM-dd`` text."""
    kind = df.schema[column].dataType
    day = parse_date(F.col(column)) if isinstance(kind, T.StringType) else F.col(column).cast("date")
    return df.withColumn(column, F.date_format(day, "yyyy-MM-dd"))


def standardize_symbols(df: DataFrame, column: str = "symbol") -> DataFrame:
    return df.withColumn(column, clean_symbol(F.col(column))).filter(F.length(column) > 0)


def standardize_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    wanted = columns or ["headline", "article_text", "content"]
    for c in (c for c in wanted if c in df.columns):
        df = df.withColumn(c, plain_text(F.col(c))).filter(F.length(c) > 0)
    return df


def to_number(x: str | Column) -> Column:
    """Number in text or any numeric column, NULL where it is none or not finite."""
    c = F.col(x) if isinstance(x, str) else x
    return finite(c.try_cast("double"))


def standardize_sentiment(df: DataFrame) -> DataFrame:
    df = standardize_names(df)
    require_columns(df, ["date", "symbol", "sentiment_compound"])
    df = standardize_symbols(standardize_dates(df))
    values = {"sentiment_compound": clip(to_number("sentiment_compound"), -1.0, 1.0)}
    if "confidence" in df.columns:
        values["confidence"] = clip(to_number("confidence"), 0.0, 1.0)
    return df.withColumns(values).dropna(subset=["sentiment_compound"])


def standardize_market(df: DataFrame) -> DataFrame:
    """Numeric prices above zero and volume not below; rows failing either are dropped."""
    df = standardize_symbols(standardize_dates(standardize_names(df)))
    prices = [c for c in PRICE_COLUMNS if c in df.columns]
    keep = [F.col(c) > 0 for c in prices]
    numbers = {c: to_number(c) for c in prices}
    if "volume" in df.columns:
        numbers["volume"] = to_number("volume")
        keep.append(F.col("volume") >= 0)
    df = df.withColumns(numbers)
    return df.filter(reduce(lambda a, b: a & b, keep)) if keep else df


def standardize_news(df: DataFrame) -> DataFrame:
    df = standardize_names(df)
    require_columns(df, ["date", "symbol", "headline"])
    return standardize_text(standardize_symbols(standardize_dates(df)), ["headline", "article_text"])


def standardize_basic(df: DataFrame) -> DataFrame:
    df = standardize_names(df)
    if "date" in df.columns:
        df = standardize_dates(df)
    return standardize_symbols(df) if "symbol" in df.columns else df


BY_STAGE = {
    "raw_news": standardize_news,
    "raw_market_data": standardize_market,
    "sentiment_analysis": standardize_sentiment,
    "daily_sentiment": standardize_sentiment,
    "temporal_features": standardize_sentiment,
}


def detect_stage(df: DataFrame) -> str | None:
    """Stage implied by the column names."""
    names = set(df.columns)
    if "Stock_symbol" in names:
        return "raw_news"
    if "sentiment_compound" in names:
        return "sentiment_analysis"
    return "raw_market_data" if {"open", "high", "low", "close"} <= names else None


def standardize(df: DataFrame, stage: str | None = None) -> DataFrame:
    """Standardise for ``stage``, or for the stage the columns imply."""
    return BY_STAGE.get(stage or detect_stage(df) or "", standardize_basic)(df)


def without_time_zone(df: DataFrame) -> DataFrame:
    """Zoned timestamps as UTC wall-clock, ``*date*`` strings as timestamps."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            out[f.name] = F.to_utc_timestamp(f.name, F.current_timezone()).cast("timestamp_ntz")
        elif isinstance(f.dataType, T.StringType) and "date" in f.name.lower():
            out[f.name] = F.try_to_timestamp(f.name).cast("timestamp_ntz")
    return df.withColumns(out) if out else df


def coerce_numeric(df: DataFrame, keep: list[str]) -> DataFrame:
    """Missing-value tokens to NULL and every column but ``keep`` to double, in one projection."""
    out = {}
    for f in df.schema.fields:
        if f.name in keep:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(NULL_TOKENS), c)
        out[f.name] = to_number(c)
    return df.withColumns(out)


def finite_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns to NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(c) for c in floats}) if floats else df


def clean_names(df: DataFrame) -> DataFrame:
    """Forbidden characters to ``_``, repeats squeezed, ends trimmed; of equal names the first column stays."""
    import re

    pattern = "[" + re.escape(FORBIDDEN_NAME_CHARACTERS) + "]"
    cleaned = []
    for i, c in enumerate(df.columns):
        name = re.sub("_+", "_", re.sub(pattern, "_", c)).strip("_") or f"column_{i}"
        cleaned.append(name)
    first = [i for i, n in enumerate(cleaned) if n not in cleaned[:i]]
    positional = df.toDF(*[f"__c{i}" for i in range(len(cleaned))])
    return positional.select(*[F.col(f"__c{i}").alias(cleaned[i]) for i in first])


def prefix_numeric_symbols(df: DataFrame) -> DataFrame:
    """``STOCK_`` before digit-only symbols, ``DEFAULT`` for missing ones."""
    s = F.col("symbol").cast("string")
    named = F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("STOCK_"), s)).otherwise(s)
    return df.withColumn("symbol", F.coalesce(named, F.lit("DEFAULT")))


def narrow_floats(df: DataFrame) -> DataFrame:
    """Doubles as 32-bit floats, for writing."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.col(c).cast("float") for c in doubles}) if doubles else df
