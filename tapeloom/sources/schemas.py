"""Declared tables of each stage and the synonyms of their columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, types as T

# ---- fixed values: column synonyms, stage columns, types and ranges ----
SYNONYMS = {
    "stock_symbol": "symbol", "Stock_symbol": "symbol", "ticker": "symbol", "Symbol": "symbol", "SYMBOL": "symbol",
    "stock": "symbol",
    "Date": "date", "DATE": "date", "timestamp": "date", "time": "date",
    "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume", "Adj Close": "adj_close",
    "Article_title": "headline", "article_title": "headline", "title": "headline", "Title": "headline",
    "news_title": "headline",
    "Article": "article_text", "article": "article_text", "content": "article_text",
    "sentiment": "sentiment_compound", "sentiment_score": "sentiment_compound", "compound": "sentiment_compound",
}
NULL_TOKENS = ["none", "None", "null", "NULL", "na", "NA", "n/a", "N/A", "nan", "NaN", "", " ", "missing"]
FORBIDDEN_NAME_CHARACTERS = ". -+*/\\|()[]"
# ---- end of fixed values ----


@dataclass(frozen=True)
class Stage:
    """Required columns with their kind, optional columns and allowed value ranges."""

    columns: dict[str, str]
    optional: tuple[str, ...] = ()
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)


_SCORES = {"sentiment_compound": (-1.0, 1.0), "confidence": (0.0, 1.0)}
STAGES = {
    "raw_news": Stage(
        {"Date": "date", "Article_title": "string", "Stock_symbol": "string"}, ("Url", "Publisher", "Author", "Article")
    ),
    "raw_market_data": Stage(
        {"date": "date", "symbol": "string", "open": "float", "high": "float", "low": "float", "close": "float",
         "volume": "int"}
    ),
    "sentiment_analysis": Stage(
        {"date": "date", "symbol": "string", "headline": "string", "sentiment_compound": "float",
         "confidence": "float"},
        ("sentiment_label", "article_count"),
        _SCORES,
    ),
    "daily_sentiment": Stage(
        {"date": "date", "symbol": "string", "sentiment_compound": "float", "confidence": "float",
         "article_count": "int"},
        (),
        {**_SCORES, "article_count": (1.0, None)},
    ),
    "temporal_features": Stage(
        {"date": "date", "symbol": "string", "sentiment_compound": "float", "sentiment_decay": "float",
         "price_return": "float"},
        ("volume_change", "volatility", "moving_avg_sentiment"),
    ),
    "model_training": Stage({"date": "date", "symbol": "string", "target": "float"}),
    "model_predictions": Stage(
        {"date": "date", "symbol": "string", "prediction": "float", "confidence_interval": "float"}
    ),
}

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)
RAW_NEWS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("Date", "Article_title", "Stock_symbol", "Url", "Publisher", "Author", "Article")]
)

_KINDS = {
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "string": (T.StringType,),
    "float": (T.NumericType,),
    "int": (T.IntegralType,),
}


def missing_columns(df: DataFrame, stage: str) -> list[str]:
    return [c for c in STAGES[stage].columns if c not in df.columns]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, or an error naming every missing column; reads no data."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def type_issues(df: DataFrame, stage: str) -> list[str]:
    """Columns whose declared kind does not match the schema."""
    found = {f.name: f.dataType for f in df.schema.fields}
    return [
        f"{name} should be {kind}, is {found[name].simpleString()}"
        for name, kind in STAGES[stage].columns.items()
        if name in found and not isinstance(found[name], _KINDS[kind])
    ]
