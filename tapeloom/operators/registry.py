"""Roles of columns by name: protection, categories and order.

Works on the schema alone; nothing here reads data.
"""

from __future__ import annotations

# ---- fixed values: protected features and name patterns per role ----
PROTECTED = {
    "ohlc_basic": ["open", "high", "low", "close", "volume", "adj_close"],
    "price_derived": ["returns", "log_returns", "vwap", "overnight_returns"],
    "core_technical": [
        "ema_5", "ema_10", "ema_20", "ema_12", "ema_26", "ema_50", "sma_5", "sma_10", "sma_20", "sma_22", "sma_44",
        "rsi_14", "rsi_21", "macd_line", "macd_signal", "macd_histogram", "bb_width", "bb_position",
        "bollinger_bands", "bollinger_width", "bollinger_position", "atr", "atr_14", "atr_22", "volatility_20d",
        "volatility_22d", "volatility_5d",
    ],
    "time_essential": ["time_idx", "year", "month", "day_of_week", "quarter", "day_of_month"],
    "sentiment_core": [
        "confidence_mean", "sentiment_compound", "sentiment_volatility_5d", "sentiment_mean", "sentiment_median",
        "sentiment_std",
    ],
    "volume_essential": ["volume_sma_5", "volume_sma_10", "volume_ratio", "dollar_volume", "turnover"],
}
ALWAYS_PROTECTED = ["ohlc_basic", "core_technical", "time_essential"]
SENTIMENT_PATTERNS = [
    "sentiment_decay_", "sentiment_compound", "sentiment_positive", "sentiment_negative", "sentiment_confidence",
    "sentiment_ma_", "confidence_mean", "confidence_std", "high_confidence_ratio", "sentiment_volatility_",
    "sentiment_momentum_", "sentiment_mean", "sentiment_median", "sentiment_std",
]
IDENTIFIERS = ["stock_id", "symbol", "date", "time_idx"]
CATEGORIES = [
    ("sentiment", SENTIMENT_PATTERNS[:6]),
    ("price", ["open", "high", "low", "close", "price", "vwap", "return"]),
    ("volume", ["volume", "turnover"]),
    ("technical", ["rsi", "macd", "bb_", "atr", "volatility", "sma", "ema", "stoch", "roc"]),
    ("time", ["year", "month", "day", "week", "quarter", "_sin", "_cos"]),
]
ORDER = [
    ("names", ["stock_id", "symbol", "date", "open", "high", "low", "close", "volume"]),
    ("names", ["returns", "log_returns", "vwap", "gap", "intraday_return", "price_position"]),
    ("parts", ["ema_", "sma_", "bb_", "rsi_", "macd", "atr", "roc_", "stoch", "williams"]),
    ("parts", ["volume_"]),
    ("parts", ["volatility"]),
    ("parts", ["_lag_"]),
    ("parts", ["year", "month", "day", "week", "quarter", "time_idx", "_sin", "_cos"]),
    ("parts", ["target_"]),
]
# ---- end of fixed values ----


def matches(name: str, patterns: list[str]) -> bool:
    return any(p in name.lower() for p in patterns)


def is_target(name: str) -> bool:
    """Every ``target_*`` and ``label_*`` column is a target, never a feature."""
    return name.startswith(("target_", "label_"))


def is_sentiment(name: str) -> bool:
    return matches(name, SENTIMENT_PATTERNS)


def feature_columns(columns: list[str]) -> list[str]:
    skip = {"stock_id", "symbol", "date", "split", "source"}
    return [c for c in columns if c not in skip and not is_target(c)]


def protected_features(columns: list[str], with_sentiment: bool) -> list[str]:
    groups = [*ALWAYS_PROTECTED, *(["sentiment_core"] if with_sentiment else [])]
    found = [f for g in groups for f in PROTECTED[g] if f in columns]
    if with_sentiment:
        found += [c for c in columns if "sentiment_decay" in c.lower()]
    return list(dict.fromkeys(found))


def protected_inventory(columns: list[str]) -> dict[str, tuple[int, int]]:
    """Found and expected protected features per group."""
    return {g: (sum(f in columns for f in names), len(names)) for g, names in PROTECTED.items()}


def category(name: str) -> str:
    if name in IDENTIFIERS:
        return "identifier"
    if is_target(name):
        return "target"
    return next((label for label, patterns in CATEGORIES if matches(name, patterns)), "other")


def categorise(columns: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(category(c), []).append(c)
    return out


def ordered_columns(columns: list[str]) -> list[str]:
    """Identifiers, prices, basic and technical features, lags, calendar, targets, then the rest."""
    out: list[str] = []
    for kind, values in ORDER:
        if kind == "names":
            out += [v for v in values if v in columns and v not in out]
        else:
            out += [c for c in columns if matches(c, values) and c not in out]
    return out + [c for c in columns if c not in out]
