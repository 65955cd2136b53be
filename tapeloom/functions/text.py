"""Headline cleaning and matching as regular expressions on the JVM side.

Letter classes are written out (``\\p{L}\\p{N}_``) because Java's ``\\w`` is ASCII.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# ---- fixed values: patterns, phrases and word lists that decide the results ----
BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
HTML_TAG = r"<[^>]+>"
WEB_ADDRESS = r"https?://[!$-_a-z]+"
NOT_HEADLINE_TEXT = r"[^\p{L}\p{N}_\s$%.,;:!?\-()]"
NOT_PLAIN_TEXT = r"[^\p{L}\p{N}_\s.,!?;:\-]"
TICKER_FORMS = [r"\$([A-Z]{2,5})\b", r"NASDAQ:([A-Z]{2,5})", r"NYSE:([A-Z]{2,5})"]
PERCENT = r"([+-]?\d+\.?\d*%)"
DOLLAR_AMOUNT = r"\$(\d+\.?\d*[KMB])"
PHRASES = {
    "beats estimates": "exceeded expectations",
    "misses estimates": "disappointed expectations",
    "raises guidance": "improved outlook",
    "lowers guidance": "reduced outlook",
    "strong quarter": "positive quarterly performance",
    "weak quarter": "disappointing quarterly performance",
    "beats expectations": "exceeded expectations",
    "falls short": "disappointed expectations",
    "outperforms": "exceeded expectations",
    "underperforms": "disappointed expectations",
}
NEGATIONS = {"not": "NOT_", "no": "NO_", "failed to": "FAILED_TO_", "unable to": "UNABLE_TO_"}
EMPHASES = {
    r"earnings\s+report": "EARNINGS_REPORT",
    r"quarterly\s+results": "QUARTERLY_RESULTS",
    r"financial\s+results": "FINANCIAL_RESULTS",
}
SPAM_PHRASES = ["click here", "subscribe", "advertisement", "sponsored"]
FINANCE_WORDS = [
    "earnings", "revenue", "profit", "loss", "stock", "share", "market", "trading", "investor",
    "analyst", "upgrade", "downgrade", "price", "target", "outlook", "guidance", "financial",
    "quarterly", "annual", "acquisition", "merger", "ipo", "dividend", "split", "buyback",
]
QUALITY_WORDS = [
    "earnings", "revenue", "profit", "quarter", "guidance", "outlook", "results", "performance", "forecast",
]
MIN_HEADLINE, MAX_HEADLINE = 50, 500
# ---- end of fixed values ----


def squeeze_blanks(x: Column) -> Column:
    """Every run of blanks as one space; single spaces, the usual case, are not matched at all."""
    blank = BLANKS.removesuffix("+")
    return F.regexp_replace(x, f" {blank}+|[{blank}&&[^ ]]{blank}*", " ")


def clean_headline(x: Column) -> Column:
    """Markup, addresses, runs of blanks and stray symbols removed; NULL becomes ''."""
    x = F.coalesce(x, F.lit(""))
    x = F.regexp_replace(x, HTML_TAG, "")
    x = F.regexp_replace(x, WEB_ADDRESS, "")
    return F.trim(F.regexp_replace(squeeze_blanks(x), NOT_HEADLINE_TEXT, ""))


def normalise_headline(x: Column) -> Column:
    """Clean headline with tickers, amounts, set phrases and negations made single tokens.

    The rewrites are ordered: a later one sees the output of the earlier ones.
    """
    x = clean_headline(x)
    for form in TICKER_FORMS:
        x = F.regexp_replace(x, "(?U)" + form, "TICKER_$1")
    x = F.regexp_replace(x, PERCENT, " $1 ")
    x = F.regexp_replace(x, DOLLAR_AMOUNT, "DOLLAR_$1")
    for phrase, replacement in PHRASES.items():
        x = F.regexp_replace(x, rf"(?iU)\b{phrase}\b", replacement)
    for words, token in NEGATIONS.items():
        x = F.regexp_replace(x, rf"(?iU)\b{words}\s+", token)
    for pattern, token in EMPHASES.items():
        x = F.regexp_replace(x, rf"(?iU)\b{pattern}\b", token)
    return x


def contains_any(lowered: Column, terms: list[str]) -> Column:
    """True when any term is a substring of the already lower-cased text, which is computed once."""
    return F.exists(F.array(lowered), lambda low: reduce(lambda a, b: a | b, [low.contains(t) for t in terms]))


def quality_reason(headline: Column) -> Column:
    """Reason the raw headline fails the gate, or ``valid``; the first rule wins."""
    h = F.coalesce(headline, F.lit(""))
    size = F.length(h)
    return (
        F.when(size < MIN_HEADLINE, "too_short")
        .when(size > MAX_HEADLINE, "too_long")
        .when(~h.rlike(BLANKS.replace("[", "[^", 1).removesuffix("+")), "empty")
        .when(contains_any(F.lower(h), SPAM_PHRASES), "spam")
        .otherwise("valid")
    )


def finance_related(headline: Column) -> Column:
    return contains_any(F.lower(headline), FINANCE_WORDS)


def quality_weight(headline: Column, confidence: Column, relevance: Column | None = None) -> Column:
    """Multiplicative article weight from length, content and scorer confidence."""
    size, lowered = F.length(headline), F.lower(headline)
    one = F.lit(1.0)
    weight = (
        F.when(size.between(80, 150), 1.15).when(size.between(50, 200), 1.05).otherwise(one)
        * F.when(contains_any(lowered, QUALITY_WORDS), 1.2).otherwise(one)
        * F.when(headline.rlike(r"\d+\.?\d*%"), 1.1).otherwise(one)
        * F.when(headline.rlike(r"\$\d+"), 1.05).otherwise(one)
        * F.when(confidence > 0.85, 1.15).when(confidence > 0.75, 1.05).otherwise(one)
    )
    if relevance is not None:
        weight = weight * F.when(relevance > 0.5, 1.1).otherwise(one)
    return weight * F.when((size < 40) | (size > 250), 0.9).otherwise(one)


def plain_text(x: Column) -> Column:
    """Trimmed text with blanks squeezed and symbols outside basic punctuation removed."""
    return F.regexp_replace(F.trim(squeeze_blanks(x)), NOT_PLAIN_TEXT, "")


def clean_symbol(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(x)), "[^A-Z]", "")
