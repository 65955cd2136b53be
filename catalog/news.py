"""Headline cleaning, relevance, scoring, daily aggregation and integration queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tapeloom.functions import text
from tapeloom.operators import grouped, indicators as ind, joins, news, relevance as rel, windows
from tapeloom.sources.schemas import require_columns

from .base import CTE, DICTIONARY, articles, bars, daily, pick, pick_sql, query, rnd, scored, scored_from, table, with_sql

EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def _chain(expression: str, steps: list[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        expression = f"regexp_replace({expression}, '{pattern}', '{replacement}', 'g')"
    return expression


_CLEAN = [
    (text.HTML_TAG, ""), (text.WEB_ADDRESS, ""), (text.BLANKS, " "), (text.NOT_HEADLINE_TEXT, ""), ("^ +| +$", ""),
]
_NORMAL = (
    [(p, r"TICKER_\1") for p in text.TICKER_FORMS]
    + [(text.PERCENT, r" \1 "), (text.DOLLAR_AMOUNT, r"DOLLAR_\1")]
    + [(f"(?i){EDGE_L}{a}{EDGE_R}", rf"\1{b}\2") for a, b in text.PHRASES.items()]
    + [(rf"(?i){EDGE_L}{a}\s+", rf"\1{b}") for a, b in text.NEGATIONS.items()]
    + [(f"(?i){EDGE_L}{a}{EDGE_R}", rf"\1{b}\2") for a, b in text.EMPHASES.items()]
)
_SPAM = " OR ".join(f"contains(lower(headline), '{s}')" for s in text.SPAM_PHRASES)
_REASON = f"""CASE WHEN length(headline) < 50 THEN 'too_short' WHEN length(headline) > 500 THEN 'too_long'
  WHEN trim(headline) = '' THEN 'empty' WHEN {_SPAM} THEN 'spam' ELSE 'valid' END"""

CTE["cleaned"] = CTE["articles"] + f""",
cleaned AS (SELECT article_id, symbol, date, {_chain(_chain('headline', _CLEAN), _NORMAL)} AS headline
            FROM articles WHERE {_REASON} = 'valid'),
kept AS (SELECT * FROM cleaned WHERE length(headline) >= 50)"""


def _hits(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(headline), '{w.lower()}') AS DOUBLE)" for w in words)


CTE["rated"] = CTE["cleaned"] + f""",
hits AS (SELECT *, exp({_hits(news.POSITIVE)}) AS ep, exp({_hits(news.NEGATIVE)}) AS en FROM kept),
rated AS (SELECT article_id, symbol, date, headline, ep / (ep + 1 + en) AS sentiment_positive, 1 / (ep + 1 + en) AS sentiment_neutral,
          en / (ep + 1 + en) AS sentiment_negative, ep / (ep + 1 + en) - en / (ep + 1 + en) AS sentiment_compound,
          greatest(ep, 1e0, en) / (ep + 1 + en) AS confidence FROM hits)"""


def rated(spark, sf):
    return news.score_lexicon(news.clean_articles(articles(spark, sf)))


@query("clean_headlines", with_sql("articles", f"SELECT article_id, {_chain('headline', _CLEAN)} AS headline FROM articles"))
def _(spark, sf):
    return articles(spark, sf).select("article_id", text.clean_headline(F.col("headline")).alias("headline"))


@query(
    "normalised_headlines",
    with_sql("articles", f"SELECT article_id, {_chain(_chain('headline', _CLEAN), _NORMAL)} AS headline FROM articles"),
)
def _(spark, sf):
    return articles(spark, sf).select("article_id", text.normalise_headline(F.col("headline")).alias("headline"))


@query("quality_reasons", with_sql("articles", f"SELECT article_id, {_REASON} AS quality_reason FROM articles"))
def _(spark, sf):
    return news.with_quality_reason(articles(spark, sf)).select("article_id", "quality_reason")


@query("clean_articles", with_sql("cleaned", "SELECT article_id, symbol, date, headline FROM kept"))
def _(spark, sf):
    return news.clean_articles(articles(spark, sf)).select("article_id", "symbol", "date", "headline")


@query(
    "finance_related",
    with_sql(
        "articles",
        "SELECT article_id, " + " OR ".join(f"contains(lower(headline), '{w}')" for w in text.FINANCE_WORDS)
        + " AS finance_related, contains(lower(headline), 'quarter') AS mentions_quarter FROM articles",
    ),
)
def _(spark, sf):
    h = F.col("headline")
    return articles(spark, sf).select(
        "article_id", text.finance_related(h).alias("finance_related"),
        text.contains_any(F.lower(h), ["quarter"]).alias("mentions_quarter"),
    )


@query(
    "distinct_articles",
    with_sql(
        "articles",
        """SELECT date, symbol, headline, min(article_id) AS article_id, 'http://news.example.com/' || min(article_id) AS url
           FROM articles GROUP BY date, symbol, headline""",
    ),
)
def _(spark, sf):
    a = articles(spark, sf)
    return news.distinct_articles(a.withColumn("url", F.concat(F.lit("http://news.example.com/"), F.col("article_id"))))


@query("sampled_articles", with_sql("articles", "SELECT article_id, symbol, date FROM articles WHERE substr(md5(CAST(article_id AS VARCHAR)), 1, 5) < '4cccd'"))
def _(spark, sf):
    """A repeatable 30 % sample by hash of the article id (a sampling operator)."""
    return news.sample_articles(articles(spark, sf), 0.3).select("article_id", "symbol", "date")


# ---- relevance ----


def _company_sql(symbol: str) -> tuple[str, str]:
    """Score and evidence of one company as SQL over ``t`` (the lower-cased headline)."""
    info = DICTIONARY[symbol]

    def found(category: str) -> str:
        return f"list_filter({quoted(info.get(category, []))}, lambda x: contains(t, x))"

    executives = info.get("executives", [])
    weights = " ".join(
        f"WHEN contains(t, '{n}') THEN {'5e-1' if any(e in n for e in executives) else '6e-1'}" for n in info.get("names", [])
    )
    name = f"CASE {weights} ELSE 0e0 END" if weights else "0e0"
    base = (
        f"({name} + least(4e-1, len({found('products')}) * 15e-2) + CASE WHEN len({found('executives')}) > 0 THEN 3e-1 ELSE 0e0 END"
        f" + CASE WHEN len({found('aliases')}) > 0 THEN 25e-2 ELSE 0e0 END + least(15e-2, len({found('sector_keywords')}) * 5e-2))"
    )
    score = f"({base} + CASE WHEN {base} > 0 AND fin THEN 1e-1 ELSE 0e0 END + CASE WHEN {base} > 0 AND stk THEN 5e-2 ELSE 0e0 END)"

    def labelled(label: str, values: str) -> str:
        return f"list_transform({values}, lambda x: '{label}:' || x)"

    evidence = (
        f"list_concat({labelled('company_name', found('names') + '[1:1]')}, {labelled('product', found('products'))},"
        f" {labelled('executive', found('executives') + '[1:1]')}, {labelled('ticker', found('aliases') + '[1:1]')},"
        f" {labelled('sector', found('sector_keywords'))}, CASE WHEN {base} > 0 AND fin THEN ['financial_context'] ELSE []::VARCHAR[] END,"
        f" CASE WHEN {base} > 0 AND stk THEN ['stock_context'] ELSE []::VARCHAR[] END)"
    )
    refused = f"{found('negative_keywords')}[1]"
    return (
        f"SELECT article_id, symbol AS assigned, date, headline, '{symbol}' AS company, {score} AS score, {evidence} AS ev, {refused} AS refused FROM lowered"
    , symbol)


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


CTE["verdicts"] = CTE["articles"] + f""",
lowered AS (SELECT *, {_any(rel.FINANCE_CONTEXT)} AS fin, {_any(rel.STOCK_CONTEXT)} AS stk FROM (SELECT *, lower(headline) AS t FROM articles)),
evidence AS ({' UNION ALL '.join(_company_sql(s)[0] for s in DICTIONARY)}),
verdicts AS (SELECT article_id, assigned, date, headline, company, refused IS NULL AND score >= 15e-2 AS accepted,
  CASE WHEN refused IS NOT NULL THEN 1e-1 ELSE least(1e0, score) END AS confidence,
  CASE WHEN refused IS NOT NULL THEN 'negative_keyword:' || refused
       WHEN score >= 5e-1 THEN 'highly_relevant:' || array_to_string(ev[1:3], ',') WHEN score >= 3e-1 THEN 'relevant:' || array_to_string(ev[1:3], ',')
       WHEN score >= 15e-2 THEN 'likely_relevant:' || array_to_string(ev[1:2], ',') WHEN score >= 5e-2 THEN 'weak_relevance:' || array_to_string(ev[1:1], ',')
       ELSE 'no_relevance_found' END AS reason FROM evidence),
own AS (SELECT a.*, coalesce(v.accepted, true) AS is_relevant, coalesce(v.confidence, 5e-1) AS relevance_confidence,
        coalesce(v.reason, 'ticker_not_in_database') AS validation_reason
        FROM articles a LEFT JOIN verdicts v ON v.article_id = a.article_id AND v.company = a.symbol)"""


@query(
    "relevance_scores",
    with_sql("verdicts", f"SELECT article_id, symbol, is_relevant, {rnd('relevance_confidence')} AS relevance_confidence, validation_reason FROM own"),
)
def _(spark, sf):
    s = rel.score_relevance(articles(spark, sf), DICTIONARY)
    return pick(s, ["article_id", "symbol", "is_relevant", "validation_reason"], ["relevance_confidence"])


@query(
    "detected_companies",
    with_sql(
        "verdicts",
        "SELECT article_id, string_agg(company, ',' ORDER BY confidence DESC, company) AS companies, count(*) AS found FROM verdicts"
        " WHERE accepted AND confidence > 2e-1 GROUP BY article_id",
    ),
)
def _(spark, sf):
    d = rel.detect_companies(articles(spark, sf), DICTIONARY).filter(F.size("detected") > 0)
    return d.select(
        "article_id", F.array_join("detected.symbol", ",").alias("companies"), F.size("detected").cast("bigint").alias("found")
    )


@query(
    "multi_company_records",
    with_sql(
        "verdicts",
        f"""SELECT article_id, symbol, {rnd('relevance_confidence')} AS relevance_confidence, validation_reason, 'news_validated' AS source
            FROM own WHERE is_relevant
            UNION ALL SELECT article_id, company, {rnd('confidence')}, 'multi_ticker_detected', 'multi_ticker_assignment'
            FROM verdicts WHERE accepted AND confidence > 4e-1 AND company <> assigned""",
    ),
)
def _(spark, sf):
    f = rel.fan_out(articles(spark, sf), DICTIONARY)
    return pick(f, ["article_id", "symbol", "validation_reason", "source"], ["relevance_confidence"])


@query(
    "validated_articles",
    with_sql(
        CTE["verdicts"].replace("own AS (", "own AS MATERIALIZED (") + """, guard AS MATERIALIZED (SELECT avg(CAST(is_relevant AS DOUBLE)) < 5e-1 AS g FROM own)""",
        f"""SELECT article_id, symbol, NOT g AS validated, CASE WHEN g THEN NULL ELSE {rnd('relevance_confidence')} END AS relevance_confidence
            FROM own, guard WHERE is_relevant OR g""",
    ),
)
def _(spark, sf):
    v = rel.validate_articles(articles(spark, sf), DICTIONARY)
    return pick(v, ["article_id", "symbol", "validated"], ["relevance_confidence"])


@query(
    "rejection_reasons",
    with_sql(
        "verdicts",
        """SELECT split_part(validation_reason, ':', 1) AS reason, count(*) AS articles FROM own WHERE NOT is_relevant
           GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
    ),
)
def _(spark, sf):
    return rel.rejection_histogram(rel.score_relevance(articles(spark, sf), DICTIONARY))


@query(
    "validation_summary",
    with_sql(
        "verdicts",
        f"""SELECT count(*) AS total_articles, count(*) FILTER (is_relevant) AS validated_articles, count(*) FILTER (NOT is_relevant) AS rejected_articles,
            count(*) FILTER (CAST(is_relevant AS INT) + coalesce(n, 0) > 1) AS multi_ticker_articles,
            {rnd('avg(CAST(is_relevant AS DOUBLE)) * 100')} AS retention_pct, {rnd('avg(relevance_confidence) FILTER (is_relevant)')} AS mean_confidence,
            {rnd('stddev_pop(relevance_confidence) FILTER (is_relevant)')} AS std_confidence
            FROM own LEFT JOIN (SELECT article_id, count(*) AS n FROM verdicts WHERE accepted AND confidence > 4e-1 AND company <> assigned GROUP BY 1)
            USING (article_id)""",
    ),
)
def _(spark, sf):
    s = rel.validation_summary(articles(spark, sf), DICTIONARY)
    return pick(
        s, ["total_articles", "validated_articles", "rejected_articles", "multi_ticker_articles"],
        ["retention_pct", "mean_confidence", "std_confidence"],
    )


# ---- scoring and daily aggregation ----

_SCORED = ["sentiment_compound", "sentiment_positive", "sentiment_neutral", "sentiment_negative", "confidence"]


@query("lexicon_scores", with_sql("rated", pick_sql("rated", ["article_id"], _SCORED)))
def _(spark, sf):
    return pick(rated(spark, sf), ["article_id"], _SCORED)


def _load_counter():
    """A stand-in for a loaded classifier: class probabilities from plain word counts."""

    def predict(texts: pd.Series) -> pd.DataFrame:
        up = texts.str.count("exceeded|improved").to_numpy(dtype=float)
        down = texts.str.count("NOT_|FAILED_TO_").to_numpy(dtype=float)
        total = up + down + 1.0
        return pd.DataFrame({"positive": up / total, "neutral": 1.0 / total, "negative": down / total})

    return predict


_COUNT = "length(regexp_replace(headline, '{p}', '\\0#', 'g')) - length(headline)"


@query(
    "model_scores",
    with_sql(
        "cleaned",
        f"""SELECT article_id, {rnd('(u - d) / (u + d + 1e0)')} AS sentiment_compound, {rnd('greatest(u, d, 1) / (u + d + 1e0)')} AS confidence
            FROM (SELECT article_id, {_COUNT.format(p='exceeded|improved')} AS u, {_COUNT.format(p='NOT_|FAILED_TO_')} AS d FROM kept)""",
    ),
)
def _(spark, sf):
    s = news.score_with_model(news.clean_articles(articles(spark, sf)).select("article_id", "headline"), _load_counter)
    return pick(s, ["article_id"], ["sentiment_compound", "confidence"])


_W = " ".join(f"OR contains(lower(headline), '{w}')" for w in text.QUALITY_WORDS).removeprefix("OR ")
_QUALITY = f"""(CASE WHEN length(headline) BETWEEN 80 AND 150 THEN 115e-2 WHEN length(headline) BETWEEN 50 AND 200 THEN 105e-2 ELSE 1e0 END
  * CASE WHEN {_W} THEN 12e-1 ELSE 1e0 END * CASE WHEN regexp_matches(headline, '\\d+\\.?\\d*%') THEN 11e-1 ELSE 1e0 END
  * CASE WHEN regexp_matches(headline, '\\$\\d+') THEN 105e-2 ELSE 1e0 END
  * CASE WHEN confidence > 85e-2 THEN 115e-2 WHEN confidence > 75e-2 THEN 105e-2 ELSE 1e0 END
  * CASE WHEN length(headline) < 40 OR length(headline) > 250 THEN 9e-1 ELSE 1e0 END)"""


@query("quality_weights", with_sql("rated", f"SELECT article_id, {rnd(_QUALITY)} AS quality_weight FROM rated"))
def _(spark, sf):
    w = rated(spark, sf).withColumn("quality_weight", text.quality_weight(F.col("headline"), F.col("confidence")))
    return pick(w, ["article_id"], ["quality_weight"])


_MEANS = ["sentiment_compound", "sentiment_positive", "sentiment_neutral", "sentiment_negative"]


@query(
    "daily_sentiment",
    with_sql(
        "rated",
        "SELECT symbol, date, "
        + ", ".join(f"{rnd(f'sum({c} * confidence * q) / sum(confidence * q)')} AS {c}" for c in _MEANS)
        + f""", {rnd('sum(confidence * q) / sum(q)')} AS confidence, count(*) AS article_count,
            {rnd('coalesce(stddev_samp(confidence), 0)', 5)} AS confidence_std, {rnd('coalesce(stddev_samp(sentiment_compound), 0)', 5)} AS sentiment_std,
            {rnd('avg(q)')} AS avg_quality_weight, 5e-1 AS avg_relevance_confidence, true AS weighted_aggregation, false AS ticker_validated
            FROM (SELECT *, {_QUALITY} AS q FROM rated) GROUP BY symbol, date""",
    ),
)
def _(spark, sf):
    d = news.daily_sentiment(rated(spark, sf))
    d = d.withColumns({c: F.round(c, 5) for c in ("confidence_std", "sentiment_std")})
    return pick(
        d, ["symbol", "date", "article_count", "confidence_std", "sentiment_std", "weighted_aggregation", "ticker_validated"],
        [*_MEANS, "confidence", "avg_quality_weight", "avg_relevance_confidence"],
    )


@query(
    "validated_daily_sentiment",
    with_sql(
        CTE["rated"] + ", " + CTE["verdicts"].removeprefix(CTE["articles"] + ",\n").replace("FROM articles)", "FROM rated)").replace("FROM articles a", "FROM rated a")
        + f""", guard AS (SELECT avg(CAST(is_relevant AS DOUBLE)) < 5e-1 AS g FROM own),
        weighted AS (SELECT own.*, g, {_QUALITY} * CASE WHEN NOT g AND relevance_confidence > 5e-1 THEN 11e-1 ELSE 1e0 END AS q
                     FROM own, guard WHERE is_relevant OR g)""",
        f"""SELECT symbol, date, {rnd('sum(sentiment_compound * confidence * q) / sum(confidence * q)')} AS sentiment_compound,
            {rnd('avg(CASE WHEN NOT g THEN relevance_confidence ELSE 5e-1 END)')} AS avg_relevance_confidence, bool_or(NOT g) AS ticker_validated,
            count(*) AS article_count FROM weighted GROUP BY symbol, date""",
    ),
)
def _(spark, sf):
    d = news.daily_sentiment(rel.validate_articles(rated(spark, sf), DICTIONARY))
    return pick(d, ["symbol", "date", "ticker_validated", "article_count"], ["sentiment_compound", "avg_relevance_confidence"])


@query("plain_daily_sentiment", with_sql("daily", pick_sql("daily", ["symbol", "date", "article_count"], [*_MEANS, "confidence"])))
def _(spark, sf):
    return pick(daily(spark, sf), ["symbol", "date", "article_count"], [*_MEANS, "confidence"])


_LIMIT = """stats AS (SELECT least(greatest(6e-1, avg(confidence) - 5e-1 * stddev_pop(confidence)), 7e-1) AS t,
    quantile_cont(confidence, 3e-1) AS p30 FROM {s}),
  final AS (SELECT CASE WHEN (SELECT avg(CAST(confidence >= t AS DOUBLE)) FROM {s}, stats) < 7e-1 THEN p30 ELSE t END AS t FROM stats)"""


@query(
    "adaptive_confidence",
    f"WITH {CTE['scored']}, {_LIMIT.format(s='scored')} SELECT article_id, {rnd('confidence')} AS confidence, {rnd('t')} AS threshold FROM scored, final WHERE confidence >= t",
)
def _(spark, sf):
    s = scored(spark, sf)
    limit = news.adaptive_threshold(s)
    return pick(s.filter(F.col("confidence") >= limit).withColumn("threshold", F.lit(limit)), ["article_id"], ["confidence", "threshold"])


@query(
    "adaptive_confidence_lexicon",
    f"WITH {CTE['rated']}, {_LIMIT.format(s='rated')} SELECT article_id, {rnd('confidence')} AS confidence FROM rated, final WHERE confidence >= t - 1e-12",
)
def _(spark, sf):
    return pick(news.filter_confidence(rated(spark, sf)), ["article_id"], ["confidence"])


def _classes(source: str, bound: str) -> str:
    return f"""SELECT sentiment_class, n AS rows, {rnd('n * 100e0 / sum(n) OVER ()')} AS pct FROM (
      SELECT CASE WHEN sentiment_compound > {bound} THEN 'positive' WHEN sentiment_compound < -{bound} THEN 'negative' ELSE 'neutral' END AS sentiment_class,
      count(*) AS n FROM {source} GROUP BY 1)"""


@query("article_classes", with_sql("scored", _classes("scored", "1e-1")))
def _(spark, sf):
    return pick(news.class_histogram(scored(spark, sf)), ["sentiment_class", "rows"], ["pct"])


@query("day_classes", with_sql("daily", _classes("daily", "5e-2")))
def _(spark, sf):
    return pick(news.class_histogram(daily(spark, sf), news.DAY_CLASS_BOUND), ["sentiment_class", "rows"], ["pct"])


@query(
    "sentiment_averages",
    with_sql(
        "daily",
        "SELECT symbol, date, "
        + ", ".join(
            rnd(f"avg(sentiment_compound) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
            + f" AS sentiment_ma_{n}d" for n in (3, 7, 14)
        )
        + " FROM daily",
    ),
)
def _(spark, sf):
    return pick(ind.sentiment_averages(daily(spark, sf)), ["symbol", "date"], [f"sentiment_ma_{n}d" for n in (3, 7, 14)])


@query(
    "smoothed_sentiment",
    f"""WITH {CTE['daily']}, seq AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM daily)
    SELECT a.symbol, a.date, {rnd('sum(b.sentiment_compound * pow(7e-1, a.k - b.k)) / sum(pow(7e-1, a.k - b.k))')} AS sentiment_compound,
           {rnd('any_value(a.sentiment_compound)')} AS sentiment_original, any_value(n > 1) AS smoothed
    FROM seq a JOIN seq b ON a.symbol = b.symbol AND b.k <= a.k JOIN (SELECT symbol, count(*) AS n FROM daily GROUP BY 1) c ON c.symbol = a.symbol
    GROUP BY a.symbol, a.date""",
)
def _(spark, sf):
    s = ind.smooth_sentiment(daily(spark, sf))
    return pick(s, ["symbol", "date", "smoothed"], ["sentiment_compound", "sentiment_original"])


# ---- joins ----

_MA = [f"sentiment_ma_{n}d" for n in (3, 7, 14)]
CTE["averaged"] = CTE["daily"] + """,
averaged AS (SELECT *, """ + ", ".join(
    f"avg(sentiment_compound) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS sentiment_ma_{n}d"
    for n in (3, 7, 14)
) + " FROM daily)"


@query(
    "integrated_sentiment",
    f"WITH {CTE['bars']}, {CTE['averaged']} SELECT b.symbol, b.date, coalesce(article_count, 0) AS article_count, "
    + ", ".join(f"{rnd(f'coalesce({c}, 0)')} AS {c}" for c in ["sentiment_compound", "sentiment_positive", "sentiment_negative", *_MA])
    + f", {rnd('coalesce(confidence, 5e-1)')} AS sentiment_confidence, CASE WHEN d.symbol IS NULL THEN 'none' ELSE 'news' END AS source"
    + " FROM bars b LEFT JOIN averaged d ON d.symbol = b.symbol AND d.date = b.date",
)
def _(spark, sf):
    j = joins.attach_sentiment(bars(spark, sf), daily(spark, sf))
    return pick(
        j, ["symbol", "date", "article_count", "source"],
        ["sentiment_compound", "sentiment_positive", "sentiment_negative", *_MA, "sentiment_confidence"],
    )


@query(
    "news_history",
    f"""WITH {CTE['bars']}, {CTE['daily']} SELECT b.symbol, b.date, count(d.date) AS history_rows, max(d.date) AS last_news
    FROM bars b LEFT JOIN daily d ON d.symbol = b.symbol AND d.date <= b.date GROUP BY b.symbol, b.date""",
)
def _(spark, sf):
    return joins.history_rows(bars(spark, sf), daily(spark, sf))


@query(
    "asof_sentiment",
    f"""WITH {CTE['bars']}, {CTE['daily']} SELECT b.symbol, b.date, {rnd('d.sentiment_compound')} AS sentiment_compound
    FROM bars b ASOF LEFT JOIN daily d ON d.symbol = b.symbol AND b.date >= d.date""",
)
def _(spark, sf):
    market = bars(spark, sf).select("symbol", "date")
    return pick(windows.asof_attach(market, daily(spark, sf), ["sentiment_compound"]), ["symbol", "date"], ["sentiment_compound"])


@query(
    "symbol_coverage",
    f"""WITH {CTE['bars']}, {CTE['articles']}, m AS (SELECT DISTINCT symbol FROM bars), s AS (SELECT DISTINCT symbol FROM articles)
    SELECT coalesce(m.symbol, s.symbol) AS symbol, CASE WHEN m.symbol IS NULL THEN 'sentiment_only' WHEN s.symbol IS NULL THEN 'market_only' ELSE 'both' END AS coverage
    FROM m FULL JOIN s USING (symbol)""",
)
def _(spark, sf):
    return joins.symbol_coverage(bars(spark, sf), articles(spark, sf))


@query(
    "join_coverage",
    f"""WITH {CTE['bars']}, {CTE['daily']} SELECT b.symbol, count(*) AS records, count(d.symbol) AS matched, {rnd('count(d.symbol) * 100e0 / count(*)')} AS coverage_pct
    FROM bars b LEFT JOIN daily d ON d.symbol = b.symbol AND d.date = b.date GROUP BY b.symbol""",
)
def _(spark, sf):
    return pick(joins.join_coverage(bars(spark, sf), daily(spark, sf)), ["symbol", "records", "matched"], ["coverage_pct"])


@query(
    "saved_splits",
    with_sql(
        "bars",
        """SELECT symbol, date, CASE WHEN date >= DATE '2000-06-01' THEN 'test' WHEN date >= DATE '1999-01-01' THEN 'val'
           WHEN date < DATE '1998-01-01' THEN 'train' END AS split FROM bars""",
    ),
)
def _(spark, sf):
    """Split names from saved key tables; the later tables overlap and win, one gap stays open."""
    keys = bars(spark, sf).select("symbol", "date")
    parts = [
        ("train", keys.filter(F.col("date") < "1998-01-01")), ("val", keys.filter(F.col("date") >= "1999-01-01")),
        ("test", keys.filter(F.col("date") >= "2000-06-01")),
    ]
    return joins.assign_saved_splits(keys, *parts)


@query(
    "aligned_features",
    f"""WITH {CTE['bars']}, {CTE['daily']} SELECT b.symbol, b.date, {rnd('coalesce(d.confidence, 0)')} AS confidence
    FROM bars b LEFT JOIN daily d ON d.symbol = b.symbol AND d.date = b.date""",
)
def _(spark, sf):
    features = daily(spark, sf).select("symbol", "date", "confidence")
    return pick(joins.attach_features(bars(spark, sf).select("symbol", "date"), features), ["symbol", "date"], ["confidence"])


@query(
    "distinct_days",
    with_sql("scored", "SELECT DISTINCT symbol, date FROM scored"),
)
def _(spark, sf):
    return require_columns(scored(spark, sf), ["symbol", "date"]).select("symbol", "date").dropDuplicates()


@query(
    "symbols_without_news",
    f"WITH {CTE['bars']}, {CTE['articles']} SELECT symbol FROM bars EXCEPT SELECT symbol FROM articles",
)
def _(spark, sf):
    return bars(spark, sf).select("symbol").subtract(articles(spark, sf).select("symbol"))


@query(
    "symbols_with_news",
    f"WITH {CTE['bars']}, {CTE['articles']} SELECT symbol FROM bars INTERSECT SELECT symbol FROM articles",
)
def _(spark, sf):
    return bars(spark, sf).select("symbol").intersect(articles(spark, sf).select("symbol"))


# ---- how the scores of a day lie ----

_QUARTERS = "quantile_cont(sentiment_compound, 75e-2) - quantile_cont(sentiment_compound, 25e-2)"
_SHAPE = {
    "sentiment_mean": "avg(sentiment_compound)", "sentiment_std": "coalesce(stddev_samp(sentiment_compound), 0)",
    "sentiment_skewness": "CASE WHEN max(sentiment_compound) > min(sentiment_compound) AND count(*) > 2 THEN skewness(sentiment_compound) END",
    "sentiment_range": "max(sentiment_compound) - min(sentiment_compound)", "sentiment_median": "quantile_cont(sentiment_compound, 5e-1)", "sentiment_iqr": _QUARTERS,
}


@query(
    "daily_sentiment_shape",
    f"""WITH {CTE['scored']}, timed AS (SELECT s.* REPLACE (CAST(e.ts AS DATE) AS date) FROM scored s JOIN events e ON e.event_id = s.article_id)
    SELECT symbol, date, count(*) AS article_count, {', '.join(f'{rnd(e, 5)} AS {n}' for n, e in _SHAPE.items())} FROM timed GROUP BY symbol, date""",
)
def _(spark, sf):
    """Median, quartile distance, skewness and range of a symbol's articles on the day of the event."""
    timed = scored_from(table(spark, sf, "events"), "ts").withColumn("date", F.col("ts").cast("date"))
    return pick(grouped.sentiment_shape(timed), ["symbol", "date", "article_count"], list(_SHAPE), 5)


@query(
    "symbol_sentiment_shape",
    f"WITH {CTE['scored']} SELECT symbol, count(*) AS article_count, {', '.join(f'{rnd(e, 5)} AS {n}' for n, e in _SHAPE.items())} FROM scored GROUP BY symbol",
)
def _(spark, sf):
    return pick(grouped.sentiment_shape(scored(spark, sf), ["symbol"]), ["symbol", "article_count"], list(_SHAPE), 5)
