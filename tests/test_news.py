"""Cleaning, relevance and aggregation against plain Python on small fixtures."""

import re
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import text
from tapeloom.operators import news, relevance as rel
from tapeloom.sources import schemas, standardize

from .conftest import day

DICTIONARY = {
    "ACME": {
        "names": ["acme corp", "jane doe"], "products": ["rocket", "anvil", "skates", "glue"], "executives": ["jane doe", "rob roe"],
        "aliases": ["acme", "$acme"], "sector_keywords": ["mining", "tools", "steel", "safety"], "negative_keywords": ["acme peak"],
    },
    "BOLT": {"names": ["bolt inc"], "products": ["drill"], "executives": [], "aliases": ["$bolt"], "sector_keywords": ["tools"]},
}
HEADLINES = [
    "Acme Corp earnings beat with rocket sales", "Jane Doe leaves", "acme peak hike for tourists", "steel and tools and mining and safety",
    "bolt inc and acme corp shares rise", "nothing at all here", "rocket anvil skates glue", "tools", "drill stock outlook", "$BOLT $ACME",
    "rob roe buys steel from bolt inc after quarterly results", "",
]


def by_hand(headline, symbol):
    """Straight reading of the scoring rules."""
    if symbol not in DICTIONARY:
        return True, 0.5, "ticker_not_in_database"
    h, info = headline.lower(), DICTIONARY[symbol]
    bad = [k for k in info.get("negative_keywords", []) if k in h]
    if bad:
        return False, 0.1, "negative_keyword:" + bad[0]
    hits = {c: [t for t in info.get(c, []) if t in h] for c in info}
    score, seen = 0.0, []
    if hits["names"]:
        score += 0.5 if any(e in hits["names"][0] for e in info["executives"]) else 0.6
        seen.append("company_name:" + hits["names"][0])
    score += min(0.4, 0.15 * len(hits["products"]))
    seen += ["product:" + p for p in hits["products"]]
    for c, label, weight in (("executives", "executive", 0.3), ("aliases", "ticker", 0.25)):
        if hits[c]:
            score += weight
            seen.append(f"{label}:{hits[c][0]}")
    score += min(0.15, 0.05 * len(hits["sector_keywords"]))
    seen += ["sector:" + s for s in hits["sector_keywords"]]
    if score > 0 and any(w in h for w in rel.FINANCE_CONTEXT):
        score += 0.1
        seen.append("financial_context")
    if score > 0 and any(w in h for w in rel.STOCK_CONTEXT):
        score += 0.05
        seen.append("stock_context")
    for limit, label, n in ((0.5, "highly_relevant", 3), (0.3, "relevant", 3), (0.15, "likely_relevant", 2), (0.05, "weak_relevance", 1)):
        if score >= limit:
            return limit >= 0.15, min(1.0, score), f"{label}:{','.join(seen[:n])}"
    return False, min(1.0, score), "no_relevance_found"


@pytest.fixture
def headlines(spark):
    rows = [(i * 10 + j, s, h) for i, h in enumerate(HEADLINES) for j, s in enumerate(("ACME", "BOLT", "OTHER"))]
    return spark.createDataFrame(rows, "article_id bigint, symbol string, headline string")


def test_relevance_follows_the_rules(headlines):
    for r in rel.score_relevance(headlines, DICTIONARY).collect():
        accepted, confidence, reason = by_hand(r.headline, r.symbol)
        assert (r.is_relevant, r.validation_reason) == (accepted, reason), r
        assert r.relevance_confidence == pytest.approx(confidence)


def test_detection_orders_by_confidence(headlines):
    for r in rel.detect_companies(headlines, DICTIONARY).collect():
        found = [(s, by_hand(r.headline, s)) for s in DICTIONARY]
        want = sorted([(-c, s) for s, (ok, c, _) in found if ok and c > 0.2])
        assert [d.symbol for d in r.detected] == [s for _, s in want]


def test_fan_out_keeps_valid_assignments_only(headlines):
    got = {(r.article_id, r.symbol) for r in rel.fan_out(headlines, DICTIONARY).collect()}
    want = set()
    for r in headlines.collect():
        if by_hand(r.headline, r.symbol)[0]:
            want.add((r.article_id, r.symbol))
        want |= {(r.article_id, s) for s in DICTIONARY if s != r.symbol and by_hand(r.headline, s)[0] and by_hand(r.headline, s)[1] > 0.4}
    assert got == want


def test_guard_returns_everything_when_too_few_survive(spark):
    bad = spark.createDataFrame([(i, "ACME", "nothing here") for i in range(4)] + [(9, "ACME", "acme corp")], "article_id bigint, symbol string, headline string")
    kept = rel.validate_articles(bad, DICTIONARY)
    assert kept.count() == 5 and kept.filter("validated").count() == 0
    good = bad.filter("article_id > 2")
    assert rel.validate_articles(good, DICTIONARY).select("article_id").collect()[0][0] == 9


def test_terms_of_both_forms_of_a_dictionary(spark):
    terms = spark.createDataFrame([("ACME", "names", "b", 1), ("ACME", "names", "a", 0), ("ACME", "names", "", 2)], "symbol string, category string, term string, ord int")
    by_hand = sorted(tuple(r) for r in rel.term_table(spark, {"ACME": {"names": ["a", "b", ""]}}).collect())
    assert sorted(tuple(r) for r in rel.term_table(spark, terms).collect()) == by_hand == [("ACME", "names", "a", 0), ("ACME", "names", "b", 1)]


def test_cleaning(spark):
    raw = "  <p>Naïve  $AAPL beats estimates: +5.2% — see http://x.y/z?a=1 NASDAQ:MSFT not good, revenue $5B #tag  "
    row = spark.createDataFrame([(raw,)], "h string").select(text.clean_headline(F.col("h")).alias("c"), text.normalise_headline(F.col("h")).alias("n")).first()
    assert row.c == "Naïve $AAPL beats estimates: 5.2%  see NASDAQ:MSFT not good, revenue $5B tag"
    assert "TICKER_AAPL exceeded expectations" in row.n and "TICKER_MSFT NOT_good" in row.n and "DOLLAR_5B" in row.n and " 5.2% " in row.n


def test_null_headline_is_too_short(spark):
    df = spark.createDataFrame([(None,), ("x" * 501,), (" " * 60,), ("click HERE " + "y" * 60,), ("z" * 60,)], "headline string")
    assert [r.quality_reason for r in news.with_quality_reason(df).collect()] == ["too_short", "too_long", "empty", "spam", "valid"]


def test_adaptive_threshold_by_hand(spark):
    conf = spark.createDataFrame([(c,) for c in (0.9, 0.8, 0.65, 0.62, 0.55)], "confidence double")
    assert news.adaptive_threshold(conf) == pytest.approx(0.626)
    assert sorted(r[0] for r in news.filter_confidence(conf).collect()) == [0.65, 0.8, 0.9]
    assert news.adaptive_threshold(conf, adaptive=False) == 0.7


def test_daily_sentiment_of_a_single_article(spark):
    df = spark.createDataFrame(
        [("A", "2020-01-01", "h" * 100, 0.5, 0.6, 0.3, 0.1, 0.8)],
        "symbol string, date string, headline string, sentiment_compound double, sentiment_positive double, sentiment_neutral double, sentiment_negative double, confidence double",
    )
    r = news.daily_sentiment(df).first()
    assert (r.sentiment_std, r.confidence_std, r.article_count, r.ticker_validated) == (0.0, 0.0, 1, False)
    assert r.avg_quality_weight == pytest.approx(1.15 * 1.05) and r.sentiment_compound == pytest.approx(0.5)


def test_sampling_is_repeatable(spark):
    df = spark.range(10_000).withColumnRenamed("id", "article_id")
    a = {r[0] for r in news.sample_articles(df, 0.3).collect()}
    b = {r[0] for r in news.sample_articles(df.repartition(13), 0.3).collect()}
    assert a == b and 2_700 < len(a) < 3_300


def test_name_clash_is_an_error(spark):
    df = spark.createDataFrame([("a", "b")], "ticker string, Symbol2 string").withColumnRenamed("Symbol2", "stock_symbol")
    with pytest.raises(ValueError, match="symbol"):
        standardize.standardize_names(df)


def test_stage_detection_and_missing_columns(spark):
    df = spark.createDataFrame([("2020/01/02", "brk.a ", "Hello  <World>!")], "Date string, Stock_symbol string, Article_title string")
    assert standardize.detect_stage(df) == "raw_news" and schemas.missing_columns(df, "raw_news") == []
    row = standardize.standardize(df).first()
    assert (row.date, row.symbol, row.headline) == ("2020-01-02", "BRKA", "Hello World!")
    with pytest.raises(ValueError):
        schemas.require_columns(df, ["nope"])


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("x (y)", "x.y", "(-)")
    assert standardize.clean_names(df).columns == ["x_y", "column_2"]


def test_spam_list_is_lower_case():
    assert all(p == p.lower() and re.sub(r"\s+", " ", p) == p for p in text.SPAM_PHRASES)


def test_each_article_is_cleaned_and_scored_once(spark):
    from tapeloom.plans.market_news import news_sentiment

    seen = spark.sparkContext.accumulator(0)

    def load():
        def predict(texts):
            seen.add(len(texts))
            return pd.DataFrame({"positive": 0.8, "neutral": 0.1, "negative": 0.1}, index=texts.index)

        return predict

    rows = [(i, "A", day(i % 3), f"Acme reports strong quarterly results number {i} today") for i in range(40)]
    articles = spark.createDataFrame(rows, "article_id bigint, symbol string, date date, headline string")
    daily = news_sentiment(articles, {"A": {"names": ["acme"]}}, lambda a: news.score_with_model(a, load))
    assert sum(r.article_count for r in daily.collect()) == 40 and seen.value == 40


def test_every_accepted_date_layout(spark):
    from tapeloom.sources.standardize import parse_date

    same = [
        "2020-06-05 06:30:54 UTC", "2020-06-05T06:30:54Z", "2020-06-05T06:30:54.123+00:00", "2020-06-05 06:30:54-0400", "2020-06-05", "2020/06/05",
        "06/05/2020", "6/5/2020", "Jun 5, 2020", "June 5, 2020", "5 Jun 2020", " 2020-06-05 06:30 ",
    ]
    got = spark.createDataFrame([(x,) for x in [*same, "25/12/2020", "some day", None]], "x string").select(parse_date(F.col("x")).alias("d")).collect()
    assert {r.d for r in got[: len(same)]} == {date(2020, 6, 5)}
    assert [r.d for r in got[len(same) :]] == [date(2020, 12, 25), None, None]


def test_distinct_articles_keep_the_whole_row(spark):
    rows = [(2, "A", "d", "h", "second"), (1, "A", "d", "h", "first"), (1, "A", "d", "h", "first"), (3, None, "d", "h", "no symbol"), (4, None, "d", "h", "later")]
    df = spark.createDataFrame(rows, "article_id bigint, symbol string, date string, headline string, url string")
    assert sorted(r.url for r in news.distinct_articles(df).collect()) == ["first", "no symbol"]


def test_a_large_dictionary_is_a_table(spark):
    terms = spark.range(60_000).select(
        F.format_string("S%04d", F.col("id") % 3000).alias("symbol"), F.lit("products").alias("category"),
        F.concat(F.lit("term"), F.col("id")).alias("term"), (F.col("id") / 3000).cast("int").alias("ord"),
    )
    rows = [("S0001", "sells term1 and term3001"), ("S0001", "sells term2"), ("T", "sells term1"), (None, "x")]
    got = rel.score_relevance(spark.createDataFrame(rows, "symbol string, headline string"), terms)
    assert sorted((r.symbol or "", r.is_relevant, r.validation_reason) for r in got.collect()) == [
        ("", True, "ticker_not_in_database"), ("S0001", False, "no_relevance_found"),
        ("S0001", True, "relevant:product:term1,product:term3001"), ("T", True, "ticker_not_in_database"),
    ]


def test_both_forms_of_a_dictionary_agree(spark):
    rows = [(s, c, t, i) for s, info in DICTIONARY.items() for c, ts in info.items() for i, t in enumerate(ts)]
    table = spark.createDataFrame(rows, "symbol string, category string, term string, ord int")
    articles = spark.createDataFrame([(s, h) for h in HEADLINES for s in ("ACME", "BOLT", "X")], "symbol string, headline string")
    a, b = (sorted(map(tuple, rel.score_relevance(articles, d).collect())) for d in (DICTIONARY, table))
    assert a == b


def test_detection_by_a_table_of_any_size(spark):
    """200,000 terms: pieces of a headline meet keys of terms, and only confirmed companies are scored."""
    terms = spark.range(200_000).select(
        F.format_string("S%05d", (F.col("id") % 40_000).cast("int")).alias("symbol"),
        F.element_at(F.array(*map(F.lit, ["names", "products", "aliases", "executives", "sector_keywords"])), (F.col("id") / 40_000).cast("int") + 1).alias("category"),
        F.concat(F.lit("term"), F.col("id"), F.lit("x")).alias("term"), F.lit(0).alias("ord"),
    )
    short = spark.createDataFrame([("TINY", "names", "ab", 0), ("TINY", "products", "", 1), ("NOT", "names", "term7x", 0), ("NOT", "negative_keywords", "ab", 0)], terms.schema)
    headlines = ["Sells TERM7x and term40007x", "cab", "term7", "", None, "term7x ab", "é term199999x é", "term12x term13x " * 200]
    articles = spark.createDataFrame([(i, h) for i, h in enumerate(headlines * 2)], "article_id long, headline string")
    got = {(r.article_id, d.symbol): d.confidence for r in rel.detect_companies(articles, terms.unionByName(short)).collect() for d in r.detected}
    want = {(0, "S00007"): 0.75, (0, "NOT"): 0.6, (1, "TINY"): 0.6, (5, "S00007"): 0.6, (5, "TINY"): 0.6, (7, "S00012"): 0.6, (7, "S00013"): 0.6}
    assert got == {(i + 8 * k, s): pytest.approx(c) for (i, s), c in want.items() for k in range(2)}
    assert rel.detect_companies(articles, terms).count() == 16


def test_detection_in_both_forms_agrees_when_shuffled(spark):
    rows = [(s, c, t, i) for s, info in DICTIONARY.items() for c, ts in info.items() for i, t in enumerate(ts)]
    table = spark.createDataFrame(rows, "symbol string, category string, term string, ord int")
    articles = spark.createDataFrame([(i, h, "kept") for i, h in enumerate([*HEADLINES, *HEADLINES[:3]])], "article_id long, headline string, term string")
    a = sorted((tuple(r) for r in rel.detect_companies(articles, DICTIONARY).collect()), key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = sorted((tuple(r) for r in rel.detect_companies(articles, table).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert a == b and any(r[-1] for r in a)


def test_detection_without_articles_or_terms(spark):
    none = spark.createDataFrame([], "article_id long, headline string")
    assert rel.detect_companies(none, DICTIONARY).count() == 0
    some = spark.createDataFrame([(1, "acme corp")], "article_id long, headline string")
    empty = spark.createDataFrame([], "symbol string, category string, term string, ord int")
    assert [r.detected for r in rel.detect_companies(some, empty).collect()] == [[]]


def test_few_terms_are_found_in_place(spark):
    """A literal dictionary needs no shuffle and no written stage, and agrees with the index."""
    rows = [(i, "ACME", h) for i, h in enumerate([*HEADLINES, None, "ACME CORP Stock"])]
    articles = spark.createDataFrame(rows, "article_id int, symbol string, headline string")
    found = rel.detect_companies(rel.score_relevance(articles, DICTIONARY), DICTIONARY)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "parquet" not in plan.lower()
    table = rel.term_table(spark, DICTIONARY)
    by_index = rel.detect_companies(articles, table).select("article_id", "detected")
    assert sorted(map(tuple, found.select("article_id", "detected").collect())) == sorted(map(tuple, by_index.collect()))


def test_pieces_without_a_term_stay_in_their_task(spark, monkeypatch):
    """With few keys only pieces that are keys are shuffled; with more the join gives the same."""
    texts = spark.createDataFrame([(i, i, h.lower()) for i, h in enumerate(HEADLINES)], "__h long, __g long, __text string")
    few = rel.named_companies(texts, DICTIONARY)
    assert "LeftSemi, BuildRight" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rel, "FEW_KEYS", 3)
    many = rel.named_companies(texts, DICTIONARY)
    assert "LeftSemi" not in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_headlines_are_derived_once(spark):
    """The gate asks for a headline in each of its rules; none of them derives it again."""
    from catalog.base import SUFFIXES, articles

    from .conftest import SF_DIR

    plan = news.clean_articles(articles(spark, SF_DIR))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(SUFFIXES[0]) == 1
