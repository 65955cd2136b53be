"""Which company a headline is about: dictionary evidence, scores and fan-out.

The dictionary is a parameter: ``{symbol: {category: [terms]}}`` with the
categories ``names, products, executives, aliases, sector_keywords,
negative_keywords``, or a table ``(symbol, category, term, ord)`` of any size.
Terms are lower-case and matched as substrings; an empty term matches nothing.

Scoring the assigned symbol is an equi-join with its entry.  All companies of a
headline are found in place when a literal dictionary has few terms.  Any other
one goes through an index: the first ``GRAM`` characters of every term (all of a
shorter one) are a key, and so are all pieces of these lengths of every distinct
headline.  Terms whose key occurs are confirmed in the headline, and only the
companies they belong to are scored there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import evaluate_once
from ..functions.text import contains_any
from ..session import written

# ---- fixed values: evidence weights, caps, bands and context words ----
NAME_WEIGHT, EXECUTIVE_NAME_WEIGHT = 0.6, 0.5
PRODUCT_WEIGHT, PRODUCT_CAP = 0.15, 0.4
EXECUTIVE_WEIGHT, ALIAS_WEIGHT = 0.3, 0.25
SECTOR_WEIGHT, SECTOR_CAP = 0.05, 0.15
FINANCE_BONUS, STOCK_BONUS = 0.1, 0.05
FINANCE_CONTEXT = [
    "earnings", "revenue", "quarterly", "profit", "guidance", "results", "forecast", "outlook", "performance",
    "beats", "misses", "announces",
]
STOCK_CONTEXT = ["stock", "shares", "market cap", "valuation", "price target", "analyst"]
STRONG, CLEAR, LIKELY, WEAK = 0.5, 0.3, 0.15, 0.05
UNKNOWN_CONFIDENCE, NEGATIVE_CONFIDENCE = 0.5, 0.1
DETECT_ABOVE, REASSIGN_ABOVE = 0.2, 0.4
LEAST_RETENTION = 0.5
# ---- end of fixed values ----

CATEGORIES = ["names", "products", "executives", "aliases", "sector_keywords", "negative_keywords"]
Dictionary = dict[str, dict[str, list[str]]]

POSITIVE_CATEGORIES = CATEGORIES[:-1]

#: Characters of a term that serve as its key in the index.
GRAM = 5
#: A literal dictionary of up to so many terms is tried on every headline in place.
FEW_TERMS = 256
#: Up to so many keys go to every task, so pieces without a term are not shuffled.
FEW_KEYS = 200_000


def term_table(spark: SparkSession, dictionary: Dictionary | DataFrame) -> DataFrame:
    """The dictionary as rows ``symbol, category, term, ord`` without empty terms."""
    if not isinstance(dictionary, DataFrame):
        rows = [(s, c, t, i) for s, info in dictionary.items() for c in CATEGORIES for i, t in enumerate(info.get(c, []))]
        dictionary = spark.createDataFrame(rows, "symbol string, category string, term string, ord int")
    return dictionary.select("symbol", "category", "term", "ord").filter(F.length("term") > 0)


def company_table(spark: SparkSession, dictionary: Dictionary | DataFrame) -> DataFrame:
    """One row per symbol with its terms per category, in order, and a weight per name.

    ``dictionary`` is a literal one or a table ``(symbol, category, term, ord)`` of any size.
    """
    if isinstance(dictionary, DataFrame):
        entry = {c: F.when((F.col("category") == c) & (F.length("term") > 0), F.struct("ord", "term")) for c in CATEGORIES}
        lists = dictionary.groupBy("symbol").agg(*[F.array_sort(F.collect_list(e)).alias(c) for c, e in entry.items()])
        table = lists.select("symbol", *[F.transform(c, lambda x: x["term"]).alias(c) for c in CATEGORIES])
    else:
        rows = [(s, *[[t for t in info.get(c, []) if t] for c in CATEGORIES]) for s, info in dictionary.items()]
        table = spark.createDataFrame(rows, "symbol string, " + ", ".join(f"{c} array<string>" for c in CATEGORIES))
    weight = lambda name: F.when(
        F.exists("executives", lambda e: name.contains(e)), EXECUTIVE_NAME_WEIGHT
    ).otherwise(NAME_WEIGHT)
    return table.withColumn("name_weights", F.transform("names", weight))


def _few_companies(dictionary: Dictionary | DataFrame) -> Column | None:
    """The entries of :func:`company_table` as one literal array; None for a table or more than ``FEW_TERMS`` terms."""
    if isinstance(dictionary, DataFrame) or not 0 < sum(len(ts) for info in dictionary.values() for ts in info.values()) <= FEW_TERMS:
        return None
    entries = []
    for symbol, info in dictionary.items():
        terms = {c: [t for t in info.get(c, []) if t] for c in CATEGORIES}
        weights = [EXECUTIVE_NAME_WEIGHT if any(e in n for e in terms["executives"]) else NAME_WEIGHT for n in terms["names"]]
        weights = F.array(*[F.lit(w) for w in weights]).cast("array<double>")
        entries.append(F.struct(F.lit(symbol).alias("symbol"), *[_texts(ts).alias(c) for c, ts in terms.items()], weights.alias("name_weights")))
    return F.array(*entries)


def _texts(terms: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms]).cast("array<string>")


def _found(terms: Column, text: Column) -> Column:
    return F.filter(terms, lambda t: text.contains(t))


def _labelled(label: str, terms: Column) -> Column:
    return F.transform(terms, lambda t: F.concat(F.lit(label + ":"), t))


def _evidence(company: Column, text: Column, finance: Column, stock: Column) -> Column:
    """Score and evidence list of one company for one lower-cased headline."""
    names = F.slice(_found(company["names"], text), 1, 1)
    products = _found(company["products"], text)
    executives = F.slice(_found(company["executives"], text), 1, 1)
    aliases = F.slice(_found(company["aliases"], text), 1, 1)
    sectors = _found(company["sector_keywords"], text)
    refused = F.slice(_found(company["negative_keywords"], text), 1, 1)
    zero = F.lit(0.0)
    name_weight = F.coalesce(
        F.get(company["name_weights"], F.array_position(company["names"], F.get(names, F.lit(0))).cast("int") - 1), zero
    )
    score = (
        name_weight
        + F.least(F.lit(PRODUCT_CAP), F.size(products) * F.lit(PRODUCT_WEIGHT))
        + F.when(F.size(executives) > 0, EXECUTIVE_WEIGHT).otherwise(zero)
        + F.when(F.size(aliases) > 0, ALIAS_WEIGHT).otherwise(zero)
        + F.least(F.lit(SECTOR_CAP), F.size(sectors) * F.lit(SECTOR_WEIGHT))
    )
    evidence = F.concat(
        _labelled("company_name", names), _labelled("product", products), _labelled("executive", executives),
        _labelled("ticker", aliases), _labelled("sector", sectors),
    )
    return F.struct(
        company["symbol"].alias("symbol"), score.alias("base"), evidence.alias("evidence"),
        F.get(refused, F.lit(0)).alias("refused"), finance.alias("finance"), stock.alias("stock"),
    )


def _verdict(e: Column) -> Column:
    """Accepted flag, confidence and reason from the evidence of one company."""
    seen = e["base"] > 0
    score = (
        e["base"]
        + F.when(seen & e["finance"], FINANCE_BONUS).otherwise(0.0)
        + F.when(seen & e["stock"], STOCK_BONUS).otherwise(0.0)
    )
    evidence = F.concat(
        e["evidence"],
        F.when(seen & e["finance"], F.array(F.lit("financial_context"))).otherwise(_texts([])),
        F.when(seen & e["stock"], F.array(F.lit("stock_context"))).otherwise(_texts([])),
    )

    def reason(label: str, n: int) -> Column:
        return F.concat(F.lit(label + ":"), F.array_join(F.slice(evidence, 1, n), ","))

    refused = e["refused"].isNotNull()
    return F.struct(
        e["symbol"].alias("symbol"),
        (~refused & (score >= LIKELY)).alias("accepted"),
        F.when(refused, NEGATIVE_CONFIDENCE).otherwise(F.least(F.lit(1.0), score)).alias("confidence"),
        F.when(refused, F.concat(F.lit("negative_keyword:"), e["refused"]))
        .when(score >= STRONG, reason("highly_relevant", 3))
        .when(score >= CLEAR, reason("relevant", 3))
        .when(score >= LIKELY, reason("likely_relevant", 2))
        .when(score >= WEAK, reason("weak_relevance", 1))
        .otherwise("no_relevance_found")
        .alias("reason"),
    )


def _read_once(df: DataFrame, text: Column) -> DataFrame:
    """``__read``: the lower-cased text and whether it speaks of finance or stock, as columns that every term reads."""
    lowered = evaluate_once(df, "__lowered", F.lower(F.coalesce(text, F.lit(""))))
    t = F.col("__lowered")
    context = [contains_any(t, words).alias(n) for n, words in (("finance", FINANCE_CONTEXT), ("stock", STOCK_CONTEXT))]
    return evaluate_once(lowered, "__read", F.struct(t.alias("text"), *context)).drop("__lowered")


def _verdicts(companies: Column) -> Column:
    """Verdicts of companies on the text in ``__read``."""
    scored = F.transform(companies, lambda c: _evidence(c, F.col("__read.text"), F.col("__read.finance"), F.col("__read.stock")))
    return F.transform(scored, _verdict)


def score_relevance(articles: DataFrame, dictionary: Dictionary | DataFrame) -> DataFrame:
    """Adds ``is_relevant, relevance_confidence, validation_reason`` for the assigned symbol.

    The symbol's entry comes by an equi-join with one row per symbol.  A literal
    dictionary, which the driver holds anyway, is broadcast, a table when the planner
    finds it small.  Symbols outside the dictionary are accepted at 0.5.
    """
    entries = company_table(articles.sparkSession, dictionary)
    entries = entries.select(F.col("symbol").alias("__of"), F.struct("*").alias("__company"))
    entries = entries if isinstance(dictionary, DataFrame) else F.broadcast(entries)
    joined = articles.join(entries, F.col("symbol") == F.col("__of"), "left").drop("__of")
    verdict = F.get(_verdicts(F.array("__company")), F.lit(0))
    return (
        evaluate_once(_read_once(joined, F.col("headline")), "__v", F.when(F.col("__company").isNotNull(), verdict))
        .withColumns(
            {
                "is_relevant": F.coalesce(F.col("__v.accepted"), F.lit(True)),
                "relevance_confidence": F.coalesce(F.col("__v.confidence"), F.lit(UNKNOWN_CONFIDENCE)),
                "validation_reason": F.coalesce(F.col("__v.reason"), F.lit("ticker_not_in_database")),
            }
        )
        .drop("__v", "__company", "__read")
    )


def _headline_keys(df: DataFrame) -> DataFrame:
    """``__h, __g``: two hashes that stand for the lower-cased headline."""
    text = F.lower(F.coalesce("headline", F.lit("")))
    return df.withColumns({"__h": F.xxhash64(text), "__g": F.xxhash64(F.lit(1), text)})


def named_companies(texts: DataFrame, dictionary: Dictionary | DataFrame) -> DataFrame:
    """``__h, __g, symbol`` of every company with a term, other than a negative one, in a text ``__h, __g, __text``.

    Pieces and keys meet in an equi-join: no text meets a term whose key it lacks.  Up to ``FEW_KEYS`` keys are
    broadcast, so pieces that are no key end in the task that made them; more are joined with neither side in one place.
    """
    terms = term_table(texts.sparkSession, dictionary).filter(F.col("category").isin(POSITIVE_CATEGORIES))
    terms = terms.select("symbol", "term", F.substring("term", 1, GRAM).alias("__key")).distinct()
    lengths = sorted(r[0] for r in terms.select(F.length("__key")).distinct().collect())  # at most GRAM of them
    keys = terms.select("__key").distinct()
    few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    pieces = [F.regexp_extract_all("__text", F.lit(f"(?s)(?=(.{{{k}}}))"), 1) for k in lengths]  # from every place on
    grams = texts.select("__h", "__g", F.explode(F.array_distinct(F.concat(_texts([]), *pieces))).alias("__key"))
    grams = grams.join(F.broadcast(keys), "__key", "left_semi") if few else grams
    hits = grams.join(terms.select("__key", "term").distinct(), "__key").select("__h", "__g", "term")
    confirmed = hits.join(texts, ["__h", "__g"]).filter(F.col("__text").contains(F.col("term"))).select("__h", "__g", "term")
    return confirmed.join(terms.select("term", "symbol").distinct(), "term").select("__h", "__g", "symbol").distinct()


def _detected(ranked: Column) -> Column:
    return F.transform(ranked, lambda v: F.struct(v["symbol"].alias("symbol"), (-v["rank"]).alias("confidence")))


def detect_companies(articles: DataFrame, dictionary: Dictionary | DataFrame) -> DataFrame:
    """Adds ``detected``: accepted companies above 0.2, most confident first.

    A literal dictionary with few terms is tried on each article where it is, so
    nothing is shuffled or written.  Otherwise every distinct headline is looked up
    once, whichever articles carry it.  A headline without a company has an empty list.
    """
    few = _few_companies(dictionary)
    if few is not None:
        judged = evaluate_once(_read_once(articles, F.col("headline")), "__v", _verdicts(few))
        hits = F.filter("__v", lambda v: v["accepted"] & (v["confidence"] > DETECT_ABOVE))
        ranked = F.array_sort(F.transform(hits, lambda v: F.struct((-v["confidence"]).alias("rank"), v["symbol"].alias("symbol"))))
        return judged.select(*articles.columns, _detected(ranked).alias("detected"))
    keyed = _headline_keys(articles)
    texts = keyed.select("__h", "__g", F.lower(F.coalesce("headline", F.lit(""))).alias("__text")).dropDuplicates(["__h", "__g"])
    texts = written(texts, "headlines")
    named = named_companies(texts, dictionary)
    entries = company_table(articles.sparkSession, dictionary).select("symbol", F.struct("*").alias("__company"))
    pairs = named.join(entries, "symbol").join(texts, ["__h", "__g"])
    judged = _read_once(pairs.select("__h", "__g", "__text", "__company"), F.col("__text"))
    judged = evaluate_once(judged, "__v", F.get(_verdicts(F.array("__company")), F.lit(0)))
    hits = judged.filter(F.col("__v.accepted") & (F.col("__v.confidence") > DETECT_ABOVE))
    ranked = hits.groupBy("__h", "__g").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("__v.confidence")).alias("rank"), F.col("__v.symbol").alias("symbol")))).alias("__ranked")  # those of one headline
    )
    found = keyed.join(ranked.select("__h", "__g", _detected(F.col("__ranked")).alias("detected")), ["__h", "__g"], "left")
    none = F.array().cast("array<struct<symbol:string,confidence:double>>")
    return found.select(*articles.columns, F.coalesce("detected", none).alias("detected"))


def fan_out(articles: DataFrame, dictionary: Dictionary | DataFrame) -> DataFrame:
    """One row per valid assignment: the original when relevant, others above 0.4."""
    scored = detect_companies(score_relevance(articles, dictionary), dictionary)
    original = F.filter(
        F.array(
            F.struct(
                F.col("symbol").alias("symbol"), F.col("relevance_confidence").alias("confidence"),
                F.col("validation_reason").alias("reason"), F.lit("news_validated").alias("source"),
            )
        ),
        lambda _: F.col("is_relevant"),
    )
    others = F.transform(
        F.filter(F.col("detected"), lambda d: (d["symbol"] != F.col("symbol")) & (d["confidence"] > REASSIGN_ABOVE)),
        lambda d: F.struct(
            d["symbol"].alias("symbol"), d["confidence"].alias("confidence"),
            F.lit("multi_ticker_detected").alias("reason"), F.lit("multi_ticker_assignment").alias("source"),
        ),
    )
    kept = [c for c in articles.columns if c != "symbol"]
    return scored.select(*kept, F.explode(F.concat(original, others)).alias("__a")).select(
        *kept,
        F.col("__a.symbol").alias("symbol"),
        F.col("__a.confidence").alias("relevance_confidence"),
        F.col("__a.reason").alias("validation_reason"),
        F.col("__a.source").alias("source"),
    )


def validate_articles(articles: DataFrame, dictionary: Dictionary | DataFrame) -> DataFrame:
    """Relevant articles, or all of them when fewer than half would survive.

    Scored articles are written once; the retention guard, a scalar subquery over
    one aggregate, and the result read them from there.  Rows that only stay
    because of the guard have no relevance.
    """
    scored = written(score_relevance(articles, dictionary), "relevance")
    retained = scored.agg(F.avg(F.col("is_relevant").cast("double"))).scalar()
    guard = F.coalesce(retained < LEAST_RETENTION, F.lit(True))
    return (
        scored.withColumn("__guard", guard)
        .filter(F.col("is_relevant") | F.col("__guard"))
        .withColumns(
            {
                "validated": ~F.col("__guard"),
                "relevance_confidence": F.when(~F.col("__guard"), F.col("relevance_confidence")),
                "validation_reason": F.when(~F.col("__guard"), F.col("validation_reason")),
            }
        )
        .drop("__guard", "is_relevant")
    )


def rejection_histogram(scored: DataFrame, top: int | None = 3) -> DataFrame:
    """Rejected articles per reason category (the text before ``:``), most frequent first."""
    counts = (
        scored.filter(~F.col("is_relevant"))
        .groupBy(F.split_part("validation_reason", F.lit(":"), F.lit(1)).alias("reason"))
        .agg(F.count(F.lit(1)).alias("articles"))
    )
    ordered = counts.orderBy(F.desc("articles"), "reason")
    return ordered.limit(top) if top else ordered


def validation_summary(articles: DataFrame, dictionary: Dictionary | DataFrame) -> DataFrame:
    """Totals, retention, multi-company count and confidence of kept assignments, in one pass."""
    scored = detect_companies(score_relevance(articles, dictionary), dictionary)
    others = F.size(
        F.filter(F.col("detected"), lambda d: (d["symbol"] != F.col("symbol")) & (d["confidence"] > REASSIGN_ABOVE))
    )
    kept = F.col("is_relevant").cast("int")
    return scored.select(
        kept.alias("kept"), (kept + others).alias("records"),
        F.when(F.col("is_relevant"), F.col("relevance_confidence")).alias("confidence"),
    ).agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.sum("kept").cast("bigint").alias("validated_articles"),
        F.sum(1 - F.col("kept")).cast("bigint").alias("rejected_articles"),
        F.sum((F.col("records") > 1).cast("int")).cast("bigint").alias("multi_ticker_articles"),
        (F.avg("kept") * 100.0).alias("retention_pct"),
        F.avg("confidence").alias("mean_confidence"),
        F.stddev_pop("confidence").alias("std_confidence"),
    )
