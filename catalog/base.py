"""Registration, the tables every query starts from, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.functions import evaluate_once
from tapeloom.operators import news
from tapeloom.operators.windows import dealt
from tapeloom.sources.bars import daily_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- rounding shared by both sides: digits after the point, no negative zero ----


def pick(df: DataFrame, keys: list[str], values: list[str], digits: int = 6, finer: dict[str, int] | None = None) -> DataFrame:
    finer = finer or {}
    return df.select(*keys, *[F.round(F.col(v).cast("double"), finer.get(v, digits)).alias(v) for v in values])


def rnd(expression: str, digits: int = 6) -> str:
    r = f"round(CAST({expression} AS DOUBLE), {digits})"
    return f"CASE WHEN {r} = 0 THEN 0e0 ELSE {r} END"


def pick_sql(source: str, keys: list[str], values: list[str], digits: int = 6) -> str:
    columns = [*keys, *[f"{rnd(v, digits)} AS {v}" for v in values]]
    return f"SELECT {', '.join(columns)} FROM {source}"


# ---- tables ----

TRADE_ORDER = [("l_orderkey", 16), ("l_linenumber", 6), ("l_partkey", 16)]
FIRST_DAY, DAYS = "1995-01-02", 2400


def code(number: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad(number.cast("string"), 4, "0"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each supplier, the line items being its trades."""
    t = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return daily_bars(t, code(F.col("l_suppkey")), F.col("l_shipdate"), price, F.col("l_quantity"), TRADE_ORDER)


def dealt_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars for many windows by symbol; a bar has a trade at least, and trades are counted from the file footers."""
    return dealt(bars(spark, sf_dir), table(spark, sf_dir, "lineitem").count())


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored articles, one per event."""
    return scored_from(table(spark, sf_dir, "events"))


def scored_from(events: DataFrame, *keep: str) -> DataFrame:
    c = F.round(F.col("value") * 100).cast("bigint")
    e = events.select("event_id", "user_id", c.alias("c"), *keep)
    compound = ((F.col("c") % 201) - 100) / F.lit(100.0)
    return e.select(
        F.col("event_id").alias("article_id"),
        code(F.col("user_id") % 100).alias("symbol"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("event_id") * 7 % DAYS).cast("int")).alias("date"),
        compound.alias("sentiment_compound"),
        F.greatest(compound, F.lit(0.0)).alias("sentiment_positive"),
        (1.0 - F.abs(compound)).alias("sentiment_neutral"),
        F.greatest(-compound, F.lit(0.0)).alias("sentiment_negative"),
        (0.5 + (F.col("c") % 50) / F.lit(100.0)).alias("confidence"), *keep,
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.daily_sentiment(scored(spark, sf_dir), quality=False)


SUFFIXES = [
    " beats estimates +5.2%", " $S0001 shares: not weak quarter", " <b>earnings report</b> http://x.example.com/a",
    " click here", " raises guidance, revenue $5B", " NASDAQ:AAPL failed to grow", " $AAPL no profit this quarter",
]


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return articles_from(rows.repartition(spark.sparkContext.defaultParallelism))  # the file is one row group, one task would read it


def articles_from(documents: DataFrame) -> DataFrame:
    """Every line of every document as a headline; symbol, day and suffix follow from its content."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    size = F.length("line")
    rest = F.length(F.replace("line", F.lit("e")))
    suffix = F.coalesce(F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (size + rest) % 10), F.lit(""))
    lines = evaluate_once(lines, "headline", F.concat("line", suffix))  # the gate's filter must not derive it for each of its rules
    return lines.select(
        (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("article_id"),
        code(rest % 100).alias("symbol"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), ((size * 7 + rest * 13) % DAYS).cast("int")).alias("date"),
        "headline",
    )


#: Company dictionary of the test articles (a parameter of the relevance operators).
DICTIONARY = {
    "S0000": {"names": ["tion"], "products": ["the", "ere"], "negative_keywords": ["click"]},
    "S0001": {"names": ["ere", "and co"], "executives": ["and"], "aliases": ["$s0001"]},
    "S0002": {"names": ["eau"], "executives": ["eau"], "sector_keywords": ["que", "ment"]},
    "S0003": {"products": ["and"]},
    "S0004": {"sector_keywords": ["der", "und", "ich", "con"]},
}

# ---- the same tables in SQL ----

ORDER_SQL = ", ".join(c for c, _ in TRADE_ORDER)
ORDER_DESC_SQL = ", ".join(f"{c} DESC" for c, _ in TRADE_ORDER)
CTE: dict[str, str] = {}
CTE["bars"] = f"""bars AS (
  SELECT symbol, date, first(p ORDER BY {ORDER_SQL}) AS open, max(p) AS high, min(p) AS low,
         first(p ORDER BY {ORDER_DESC_SQL}) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM (SELECT *, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') AS symbol, CAST(l_shipdate AS DATE) AS date,
               l_extendedprice / l_quantity AS p FROM lineitem)
  GROUP BY symbol, date)"""
CTE["numbered"] = CTE["bars"] + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars)"""
CTE["returns"] = CTE["numbered"] + """,
rets AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS returns FROM numbered)"""
CTE["targets"] = CTE["numbered"] + """,
targets AS (SELECT *, close / lag(close, 5) OVER w - 1 AS target_5d, close / lag(close, 22) OVER w - 1 AS target_22d,
                   close / lag(close, 90) OVER w - 1 AS target_90d
            FROM numbered WINDOW w AS (PARTITION BY symbol ORDER BY date))"""
CTE["scored"] = f"""scored AS (
  SELECT event_id AS article_id, 'S' || lpad(CAST(user_id % 100 AS VARCHAR), 4, '0') AS symbol,
         CAST(DATE '{FIRST_DAY}' + CAST(event_id * 7 % {DAYS} AS INTEGER) AS DATE) AS date,
         compound AS sentiment_compound, greatest(compound, 0e0) AS sentiment_positive,
         1e0 - abs(compound) AS sentiment_neutral, greatest(-compound, 0e0) AS sentiment_negative,
         5e-1 + (c % 50) / 1e2 AS confidence
  FROM (SELECT event_id, user_id, c, ((c % 201) - 100) / 1e2 AS compound
        FROM (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS c FROM events)))"""
CTE["daily"] = CTE["scored"] + """,
daily AS (
  SELECT symbol, date, sum(sentiment_compound * confidence) / sum(confidence) AS sentiment_compound,
         sum(sentiment_positive * confidence) / sum(confidence) AS sentiment_positive,
         sum(sentiment_neutral * confidence) / sum(confidence) AS sentiment_neutral,
         sum(sentiment_negative * confidence) / sum(confidence) AS sentiment_negative,
         avg(confidence) AS confidence, count(*) AS article_count
  FROM scored GROUP BY symbol, date)"""
_SUFFIX_SQL = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES))
CTE["articles"] = f"""articles AS (
  SELECT doc_id * 1000000 + pos - 1 AS article_id, 'S' || lpad(CAST(rest % 100 AS VARCHAR), 4, '0') AS symbol,
         CAST(DATE '{FIRST_DAY}' + CAST((size * 7 + rest * 13) % {DAYS} AS INTEGER) AS DATE) AS date,
         line || CASE (size + rest) % 10 {_SUFFIX_SQL} ELSE '' END AS headline
  FROM (SELECT *, length(line) AS size, length(replace(line, 'e', '')) AS rest
        FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
              FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))"""


def with_sql(cte: str, body: str) -> str:
    return f"WITH {CTE[cte] if cte in CTE else cte}\n{body}"
