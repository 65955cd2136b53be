"""Sources, indicators, calendar and time-index queries on daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.calendar import add_calendar
from tapeloom.operators import indicators as ind, prepare, windows
from tapeloom.session import stage_path
from tapeloom.sources import bars as bar_source, files, schemas, standardize

from .base import CTE, articles, bars, dealt_bars, pick, pick_sql, query, rnd, table, with_sql

KEY = ["symbol", "date"]
OHLC = ["open", "high", "low", "close"]
W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"


def rows(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


# ---- sources ----


@query("daily_bars", with_sql("bars", pick_sql("bars", [*KEY, "volume"], OHLC, 8)))
def _(spark, sf):
    return pick(bars(spark, sf), [*KEY, "volume"], OHLC, 8)


@query("csv_stage_scan", with_sql("bars", pick_sql("bars", [*KEY, "volume"], OHLC, 8)))
def _(spark, sf):
    """Bars written as a CSV stage and scanned again with a declared schema."""
    path = stage_path(spark, "bars-csv")
    files.write_stage(bars(spark, sf).select(*KEY, *OHLC, "volume"), path, "csv")
    return pick(files.read_table(spark, path, schemas.BARS), [*KEY, "volume"], OHLC, 8)


@query(
    "news_universe_scan",
    with_sql(
        "articles",
        """SELECT article_id, symbol, date, headline FROM articles
           WHERE symbol IN ('S0000', 'S0001', 'S0002', 'S0003') AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
    ),
)
def _(spark, sf):
    a = files.in_universe(articles(spark, sf), ["S0000", "S0001", "S0002", "S0003"], "1996-01-01", "2000-12-31")
    return a.select("article_id", "symbol", "date", "headline")


_RAW_DATES = ["yyyy-MM-dd HH:mm:ss 'UTC'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd", "MMM d, yyyy", "M/d/yyyy"]


@query(
    "raw_news_scan",
    f"""SELECT doc_id || ': he said ""buy"", then' || chr(10) || 'line two, of ' || coalesce(lang, '') AS headline, coalesce(source, '') AS symbol,
        CAST(DATE '2020-01-01' + CAST(doc_id % 700 AS INTEGER) AS DATE) AS date, doc_id % 6 = 5 AS undated FROM documents""".replace('""', '"'),
)
def _(spark, sf):
    """A raw news file with quotes, line breaks and several date layouts, every row read back."""
    docs = table(spark, sf, "documents")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")).cast("timestamp")
    text = F.lit("some day")
    for k, layout in enumerate(_RAW_DATES):
        text = F.when(F.col("doc_id") % 6 == k, F.date_format(day, layout)).otherwise(text)
    title = F.concat(F.col("doc_id"), F.lit(': he said "buy", then\nline two, of '), F.coalesce("lang", F.lit("")))
    values = {"Date": text, "Article_title": title, "Stock_symbol": F.coalesce("source", F.lit(""))}
    raw = docs.select(*[values.get(f.name, F.lit("")).alias(f.name) for f in schemas.RAW_NEWS.fields])
    path = stage_path(spark, "raw-news")
    raw.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    news = files.convert_news(spark, path, stage_path(spark, "news"))
    number = F.substring_index("headline", ":", 1).cast("bigint")
    known = F.coalesce("date", F.date_add(F.lit("2020-01-01").cast("date"), (number % 700).cast("int")))
    return news.select("headline", "symbol", known.alias("date"), F.col("date").isNull().alias("undated"))


@query("pruned_key_scan", "SELECT l_suppkey AS supplier, CAST(l_shipdate AS DATE) AS date FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").cast("date").alias("date"))


@query(
    "collected_bars",
    with_sql(
        "bars",
        "SELECT symbol, date, volume FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 530)",
    ),
)
def _(spark, sf):
    b = bars(spark, sf)
    parts = [b.filter(F.col("symbol") < "S0050"), b.filter(F.col("symbol") >= "S0050")]
    return bar_source.collect_bars(parts, least=530).select("symbol", "date", "volume")


@query(
    "normalised_bars",
    with_sql("bars", f"SELECT symbol, CAST(date AS DATE) AS date, {rnd('open', 8)} AS open, {rnd('close', 8)} AS close, volume FROM bars"),
)
def _(spark, sf):
    b = bars(spark, sf)
    raw = b.select(
        F.col("symbol").alias("Symbol"), F.col("date").cast("timestamp").alias("Date"), F.col("open").alias("Open"),
        F.col("close").alias("Close"), F.col("volume").alias("Volume"), F.lit(0.0).alias("Dividends"),
        F.lit(0.0).alias("Stock Splits"),
    )
    return pick(bar_source.normalise_bars(raw), ["symbol", "date", "volume"], ["open", "close"], 8)


@query(
    "stock_ids",
    with_sql(
        "bars",
        """SELECT symbol, 'stock_' || lpad(CAST(dense_rank() OVER (ORDER BY symbol) AS VARCHAR), 4, '0') AS stock_id
           FROM (SELECT DISTINCT symbol FROM bars)""",
    ),
)
def _(spark, sf):
    return bar_source.symbol_dimension(bars(spark, sf))


@query(
    "tagged_bars",
    with_sql(
        "bars",
        """SELECT symbol, date, volume, 'stock_' || lpad(CAST(dense_rank() OVER (ORDER BY symbol) AS VARCHAR), 4, '0') AS stock_id FROM bars""",
    ),
)
def _(spark, sf):
    return bar_source.tag_stock_id(bars(spark, sf)).select("symbol", "date", "volume", "stock_id")


# ---- indicators ----


@query(
    "returns",
    with_sql(
        "returns",
        f"SELECT symbol, date, {rnd('returns')} AS returns, {rnd('ln(1 + returns)')} AS log_returns FROM rets",
    ),
)
def _(spark, sf):
    return pick(ind.returns(bars(spark, sf)), KEY, ["returns", "log_returns"])


def _ewm(source: str, column: str, alpha: float, out: str, need: int, seq: str = "rn") -> str:
    """Recursive mean by its closed form, all earlier rows joined (shares nothing with the scan)."""
    return f"""{out} AS (
  SELECT a.symbol, a.date, CASE WHEN a.{seq} >= {need} THEN
         sum(b.{column} * CASE WHEN b.{seq} = 1 THEN 1e0 ELSE {alpha!r} END * pow({1 - alpha!r}, a.{seq} - b.{seq})) END AS {out}
  FROM {source} a JOIN {source} b ON a.symbol = b.symbol AND b.{seq} <= a.{seq}
  GROUP BY a.symbol, a.date, a.{seq})"""


def _joined(first: str, names: list[str]) -> str:
    return first + "".join(f" JOIN {n} USING (symbol, date)" for n in names)


_EMA = [f"ema_{n}" for n in ind.EMA_SPANS]


@query(
    "exponential_averages",
    f"WITH {CTE['numbered']}, "
    + ", ".join(_ewm("numbered", "close", 2.0 / (n + 1), f"ema_{n}", n) for n in ind.EMA_SPANS)
    + " " + pick_sql(_joined("numbered", _EMA), KEY, _EMA, 4),
)
def _(spark, sf):
    return pick(ind.exponential_averages(bars(spark, sf)), KEY, _EMA, 4)


@query(
    "vwap",
    with_sql(
        "bars",
        "SELECT symbol, date, "
        + rnd(
            """coalesce(sum((high + low + close) / 3 * volume) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)
               / nullif(sum(volume) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 0),
               (high + low + close) / 3)""", 4)
        + " AS vwap FROM bars",
    ),
)
def _(spark, sf):
    return pick(ind.vwap(bars(spark, sf)), KEY, ["vwap"], 4)


_BB = f"""bands AS (SELECT symbol, date, close, CASE WHEN rn >= 20 THEN avg(close) {rows(20)} END AS m,
       CASE WHEN rn >= 20 THEN stddev_pop(close) {rows(20)} END AS s FROM numbered)"""


@query(
    "bollinger",
    f"""WITH {CTE['numbered']}, {_BB}
    SELECT symbol, date, {rnd('m', 4)} AS bb_middle, {rnd('m + 2 * s', 4)} AS bb_upper, {rnd('m - 2 * s', 4)} AS bb_lower,
           {rnd('4 * s / nullif(m, 0)', 4)} AS bb_width, {rnd('(close - (m - 2 * s)) / nullif(4 * s, 0)', 4)} AS bb_position
    FROM bands""",
)
def _(spark, sf):
    return pick(ind.bollinger(bars(spark, sf)), KEY, ["bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_position"], 4)


_RSI = ind.RSI_PERIODS


@query(
    "rsi",
    f"""WITH {CTE['numbered']}, moves AS (
      SELECT symbol, date, rn, coalesce(greatest(m, 0e0), 0e0) AS up, coalesce(greatest(-m, 0e0), 0e0) AS down
      FROM (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS m FROM numbered)), """
    + ", ".join(_ewm("moves", side, 1.0 / n, f"{side}_{n}", n) for n in _RSI for side in ("up", "down"))
    + " SELECT symbol, date, "
    + ", ".join(
        rnd(f"CASE WHEN down_{n} = 0 THEN 100e0 ELSE 100 - 100 / (1 + up_{n} / down_{n}) END", 4) + f" AS rsi_{n}" for n in _RSI
    )
    + " FROM " + _joined("moves", [f"{side}_{n}" for n in _RSI for side in ("up", "down")]),
)
def _(spark, sf):
    return pick(ind.rsi(bars(spark, sf)), KEY, [f"rsi_{n}" for n in _RSI], 4)


@query(
    "macd",
    f"WITH {CTE['numbered']}, "
    + _ewm("numbered", "close", 2 / 13, "fast", 12) + ", " + _ewm("numbered", "close", 2 / 27, "slow", 26)
    + """, line AS (SELECT symbol, date, fast - slow AS l, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k
         FROM fast JOIN slow USING (symbol, date) WHERE slow IS NOT NULL), """
    + _ewm("line", "l", 0.2, "signal", 9, "k")
    + f""" SELECT n.symbol, n.date, {rnd('l', 4)} AS macd_line, {rnd('signal', 4)} AS macd_signal, {rnd('l - signal', 4)} AS macd_diff
         FROM numbered n LEFT JOIN line USING (symbol, date) LEFT JOIN signal USING (symbol, date)""",
)
def _(spark, sf):
    return pick(ind.macd(bars(spark, sf)), KEY, ["macd_line", "macd_signal", "macd_diff"], 4)


@query(
    "simple_averages",
    with_sql(
        "numbered",
        "SELECT symbol, date, "
        + ", ".join(rnd(f"CASE WHEN rn >= {n} THEN avg(close) {rows(n)} END", 3) + f" AS sma_{n}" for n in ind.SMA_SPANS)
        + " FROM numbered",
    ),
)
def _(spark, sf):
    return pick(ind.simple_averages(bars(spark, sf)), KEY, [f"sma_{n}" for n in ind.SMA_SPANS], 3)


@query(
    "volatility",
    with_sql("returns", f"SELECT symbol, date, {rnd(f'CASE WHEN rn >= 21 THEN stddev_samp(returns) {rows(20)} END')} AS volatility_20d FROM rets"),
)
def _(spark, sf):
    return pick(ind.volatility(bars(spark, sf)), KEY, ["volatility_20d"])


@query(
    "true_range_average",
    f"""WITH {CTE['numbered']}, ranges AS (SELECT symbol, date, rn,
          greatest(high - low, abs(high - p), abs(low - p)) AS tr
        FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS p FROM numbered))
    SELECT symbol, date, {rnd(f'CASE WHEN rn >= 14 THEN avg(tr) {rows(14)} END', 3)} AS atr FROM ranges""",
)
def _(spark, sf):
    return pick(ind.true_range_average(bars(spark, sf)), KEY, ["atr"], 3)


@query(
    "stochastic",
    f"""WITH {CTE['numbered']}, spans AS (SELECT symbol, date, rn, close,
          CASE WHEN rn >= 14 THEN min(low) {rows(14)} END AS lo, CASE WHEN rn >= 14 THEN max(high) {rows(14)} END AS hi FROM numbered),
        k AS (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS stoch_k, -100 * (hi - close) / nullif(hi - lo, 0) AS williams_r FROM spans)
    SELECT symbol, date, {rnd('stoch_k', 4)} AS stoch_k, {rnd('williams_r', 4)} AS williams_r,
           {rnd(f'CASE WHEN count(stoch_k) {rows(3)} = 3 THEN avg(stoch_k) {rows(3)} END', 4)} AS stoch_d FROM k""",
)
def _(spark, sf):
    return pick(ind.stochastic(bars(spark, sf)), KEY, ["stoch_k", "williams_r", "stoch_d"], 4)


@query(
    "rate_of_change",
    with_sql(
        "bars",
        "SELECT symbol, date, "
        + ", ".join(rnd(f"(close / lag(close, {n}) OVER w - 1) * 100", 4) + f" AS roc_{n}" for n in ind.ROC_PERIODS)
        + f" FROM bars {W}",
    ),
)
def _(spark, sf):
    return pick(ind.rate_of_change(bars(spark, sf)), KEY, [f"roc_{n}" for n in ind.ROC_PERIODS], 4)


@query(
    "volume_features",
    f"""WITH {CTE['numbered']}, v AS (SELECT symbol, date, volume, CASE WHEN rn >= 20 THEN avg(volume) {rows(20)} END AS slow,
          CASE WHEN rn >= 5 THEN avg(volume) {rows(5)} END AS fast FROM numbered)
    SELECT symbol, date, {rnd('slow')} AS volume_sma_20, {rnd('volume / (slow + 1e-10)')} AS volume_ratio,
           {rnd('fast / (slow + 1e-10)')} AS volume_trend FROM v""",
)
def _(spark, sf):
    return pick(ind.volume_features(bars(spark, sf)), KEY, ["volume_sma_20", "volume_ratio", "volume_trend"])


@query(
    "price_shape",
    with_sql(
        "bars",
        f"""SELECT symbol, date, {rnd('(close - low) / nullif(high - low, 0)')} AS price_position,
            {rnd('(open - lag(close) OVER w) / (lag(close) OVER w + 1e-10)')} AS gap,
            {rnd('(close - open) / (open + 1e-10)')} AS intraday_return FROM bars {W}""",
    ),
)
def _(spark, sf):
    return pick(ind.price_shape(bars(spark, sf)), KEY, ["price_position", "gap", "intraday_return"])


_LAGS = [f"{c}_lag_{k}" for c in ("close", "returns") for k in ind.LAG_STEPS]
_VOLUME_LAGS = [f"volume_lag_{k}" for k in ind.LAG_STEPS]


@query(
    "lags",
    with_sql(
        "returns",
        "SELECT symbol, date, "
        + ", ".join(f"{rnd(f'lag({c}, {k}) OVER w', 8)} AS {c}_lag_{k}" for c in ("close", "returns") for k in ind.LAG_STEPS)
        + ", " + ", ".join(f"lag(volume, {k}) OVER w AS volume_lag_{k}" for k in ind.LAG_STEPS)
        + f" FROM rets {W}",
    ),
)
def _(spark, sf):
    df = ind.lagged(ind.returns(bars(spark, sf)), ["close", "returns", "volume"])
    return pick(df, [*KEY, *_VOLUME_LAGS], _LAGS, 8)


@query(
    "forward_fill",
    f"""WITH {CTE['bars']}, holes AS (SELECT symbol, date, CASE WHEN high > low THEN close END AS x FROM bars)
    SELECT symbol, date, {rnd('last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)', 8)} AS x FROM holes""",
)
def _(spark, sf):
    b = bars(spark, sf).select(*KEY, F.when(F.col("high") > F.col("low"), F.col("close")).alias("x"))
    return pick(windows.forward_fill(b, ["x"]), KEY, ["x"], 8)


@query("all_indicators")
def _(spark, sf):
    """Every indicator and lag of the feature table, carried forward."""
    return ind.add_indicators(dealt_bars(spark, sf))


@query(
    "horizon_returns",
    with_sql(
        "targets",
        f"""SELECT symbol, date, {rnd('target_5d')} AS target_5d, {rnd('target_22d')} AS target_22d, {rnd('target_90d')} AS target_90d,
            {rnd('target_5d')} AS target_5, {rnd('ln(1 + target_5d)')} AS target_5_log,
            CASE WHEN target_5d > 0 THEN 1 ELSE 0 END AS target_5_direction FROM targets""",
    ),
)
def _(spark, sf):
    return pick(
        ind.horizon_returns(bars(spark, sf)), [*KEY, "target_5_direction"],
        ["target_5d", "target_22d", "target_90d", "target_5", "target_5_log"],
    )


@query(
    "forward_labels",
    with_sql(
        "bars",
        "SELECT symbol, date, "
        + ", ".join(f"{rnd(f'lead(close, {h}) OVER w / close - 1')} AS label_{h}d" for h in ind.HORIZONS)
        + f" FROM bars {W}",
    ),
)
def _(spark, sf):
    return pick(ind.forward_returns(bars(spark, sf)), KEY, [f"label_{h}d" for h in ind.HORIZONS])


@query("warmup_dropped", with_sql("numbered", "SELECT symbol, date, volume FROM numbered WHERE rn > 90"))
def _(spark, sf):
    return ind.drop_warmup(bars(spark, sf)).select(*KEY, "volume")


@query(
    "time_index",
    with_sql(
        "bars",
        """SELECT symbol, date, CAST(row_number() OVER w - 1 AS INTEGER) AS time_idx,
           CAST(row_number() OVER (PARTITION BY symbol, year(date), month(date) ORDER BY date) AS INTEGER) AS trading_day_of_month,
           CAST(date - (SELECT min(date) FROM bars) AS INTEGER) AS days_since_start
           FROM bars """ + W,
    ),
)
def _(spark, sf):
    return ind.time_index(bars(spark, sf)).select(*KEY, "time_idx", "trading_day_of_month", "days_since_start")


_INT_PARTS = [c for c in ("year", "month", "day", "day_of_week", "quarter", "day_of_year", "week_of_year", "is_month_end",
                          "is_month_start", "is_quarter_end", "is_year_end", "is_weekday", "is_weekend")]
_CYCLES = [f"{n}_{f}" for n in ("month", "day_of_week", "day_of_year") for f in ("sin", "cos")]


@query(
    "calendar",
    with_sql(
        "bars",
        f"""SELECT symbol, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
      CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(quarter(date) AS INTEGER) AS quarter, CAST(dayofyear(date) AS INTEGER) AS day_of_year,
      CAST(weekofyear(date) AS INTEGER) AS week_of_year,
      CAST(date = last_day(date) AS INTEGER) AS is_month_end, CAST(day(date) = 1 AS INTEGER) AS is_month_start,
      CAST(date = last_day(date) AND month(date) IN (3, 6, 9, 12) AS INTEGER) AS is_quarter_end,
      CAST(month(date) = 12 AND day(date) = 31 AS INTEGER) AS is_year_end,
      CAST(isodow(date) <= 5 AS INTEGER) AS is_weekday, CAST(isodow(date) > 5 AS INTEGER) AS is_weekend,
      {rnd('sin(2 * pi() * month(date) / 12)')} AS month_sin, {rnd('cos(2 * pi() * month(date) / 12)')} AS month_cos,
      {rnd('sin(2 * pi() * (isodow(date) - 1) / 7)')} AS day_of_week_sin, {rnd('cos(2 * pi() * (isodow(date) - 1) / 7)')} AS day_of_week_cos,
      {rnd('sin(2 * pi() * dayofyear(date) / 365.25e0)')} AS day_of_year_sin, {rnd('cos(2 * pi() * dayofyear(date) / 365.25e0)')} AS day_of_year_cos
      FROM bars""",
    ),
)
def _(spark, sf):
    return pick(add_calendar(bars(spark, sf).select(*KEY)), [*KEY, *_INT_PARTS], _CYCLES)


@query(
    "base_100",
    with_sql("bars", f"SELECT symbol, date, {rnd('close / first_value(close) OVER w * 100', 4)} AS close_base100 FROM bars {W}"),
)
def _(spark, sf):
    return pick(ind.base_100(bars(spark, sf)), KEY, ["close_base100"], 4)


# ---- standardisation ----


@query(
    "standard_names",
    "SELECT 'S' || CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS date, o_totalprice AS close FROM orders",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    raw = o.select(
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.col("o_orderdate").cast("date").alias("timestamp"), F.col("o_totalprice").alias("Close"),
    )
    return standardize.standardize_names(raw)


@query(
    "standard_dates",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders",
)
def _(spark, sf):
    """Four text layouts of the order date, told apart by their shape, back to one."""
    d = F.col("o_orderdate")
    layout = F.col("o_orderkey") % 4
    text = (
        F.when(layout == 0, F.date_format(d, "yyyy-MM-dd")).when(layout == 1, F.date_format(d, "yyyy/MM/dd"))
        .when(layout == 2, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
    )
    raw = table(spark, sf, "orders").select("o_orderkey", text.alias("date"))
    return standardize.standardize_dates(raw)


@query(
    "standard_symbols",
    """SELECT p_partkey, regexp_replace(upper(trim(p_brand || ' ' || p_name)), '[^A-Z]', '', 'g') AS symbol FROM part
       WHERE length(regexp_replace(upper(trim(p_brand || ' ' || p_name)), '[^A-Z]', '', 'g')) > 0""",
)
def _(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("symbol"))
    return standardize.standardize_symbols(raw)


@query(
    "standard_text",
    r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'),
          '^ +| +$', '', 'g'), '[^\p{L}\p{N}_\s.,!?;:\-]', '', 'g') AS headline FROM documents)
        SELECT doc_id, headline FROM t WHERE length(headline) > 0""",
)
def _(spark, sf):
    raw = table(spark, sf, "documents").select("doc_id", F.col("text").alias("headline"))
    return standardize.standardize_text(raw)


_KNOWN = "TRY_CAST(CASE WHEN x NOT IN ('none', 'bad') THEN x END AS DOUBLE)"
_EVENT_KIND = "CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'bad' ELSE CAST(value / 100 AS VARCHAR) END"


@query(
    "standard_sentiment",
    f"""SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, upper(regexp_replace(event_type, '[^A-Za-z]', '', 'g')) AS symbol,
        {rnd('least(greatest(value / 100 - 1, -1e0), 1e0)')} AS sentiment_compound, {rnd('least(greatest(value / 50, 0e0), 1e0)')} AS confidence
        FROM events WHERE event_id % 5 > 1""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    text = (
        F.when(F.col("event_id") % 5 == 0, "none").when(F.col("event_id") % 5 == 1, "bad")
        .otherwise((F.col("value") / 100 - 1).cast("string"))
    )
    raw = e.select(
        "event_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("ticker"), text.alias("sentiment"),
        (F.col("value") / 50).alias("confidence"),
    )
    return pick(standardize.standardize_sentiment(raw), ["event_id", "date", "symbol"], ["sentiment_compound", "confidence"])


@query(
    "standard_market",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, 'C' AS symbol, o_totalprice AS open, o_totalprice AS close,
       CAST(o_orderkey % 3 - 1 AS DOUBLE) AS volume FROM orders WHERE o_orderkey % 3 >= 1 AND o_orderkey % 7 <> 0""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    raw = o.select(
        "o_orderkey", F.col("o_orderdate").alias("Date"), F.lit("c1 ").alias("Symbol"),
        F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).cast("string").alias("Open"),
        F.col("o_totalprice").alias("Close"), (F.col("o_orderkey") % 3 - 1).cast("string").alias("Volume"),
    )
    return standardize.standardize_market(raw)


@query(
    "standard_news",
    r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'),
          '^ +| +$', '', 'g'), '[^\p{L}\p{N}_\s.,!?;:\-]', '', 'g') AS headline,
          regexp_replace(upper(url), '[^A-Z]', '', 'g') AS symbol FROM pages)
        SELECT page_id, '2001-02-03' AS date, symbol, headline FROM t WHERE length(headline) > 0 AND length(symbol) > 0""",
)
def _(spark, sf):
    raw = table(spark, sf, "pages").select(
        "page_id", F.lit("2001/02/03").alias("Date"), F.col("html").alias("Article_title"), F.col("url").alias("Stock_symbol")
    )
    return standardize.standardize(raw)


@query("utc_timestamps", "SELECT event_id, CAST(ts AS TIMESTAMP) AS event_date FROM events")
def _(spark, sf):
    """Event time kept as zone-free wall clock, also when it arrives as text."""
    raw = table(spark, sf, "events").select("event_id", F.col("ts").cast("string").alias("event_date"))
    return standardize.without_time_zone(raw)


@query(
    "null_tokens",
    f"SELECT event_id, {rnd(_KNOWN)} AS x, {rnd('value')} AS value"
    f" FROM (SELECT event_id, value, {_EVENT_KIND} AS x FROM events)",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    text = (
        F.when(F.col("event_id") % 5 == 0, "none").when(F.col("event_id") % 5 == 1, "bad")
        .otherwise((F.col("value") / 100).cast("string"))
    )
    return pick(standardize.coerce_numeric(e.select("event_id", text.alias("x"), "value"), ["event_id"]), ["event_id"], ["x", "value"])


@query(
    "finite_numbers",
    f"SELECT event_id, CASE WHEN event_id % 3 > 0 THEN {rnd('value')} END AS x FROM events",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    x = F.when(F.col("event_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return pick(standardize.finite_numbers(e.select("event_id", x.alias("x"))), ["event_id"], ["x"])


@query(
    "clean_column_names",
    "SELECT l_orderkey, l_linenumber, l_quantity AS unit_price, count(*) AS n FROM lineitem GROUP BY ALL",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("unit (price)"))
    cleaned = standardize.clean_names(li)
    return cleaned.groupBy("l_orderkey", "l_linenumber", "unit_price").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prefixed_symbols",
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'DEFAULT' WHEN c_custkey % 4 = 1 THEN c_mktsegment ELSE 'STOCK_' || CAST(c_custkey AS VARCHAR) END AS symbol FROM customer",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    slot = F.col("c_custkey") % 4
    raw = c.select(
        "c_custkey", F.when(slot == 1, F.col("c_mktsegment")).when(slot > 1, F.col("c_custkey").cast("string")).alias("symbol")
    )
    return standardize.prefix_numeric_symbols(raw)


# ---- row filters ----


@query("primary_target_rows", with_sql("targets", "SELECT symbol, date FROM targets WHERE target_5d IS NOT NULL"))
def _(spark, sf):
    return prepare.with_primary_target(ind.horizon_returns(bars(spark, sf))).select(*KEY)


@query("any_target_rows", with_sql("targets", "SELECT symbol, date FROM targets WHERE target_22d IS NOT NULL OR target_90d IS NOT NULL"))
def _(spark, sf):
    t = ind.horizon_returns(bars(spark, sf), [22, 90])
    return prepare.drop_without_targets(t).select(*KEY)


@query(
    "dense_symbols",
    with_sql("bars", "SELECT symbol, date FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 530)"),
)
def _(spark, sf):
    return prepare.drop_sparse_symbols(bars(spark, sf), 530).select(*KEY)
