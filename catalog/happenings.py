"""Events of symbols and of the calendar around panel rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import events as calendar_events
from tapeloom.operators import events, indicators as ind

from .base import CTE, bars, code, pick, query, rnd, table

KEY = ["symbol", "date"]
KINDS = {"urgent": "o_orderpriority = '1-URGENT'", "finished": "o_orderstatus = 'F'"}
CTE["orders_seen"] = CTE["returns"] + """,
happened AS (SELECT 'S' || lpad(CAST(o_custkey % 100 AS VARCHAR), 4, '0') AS symbol, CAST(o_orderdate AS DATE) AS date,
                    o_orderpriority = '1-URGENT' AS urgent, o_orderstatus = 'F' AS finished FROM orders)"""


def order_events(spark, sf):
    """Orders as events of a symbol."""
    o = table(spark, sf, "orders")
    return o.select(code(F.col("o_custkey") % 100).alias("symbol"), F.col("o_orderdate").alias("date"), "o_orderpriority", "o_orderstatus")


def kinds_of(orders):
    """One row per kind of an order; it may be of both, or of none."""
    kinds = F.array_compact(F.array(*[F.when(F.expr(c), k) for k, c in KINDS.items()]))
    return orders.withColumn("kind", F.explode(kinds))


def _asof_sql(where: str, name: str) -> str:
    return f"""since_{name} AS (SELECT b.symbol, b.date, CAST(b.date - h.date AS INTEGER) AS days_since_{name}
      FROM bars b ASOF LEFT JOIN (SELECT DISTINCT symbol, date FROM happened WHERE {where}) h ON h.symbol = b.symbol AND b.date >= h.date),
    until_{name} AS (SELECT b.symbol, b.date, CAST(h.date - b.date AS INTEGER) AS days_until_{name}
      FROM bars b ASOF LEFT JOIN (SELECT DISTINCT symbol, date FROM happened WHERE {where}) h ON h.symbol = b.symbol AND b.date <= h.date)"""


@query("event_distances", f"WITH {CTE['orders_seen']}, {_asof_sql('true', 'event')} SELECT * FROM since_event JOIN until_event USING (symbol, date)")
def _(spark, sf):
    """Days since the last and until the next order of a symbol, for each of its bars."""
    return events.attach_event_distance(bars(spark, sf).select(*KEY), events.event_days(order_events(spark, sf)))


@query(
    "event_kind_distances",
    f"""WITH {CTE['orders_seen']}, {', '.join(_asof_sql(k, k) for k in KINDS)}
    SELECT * FROM since_urgent JOIN until_urgent USING (symbol, date) JOIN since_finished USING (symbol, date) JOIN until_finished USING (symbol, date)""",
)
def _(spark, sf):
    return events.attach_event_distance(bars(spark, sf).select(*KEY), events.event_days(kinds_of(order_events(spark, sf)), kind="kind"), list(KINDS))


@query(
    "market_event_distances",
    f"""WITH {CTE['orders_seen']}, big AS (SELECT CAST(o_orderdate AS DATE) AS date FROM orders GROUP BY ALL HAVING max(o_totalprice) > 45e4)
    SELECT s.symbol, s.date, s.d AS days_since_big, u.d AS days_until_big
    FROM (SELECT b.symbol, b.date, CAST(b.date - h.date AS INTEGER) AS d FROM bars b ASOF LEFT JOIN big h ON b.date >= h.date) s
    JOIN (SELECT b.symbol, b.date, CAST(h.date - b.date AS INTEGER) AS d FROM bars b ASOF LEFT JOIN big h ON b.date <= h.date) u USING (symbol, date)""",
)
def _(spark, sf):
    """The same for days of the whole market: those with an order above 450,000."""
    big = table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_orderdate").alias("date"))
    return events.attach_market_event_distance(bars(spark, sf).select(*KEY), big, "big")


@query(
    "event_overlaps",
    f"""WITH {CTE['orders_seen']} SELECT b.symbol, b.date, count(h.date) AS events_around
    FROM bars b LEFT JOIN happened h ON h.symbol = b.symbol AND b.date BETWEEN h.date - 5 AND h.date + 5 GROUP BY ALL""",
)
def _(spark, sf):
    """How many order windows, five days to both sides, cover a bar."""
    return events.attach_event_overlap(bars(spark, sf).select(*KEY), events.event_days(order_events(spark, sf)))


_WINDOWS = """anchored AS (SELECT h.symbol, h.date AS event_date, min(b.rn) AS at FROM (SELECT DISTINCT symbol, date FROM happened WHERE urgent) h
             JOIN numbered b ON b.symbol = h.symbol AND b.date >= h.date GROUP BY ALL),
  around AS (SELECT a.symbol, a.event_date, CAST(r.rn - a.at AS INTEGER) AS "offset", r.date, r.returns FROM anchored a JOIN rets r ON r.symbol = a.symbol AND r.rn BETWEEN a.at - 5 AND a.at + 10)"""


def _windows(spark, sf):
    urgent = events.event_days(order_events(spark, sf).filter(KINDS["urgent"]))
    return events.event_windows(ind.returns(bars(spark, sf)).select(*KEY, "returns"), urgent)


@query("event_windows", f"WITH {CTE['orders_seen']}, {_WINDOWS} SELECT symbol, event_date, \"offset\", date, {rnd('returns')} AS returns FROM around")
def _(spark, sf):
    """Bars from five rows before an urgent order to ten rows behind it."""
    return pick(_windows(spark, sf), ["symbol", "event_date", "offset", "date"], ["returns"])


@query(
    "event_study",
    f"""WITH {CTE['orders_seen']}, {_WINDOWS},
    study AS (SELECT "offset", count(returns) AS rows, avg(returns) AS mean, stddev_samp(returns) AS deviation FROM around GROUP BY ALL)
    SELECT "offset", rows, {rnd('mean')} AS mean, {rnd('deviation')} AS deviation, {rnd('mean / (deviation / sqrt(rows))', 4)} AS t_value,
           {rnd('sum(mean) OVER (ORDER BY "offset")')} AS cumulated FROM study""",
)
def _(spark, sf):
    """Returns around urgent orders."""
    made = events.event_study(_windows(spark, sf), "returns")
    return pick(made, ["offset", "rows"], ["mean", "deviation", "t_value", "cumulated"], 6, {"t_value": 4})


# ---- the calendar, by weekday and day of the month instead of arithmetic ----

GOOD_FRIDAYS = [
    "1994-04-01", "1995-04-14", "1996-04-05", "1997-03-28", "1998-04-10", "1999-04-02", "2000-04-21", "2001-04-13", "2002-03-29", "2003-04-18", "2004-04-09", "2005-03-25",
]
_HOLIDAY = f"""(m = 1 AND ((d = 1 AND w < 5) OR (d = 2 AND w = 0))) OR (m = 1 AND w = 0 AND d BETWEEN 15 AND 21 AND y >= 1998) OR (m = 2 AND w = 0 AND d BETWEEN 15 AND 21)
  OR (m = 5 AND w = 0 AND d >= 25) OR (m = 7 AND ((d = 4 AND w < 5) OR (d = 3 AND w = 4) OR (d = 5 AND w = 0))) OR (m = 9 AND w = 0 AND d <= 7)
  OR (m = 11 AND w = 3 AND d BETWEEN 22 AND 28) OR (m = 12 AND ((d = 25 AND w < 5) OR (d = 24 AND w = 4) OR (d = 26 AND w = 0)))
  OR day IN ({', '.join(f"DATE '{g}'" for g in GOOD_FRIDAYS)})"""


@query(
    "event_calendar",
    f"""WITH {CTE['bars']},
    days AS (SELECT day, year(day) AS y, month(day) AS m, dayofmonth(day) AS d, (dayofweek(day) + 6) % 7 AS w
             FROM (SELECT CAST(unnest(generate_series(DATE '1994-01-01', DATE '2005-12-31', INTERVAL 1 DAY)) AS DATE) AS day)),
    free AS (SELECT day FROM days WHERE {_HOLIDAY}),
    thirds AS (SELECT CASE WHEN day IN (SELECT day FROM free) THEN day - 1 ELSE day END AS day FROM days WHERE w = 4 AND d BETWEEN 15 AND 21),
    seen AS (SELECT DISTINCT date FROM bars),
    found AS (SELECT date, (SELECT max(day) FROM free WHERE day <= date) AS before, (SELECT min(day) FROM free WHERE day >= date) AS behind,
                     (SELECT min(day) FROM thirds WHERE day >= date) AS expires, date_trunc('quarter', date) AS q FROM seen)
    SELECT b.symbol, b.date, CAST(before = date AS INTEGER) AS is_market_holiday, CAST(date - before AS INTEGER) AS days_since_holiday, CAST(behind - date AS INTEGER) AS days_until_holiday,
           CAST(expires = date AS INTEGER) AS is_option_expiration, CAST(expires - date AS INTEGER) AS days_until_expiration,
           CAST(date_diff('day', q, date) BETWEEN 10 AND 45 AS INTEGER) AS is_earnings_season, CAST(date_diff('day', date, q + INTERVAL 3 MONTH) - 1 AS INTEGER) AS days_until_quarter_end,
           CAST(date_diff('day', date, make_date(year(date), 12, 31)) AS INTEGER) AS days_until_year_end
    FROM bars b JOIN found USING (date)""",
)
def _(spark, sf):
    return calendar_events.add_event_calendar(bars(spark, sf).select(*KEY))
