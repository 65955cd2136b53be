"""Event distances, windows and the holiday calendar; days closed in event time."""

import random
import time
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import events as calendar_events
from tapeloom.operators import events
from tapeloom.streaming import event_time

START = date(2021, 3, 1)


def rows_of(n=120, seed=1):
    rnd = random.Random(seed)
    panel = sorted({(s, START + timedelta(days=rnd.randrange(200))) for s in "ABC" for _ in range(n)} | {("LONE", START)})
    happened = [(rnd.choice("ABD"), START + timedelta(days=rnd.randrange(-20, 230)), rnd.choice(["x", "y", None])) for _ in range(25)]
    return panel, happened + [(None, START, "x"), ("A", None, "x"), happened[0], happened[0]]


@pytest.fixture(scope="module")
def tables(spark):
    panel, happened = rows_of()
    p = spark.createDataFrame([(s, d, float(i)) for i, (s, d) in enumerate(panel)], "symbol string, date date, v double")
    return p, spark.createDataFrame(happened, "symbol string, date date, kind string"), panel, happened


def plain_distance(panel, happened):
    out = {}
    for s, d in panel:
        own = [e for t, e, _ in happened if t == s and e is not None]
        before, behind = [e for e in own if e <= d], [e for e in own if e >= d]
        out[s, d] = ((d - max(before)).days if before else None, (min(behind) - d).days if behind else None)
    return out


def test_distances(tables):
    p, e, panel, happened = tables
    made = events.attach_event_distance(p, events.event_days(e))
    assert {(r.symbol, r.date): (r.days_since_event, r.days_until_event) for r in made.collect()} == plain_distance(panel, happened)
    assert made.columns == [*p.columns, "days_since_event", "days_until_event"] and made.count() == p.count()


def test_distances_by_kind(tables):
    p, e, panel, happened = tables
    made = events.attach_event_distance(p, events.event_days(e, kind="kind"), ["x", "y"]).collect()
    for k in "xy":
        want = plain_distance(panel, [h for h in happened if h[2] == k])
        assert {(r.symbol, r.date): (r[f"days_since_{k}"], r[f"days_until_{k}"]) for r in made} == want


def test_market_distances(tables):
    p, e, panel, happened = tables
    made = events.attach_market_event_distance(p, e, "any").collect()
    want = plain_distance([("", d) for _, d in panel], [("", d, k) for _, d, k in happened])
    assert {(r.symbol, r.date): (r.days_since_any, r.days_until_any) for r in made} == {(s, d): want["", d] for s, d in panel}


@pytest.mark.parametrize("before, after", [(5, 5), (0, 0), (3, 30)])
def test_overlaps(tables, before, after):
    p, e, panel, happened = tables
    made = events.attach_event_overlap(p, events.event_days(e), before, after).collect()
    for r in made:
        covers = [d for s, d, _ in happened if s == r.symbol and d is not None and -before <= (r.date - d).days <= after]
        assert r.events_around == len(covers)


def test_windows_and_study(tables):
    p, e, panel, happened = tables
    made = events.event_windows(p, events.event_days(e), 2, 4)
    want = set()
    for s, d in {(s, d) for s, d, _ in happened if s and d}:
        own = [x for t, x in panel if t == s]
        at = next((i for i, x in enumerate(own) if x >= d), None)
        want |= {(s, d, i - at, x) for i, x in enumerate(own) if at is not None and -2 <= i - at <= 4}
    assert {(r.symbol, r.event_date, r.offset, r.date) for r in made.collect()} == want and made.count() == len(want)
    study = events.event_study(made, "v").orderBy("offset").collect()
    value, total = dict(zip(panel, map(float, range(len(panel))))), 0.0
    for r in study:
        vs = [value[s, d] for s, _, o, d in want if o == r.offset]
        total += np.mean(vs)
        assert r.rows == len(vs) and r["mean"] == pytest.approx(np.mean(vs)) and r.cumulated == pytest.approx(total)
        assert r.t_value == pytest.approx(np.mean(vs) / (np.std(vs, ddof=1) / len(vs) ** 0.5))


def test_events_of_one_symbol_and_day_are_reduced_first(spark):
    many = spark.range(20_000).select(F.lit("A").alias("symbol"), F.lit(START).alias("date"))
    days = events.event_days(many)
    assert [tuple(r) for r in days.collect()] == [("A", START, 20_000)]
    p = spark.createDataFrame([("A", START)], "symbol string, date date")
    assert events.event_windows(p, days).count() == 1 and events.attach_event_overlap(p, days).first().events_around == 20_000


def test_without_events_or_rows(tables, spark):
    p, e, _, _ = tables
    none = events.event_days(e.limit(0))
    assert events.attach_event_distance(p, none).filter("days_since_event IS NOT NULL OR days_until_event IS NOT NULL").count() == 0
    assert events.event_windows(p, none).count() == 0 and events.attach_event_overlap(p, none).agg(F.sum("events_around")).first()[0] == 0
    assert events.attach_event_distance(p.limit(0), events.event_days(e)).count() == 0
    assert calendar_events.add_event_calendar(p.limit(0)).count() == 0


def test_holidays(spark):
    """Days on which the New York exchange rested."""
    known = {
        1999: "01-01 01-18 02-15 04-02 05-31 07-05 09-06 11-25 12-24", 2011: "01-17 02-21 04-22 05-30 07-04 09-05 11-24 12-26",
        2022: "01-17 02-21 04-15 05-30 06-20 07-04 09-05 11-24 12-26", 2023: "01-02 01-16 02-20 04-07 05-29 06-19 07-04 09-04 11-23 12-25",
        2024: "01-01 01-15 02-19 03-29 05-27 06-19 07-04 09-02 11-28 12-25",
    }
    made = spark.createDataFrame([(y,) for y in known], "y int").select("y", F.array_sort(calendar_events.market_holidays(F.col("y"))).alias("h")).collect()
    assert {r.y: " ".join(d.strftime("%m-%d") for d in r.h) for r in made} == known


def test_easter(spark):
    def plain(y):  # Gauss' method
        a, b, c, k = y % 19, y % 4, y % 7, y // 100
        m, n = (15 - (13 + 8 * k) // 25 + k - k // 4) % 30, (4 + k - k // 4) % 7
        d = (19 * a + m) % 30
        e = (2 * b + 4 * c + 6 * d + n) % 7
        day = 22 + d + e
        if d == 29 and e == 6:
            day = 50
        if d == 28 and e == 6 and (11 * m + 11) % 30 < 19:
            day = 49
        return date(y, 3, 1) + timedelta(days=day - 1)

    made = spark.range(1900, 2200).select(F.col("id").cast("int").alias("y")).select("y", calendar_events.easter(F.col("y")).alias("e")).collect()
    assert all(r.e == plain(r.y) for r in made)


def test_option_expiration(spark):
    dates = [("2019-04-02", "2019-04-18"), ("2024-03-31", "2024-03-15"), ("2022-04-30", "2022-04-14"), ("2021-01-01", "2021-01-15")]
    made = spark.createDataFrame(dates, "d string, e string").select(calendar_events.option_expiration(F.to_date("d")).cast("string"), "e").collect()
    assert all(a == b for a, b in made)


# ---- event time ----

TRADES = "symbol string, ts timestamp, price double, size double, n long"
T0 = datetime(2024, 1, 1, 9)


def arrive(spark, folder, rows, schema=TRADES):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


def stream(spark, folder, schema=TRADES):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def trade(day, n, price, hour=0):
    return ("A", T0 + timedelta(days=day, hours=hour), float(price), 1.0, n)


def test_late_rows_and_restart(spark, tmp_path):
    """In and beyond the watermark, over two runs of the stream; closed days equal the batch result of what counted."""
    src, out, check = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "check")
    days = lambda: event_time.bars_in_event_time(stream(spark, src), [("n", 10)], "1 day", ids=["symbol", "n"])
    arrive(spark, src, [trade(0, 1, 10), trade(0, 3, 30, 2), trade(1, 4, 40)])
    arrive(spark, src, [trade(0, 2, 5, 1), trade(0, 2, 5, 1), trade(1, 5, 50)])  # late within the delay, and a copy
    first = event_time.write_closed_days(days(), out, check)
    assert first.rows == 6 and first.late == 0 and event_time.closed_days(days(), out).count() == 0
    arrive(spark, src, [trade(4, 6, 60)])
    event_time.write_closed_days(days(), out, check)
    got = lambda: sorted(tuple(r) for r in event_time.closed_days(days(), out).collect())
    day = lambda k: T0.date() + timedelta(days=k)
    closed = [("A", day(0), 10.0, 30.0, 5.0, 30.0, 3), ("A", day(1), 40.0, 50.0, 40.0, 50.0, 2)]
    assert got() == closed
    arrive(spark, src, [trade(0, 7, 1), trade(4, 8, 80, 1)])  # the first row is beyond the watermark
    arrive(spark, src, [trade(9, 9, 90)])
    third = event_time.write_closed_days(days(), out, check)
    assert third.rows == 3 and third.late >= 1
    assert got() == [*closed, ("A", day(4), 60.0, 80.0, 60.0, 80.0, 2)]
    assert event_time.write_closed_days(days(), out, check).rows == 0 and got()[:2] == closed  # nothing new, nothing again


def test_sentiment_counts_an_article_once(spark, tmp_path):
    schema = "article_id long, symbol string, ts timestamp, sentiment_compound double, sentiment_positive double, sentiment_neutral double, sentiment_negative double, confidence double"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    article = lambda i, day, c, w: (i, "A", T0 + timedelta(days=day), c, max(c, 0.0), 1 - abs(c), max(-c, 0.0), w)
    arrive(spark, src, [article(1, 0, 0.5, 0.9), article(2, 0, -0.1, 0.6), article(1, 0, 0.5, 0.9), (3, "A", None, 1.0, 1.0, 0.0, 0.0, 1.0)], schema)
    arrive(spark, src, [article(2, 0, -0.1, 0.6), article(4, 9, 0.2, 0.7)], schema)
    days = event_time.sentiment_in_event_time(stream(spark, src, schema))
    event_time.write_closed_days(days, out, str(tmp_path / "check"))
    (r,) = event_time.closed_days(days, out).collect()
    assert r.article_count == 2 and r.sentiment_compound == pytest.approx((0.5 * 0.9 - 0.1 * 0.6) / 1.5) and r.date == T0.date()
