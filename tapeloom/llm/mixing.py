"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code point order (null last) weigh ``WEIGHTS`` in turn and share the words of the whole corpus by
weight; a target stops at ``most`` times its source's words and the excess is shared by the others.  In the order of
cap over weight this water level is one running sum over the table of sources.

Placement: a source's weight follows a piecewise linear schedule over training time.  Its integral, scaled to the
target, is the source's cumulative demand.  Its documents, in the fixed order of a digest, meet the demand one after the
other, epoch by epoch; inverting the demand at the middle of a document gives the document's time.  The last document of
the last epoch is cut where the demand ends, so that every source gives exactly its target, rounded to words.
``training_order`` range-sorts by time.

Running sums are taken in two levels, over digest prefixes and within one prefix, so a source with a third of all rows
is dealt out like any other rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import maybe_broadcast, n_words, struct_of

WEIGHTS = (1, 2, 3)
MOST = 3
#: Multipliers of a weight over training time: light sources open the training, heavy ones close it.
SCHEDULES = {
    1: [(0.0, 1.5), (0.5, 1.25), (1.0, 0.25)],
    2: [(0.0, 1.0), (1.0, 1.0)],
    3: [(0.0, 0.5), (0.5, 0.75), (1.0, 2.0)],
}


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, source_rows, weight, target`` from rows of ``source, size``; one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")).cast("long")
    t = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    upto = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.partitionBy()
    t = t.withColumn("words", F.sum("source_size").over(all_rows)).withColumn("weighs", F.sum("weight").over(all_rows))
    level = (F.col("words") - (F.sum("cap").over(upto) - F.col("cap"))) / (F.col("weighs") - F.sum("weight").over(upto) + F.col("weight"))
    t = t.withColumn("level", level).withColumn("level", F.max("level").over(all_rows))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return t.select("source", "source_size", "source_rows", "weight", target.alias("target"))


def _demand_time(share: Column, weight: Column, schedules: dict[int, list[tuple[float, float]]]) -> Column:
    """The time at which the integral of the weight's schedule reaches ``share`` of the whole."""
    out = None
    for w, knots in schedules.items():
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        whole, before, time = sum(areas), 0.0, None
        for (t0, g0), (t1, g1), area in zip(knots, knots[1:], areas):
            need = F.greatest(share * whole - before, F.lit(0.0))
            slope = (g1 - g0) / (t1 - t0)
            step = need / g0 if slope == 0 else (F.sqrt(F.greatest(g0 * g0 + 2 * slope * need, F.lit(0.0))) - g0) / slope
            here = F.least(t0 + step, F.lit(t1))
            last = share * whole <= before + area
            time = F.when(last, here) if time is None else time.when(last, here)
            before += area
        time = time.otherwise(knots[-1][0])
        out = F.when(weight == w, time) if out is None else out.when(weight == w, time)
    return out


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, schedules: dict | None = None,
    whole_documents: bool = False, carry: list[str] | None = None,
) -> DataFrame:
    """``row, size, source_size, target, taken, placements, source, start`` of every row of ``docs``.

    ``row`` is a struct of the ``carry`` columns (all unless given), so names cannot clash.  ``size`` counts words
    ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none and is never taken.  ``taken`` is the words the mix takes, repeats
    counted, at most ``most`` times the size.  ``placements`` has the time in [0, 1] and the words of each take;
    ``start``, the words of its source before it, tells rows with words apart within their ``source``.  With
    ``whole_documents`` nothing is cut: the last epoch takes documents whose middle lies before the end of demand.  Null
    sources are one source, the last.  Rows are ordered by digest of doc_id, size and text; equal rows may change places,
    which changes no result.  An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(struct_of(carry or docs.columns).alias("row"), F.col("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    rows = rows.select("row", "source", n_words("text").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("digest"), F.xxhash64("text").alias("tie"))
    slim = docs.select(F.col("source").cast("string").alias("source"), text.alias("text")).select("source", n_words("text").alias("size"))
    targets = source_targets(slim, weights, most)
    prefix = F.ceil(F.log(F.col("source_rows").cast("double")) / (2 * math.log(16.0))).cast("int")  # as many prefixes as rows in one
    targets = targets.withColumn("words", F.round("target").cast("long")).withColumn("cut", prefix).withColumnRenamed("source", "name")
    targets = maybe_broadcast(targets, targets.count(), 100_000)
    placed = rows.join(targets, F.col("source").eqNullSafe(F.col("name"))).drop("source")
    placed = placed.withColumn("part", F.substring("digest", F.lit(1), F.col("cut")))
    parts = placed.groupBy("name", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("name").alias("n"), F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("name", "part").orderBy("digest", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("upto", F.sum("size").over(inside))
    placed = placed.join(parts, F.col("name").eqNullSafe(F.col("n")) & (F.col("part") == F.col("p")))
    start = F.col("before") + F.col("upto") - F.col("size")
    placed = placed.withColumn("start", start).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0))
    left = F.col("words") - F.col("epochs") * F.col("source_size")
    last = F.least(F.greatest(left - F.col("start"), F.lit(0)), F.col("size"))
    if whole_documents:
        last = F.when(2 * left >= 2 * F.col("start") + F.col("size"), F.col("size")).otherwise(0)
    placed = placed.withColumn("last", F.when(F.col("epochs") >= most, 0).otherwise(last).cast("long"))
    takes = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("epochs")),
        lambda k: F.struct(k.alias("epoch"), F.when(k < F.col("epochs"), F.col("size")).otherwise(F.col("last")).alias("words")),
    )
    time = lambda x: _demand_time(
        (x["epoch"] * F.col("source_size") + F.col("start") + x["words"] / 2) / F.col("words"), F.col("weight"), schedules or SCHEDULES
    )
    placements = F.transform(F.filter(takes, lambda x: x["words"] > 0), lambda x: F.struct(time(x).alias("time"), x["words"].alias("words")))
    taken = F.col("epochs") * F.col("size") + F.col("last")
    return placed.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"), placements.alias("placements"), F.col("name").alias("source"), start.cast("long").alias("start"))


def training_order(mixed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``row, time, words`` of every take and the ``keep`` columns, range-partitioned and sorted by time."""
    takes = mixed.select("row", *keep, F.explode("placements").alias("take")).select("row", "take.time", "take.words", *keep)
    return takes.repartitionByRange("time").sortWithinPartitions("time")


def taken_in_order(mixed: DataFrame, order: DataFrame) -> DataFrame:
    """``mixed`` with ``taken`` as the words of a row's takes in ``order``, which keeps ``source`` and ``start``."""
    sums = order.groupBy(F.col("source").alias("s"), F.col("start").alias("p")).agg(F.sum("words").alias("taken"))
    rows = mixed.drop("taken")
    found = rows.filter("size > 0").join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("p")), "left").drop("s", "p")
    without = rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))  # never taken; several may have one start
    return found.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).unionByName(without)
