"""Purged folds over time, with an embargo.

A row's label covers the dates from the row itself to its ``horizon``-th following row of the symbol.  A fold tests a run of
consecutive dates; the labels of its test rows reach further, and that whole span of dates is what training labels must not
touch.  Rows whose label touches the span are *purged*, rows whose label comes within ``embargo`` dates of it are
*embargoed*, and the others train.

Dates are counted by their position among the distinct dates of the panel, which the calendar bounds.  Bounds are a few
numbers per fold; they are fitted once and applied as literals, so the roles of a row cost one projection.
"""

from __future__ import annotations

from datetime import date as Date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from .metrics import forecast_metrics
from .windows import series

# ---- fixed values ----
FOLDS, EMBARGO = 5, 5
# ---- end of fixed values ----


class Fold(NamedTuple):
    """Test dates from ``first`` to ``last``; their labels end by ``reach``; the embargo runs from ``before`` to ``after``."""

    number: int
    first: Date
    last: Date
    reach: Date
    before: Date
    after: Date


def label_spans(panel: DataFrame, horizon: int) -> DataFrame:
    """``label_end``: the date on which the label of a row is known; NULL without one."""
    return panel.withColumn("label_end", F.lead(F.col("date").cast("date"), horizon).over(series()))


def fold_bounds(panel: DataFrame, folds: int = FOLDS, embargo: int = EMBARGO, walk_forward: bool = True) -> list[Fold]:
    """The folds of a panel with ``label_end``; those without a labelled test row are left out.

    Walking forward, the distinct dates make ``folds + 1`` equal runs and the first one only trains.  Otherwise every one of
    ``folds`` runs is tested once.
    """
    runs = folds + int(walk_forward)
    day, over = F.col("date").cast("date"), Window.orderBy("date")  # distinct dates only
    dates = panel.select(day.alias("date")).filter("date IS NOT NULL").distinct()
    dates = dates.withColumns({"__p": F.row_number().over(over), "__n": F.count(F.lit(1)).over(Window.partitionBy())})
    dates = dates.withColumn("run", F.floor((F.col("__p") - 1) * runs / F.col("__n")).cast("int"))
    ends = panel.filter("label_end IS NOT NULL").groupBy(day.alias("date")).agg(F.max("label_end").alias("reach"))
    spans = dates.join(ends, "date", "left").groupBy("run").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.max("reach").alias("reach"))
    spans = spans.filter("reach IS NOT NULL")
    around = dates.select("date", F.lag("date", embargo).over(over).alias("before"), F.lead("date", embargo).over(over).alias("after"))
    spans = spans.join(around.select(F.col("date").alias("first"), "before"), "first", "left").join(around.select(F.col("date").alias("reach"), "after"), "reach", "left")
    least, most = (panel.agg(f(day)).scalar() for f in (F.min, F.max))
    spans = spans.select("run", "first", "last", "reach", F.coalesce("before", least).alias("before"), F.coalesce("after", most).alias("after"))
    rows = spans.filter(F.col("run") >= int(walk_forward)).orderBy("run").collect()  # one row a fold
    return [Fold(r.run + int(not walk_forward), r["first"], r["last"], r.reach, r.before, r.after) for r in rows]


def _role(f: Fold, walk_forward: bool) -> Column:
    day, end = F.col("date").cast("date"), F.col("label_end")
    role = F.when(day.between(F.lit(f.first), F.lit(f.last)), "test")
    if walk_forward:
        role = role.when(day > F.lit(f.last), None)
    touches = lambda a, b: (day <= F.lit(b)) & (end >= F.lit(a))
    return role.when(touches(f.first, f.reach), "purged").when(touches(f.before, f.after), "embargoed").otherwise("train")


def fold_roles(
    panel: DataFrame, horizon: int, folds: int = FOLDS, embargo: int = EMBARGO, walk_forward: bool = True
) -> DataFrame:
    """``fold`` and ``role`` (train, test, purged or embargoed) of every labelled row in every fold it belongs to.

    Rows without a label belong to no fold, and walking forward neither do rows behind a fold's test dates.  A row comes once
    per fold; its other columns come along, so select what is needed first.  An empty panel has no folds and no rows.
    """
    spanned = label_spans(panel, horizon)
    bounds = fold_bounds(spanned, folds, embargo, walk_forward)
    each = F.array(*[F.struct(F.lit(f.number).alias("fold"), _role(f, walk_forward).alias("role")) for f in bounds])
    each = each if bounds else F.array().cast("array<struct<fold:int,role:string>>")
    rows = spanned.filter("label_end IS NOT NULL").withColumn("__each", F.explode(each))
    return rows.filter("__each.role IS NOT NULL").select(*panel.columns, "label_end", "__each.fold", "__each.role")


def fold_summary(roles: DataFrame) -> DataFrame:
    """Rows and first and last date and label end per fold and role."""
    return roles.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("label_end").alias("last_label")
    )


def fold_leaks(roles: DataFrame) -> DataFrame:
    """Per fold, dates on which a training label overlaps the span of the test labels: 0 wherever the folds are sound."""
    test = roles.filter("role = 'test'").groupBy("fold").agg(F.min("date").alias("first"), F.max("label_end").alias("reach"))
    train = roles.filter("role = 'train'").join(F.broadcast(test), "fold")  # one row a fold
    leak = (F.col("date") <= F.col("reach")) & (F.col("label_end") >= F.col("first"))
    return train.groupBy("fold").agg(F.count_if(leak).alias("leaks"))


def fold_mean_scores(roles: DataFrame, label: str) -> DataFrame:
    """Forecast metrics per fold of the plainest model fitted on its training rows alone: the symbol's mean label.

    A symbol without training rows in a fold takes the mean of the fold.
    """
    train = F.when((F.col("role") == "train"), F.col(label))
    own = roles.groupBy("fold", "symbol").agg(F.avg(train).alias("__own"), F.sum(train).alias("__s"), F.count(train).alias("__c"))
    everyone = own.groupBy("fold").agg((F.sum("__s") / F.nullif(F.sum("__c"), F.lit(0))).alias("__all"))  # one row a fold
    fitted = own.join(F.broadcast(everyone), "fold").select("fold", "symbol", F.coalesce("__own", "__all").alias("yhat"))
    tested = roles.filter("role = 'test'").join(fitted, ["fold", "symbol"])
    return forecast_metrics(tested.withColumn("y", F.col(label)).filter("y IS NOT NULL AND yhat IS NOT NULL"), ["fold"])
