"""Connected components by contraction; links stay in Spark tables throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import Stage


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``links`` (two id columns ``a, b``): the smallest id reachable.

    Each round points every node at its smallest neighbour, follows the pointers twice and contracts.  Pointers only go
    down, so the smallest node of a component is never moved and is what remains.  At least one end of every link moves
    in each round, so rounds grow with the logarithm of the longest path.  Self links and nulls are ignored.
    """
    edges = Stage(
        links.filter(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links",
    )
    moved: list[Stage] = []
    while not edges.df.isEmpty():
        e = edges.df
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        next_ = step.select(F.col("v").alias("p"), F.col("p").alias("q"))
        jumped = step.join(next_, "p").select("v", F.col("q").alias("p"))
        moved.append(Stage(jumped, "moves"))
        p = moved[-1].df
        fresh = Stage(
            e.join(p.select(F.col("v").alias("a"), F.col("p").alias("x")), "a")
            .join(p.select(F.col("v").alias("b"), F.col("p").alias("y")), "b")
            .filter(F.col("x") != F.col("y"))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links",
        )
        edges.drop()
        edges = fresh
    if not moved:
        return edges.df.select(F.col("a").alias("id"), F.col("b").alias("component"))
    label = moved[0].df.select(F.col("v").alias("id"), F.col("p").alias("component"))
    for m in moved[1:]:
        later = m.df.select(F.col("v").alias("component"), F.col("p").alias("c2"))
        label = label.join(later, "component", "left").select("id", F.coalesce("c2", "component").alias("component"))
    return label
