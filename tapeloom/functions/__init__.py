"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def evaluate_once(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Add a costly column that later filters and projections must not repeat.

    The optimizer copies a column's expression into every filter it pushes below
    the projection and would run a chain of regular expressions once per copy.  It
    does not look through an explode of a one-element array.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(expression)).alias(name))
