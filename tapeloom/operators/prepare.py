"""Null filters, imputation, clipping and scaling.

Whatever is fitted uses training rows only and is a handful of numbers per
column; it is applied as literals, so transforming is one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import clip
from ..session import written
from .columns import null_shares
from .positions import exact_quantiles
from .windows import running

# ---- fixed values ----
IQR_FACTOR, Z_LIMIT, PERCENTILE_RANGE = 1.5, 3.0, (0.01, 0.99)
MOST_NULLS, LEAST_DEVIATION, LEAST_ROWS = 0.5, 1e-8, 100
# ---- end of fixed values ----


def train_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train") if "split" in df.columns else df


def _train_quantiles(df: DataFrame, columns: list[str], probs: list[float], stored: bool = False) -> dict[str, list[float | None]]:
    """Exact quantiles of the training rows; the columns are derived once and written, unless ``df`` is stored already."""
    train = train_rows(df).select(*columns)
    return exact_quantiles(train if stored else written(train), columns, probs)


# filters on rows and columns


def with_primary_target(df: DataFrame, target: str = "target_5") -> DataFrame:
    """Rows whose primary target is known; the first target column stands in for a missing one."""
    name = target if target in df.columns else next(c for c in df.columns if c.startswith("target_"))
    return df.filter(F.col(name).isNotNull())


def drop_without_targets(df: DataFrame) -> DataFrame:
    return df.dropna(how="all", subset=[c for c in df.columns if c.startswith("target_")])


def drop_sparse_symbols(df: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """Semi join on the symbols with enough rows; counts are pre-aggregated."""
    dense = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("symbol")
    return df.join(dense, "symbol", "left_semi")


def drop_null_columns(df: DataFrame, columns: list[str], most: float = MOST_NULLS, fill: float | None = 0.0) -> DataFrame:
    """Columns with more NULLs than allowed dropped, the rest filled."""
    shares = null_shares(df, columns)
    bad = [c for c in columns if shares[c] > most]
    df = df.drop(*bad)
    return df if fill is None else df.fillna(fill, subset=[c for c in columns if c not in bad])


def drop_empty_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    shares = null_shares(df, columns)
    return df.drop(*[c for c in columns if shares[c] >= 1.0])


def drop_constant_columns(df: DataFrame, columns: list[str], least: float = LEAST_DEVIATION) -> DataFrame:
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if row[c] is None or row[c] <= least])


def ready_for_training(df: DataFrame, features: list[str], target: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull()).fillna(0.0, subset=features)


# imputation


def impute(df: DataFrame, columns: list[str], stored: bool = False, shares: dict[str, float] | None = None) -> DataFrame:
    """Last value of the symbol, else its training median, else the training median of all, else 0.

    The rows are read for the null shares, both kinds of medians and the result, so they are derived once and written.
    ``stored`` says here and below that ``df`` reads a table that is cheap to read again, so it is not written another time.
    ``shares`` are the null shares of ``columns`` if they are known.
    """
    df = df if stored else written(df, "unfilled")
    shares = shares or null_shares(df, columns)
    columns = [c for c in columns if shares[c] > 0]  # the others need no fitting
    if not columns:
        return df
    overall = _train_quantiles(df, columns, [0.5], stored=True)
    medians = train_rows(df).groupBy(F.col("symbol").alias("__of")).agg(
        *[F.percentile(F.col(c), F.lit(0.5)).alias(f"__md_{c}") for c in columns]  # at most a series of values per column
    )
    joined = df.join(medians, F.col("symbol") == F.col("__of"), "left")
    values = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(running()), F.col(f"__md_{c}"), F.lit(overall[c][0]).cast("double"), F.lit(0.0))
        for c in columns
    }
    return joined.withColumns(values).select(*df.columns)


def impute_simple(df: DataFrame, columns: list[str], strategy: str = "median") -> DataFrame:
    """Training median or mean of the whole column."""
    train = train_rows(df)
    if strategy == "median":
        value = {c: q[0] for c, q in _train_quantiles(df, columns, [0.5]).items()}
    else:
        value = train.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(value[c]).cast("double")) for c in columns})


# clipping


def clip_bounds(
    df: DataFrame, columns: list[str], method: str = "iqr", stored: bool = False
) -> dict[str, tuple[float | None, float | None]]:
    train = train_rows(df)
    if method == "zscore":
        aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]
        row = train.agg(*aggs).first()
        return {
            c: (None, None)
            if row[f"s_{c}"] is None
            else (row[f"m_{c}"] - Z_LIMIT * row[f"s_{c}"], row[f"m_{c}"] + Z_LIMIT * row[f"s_{c}"])
            for c in columns
        }
    if method == "percentile":
        return {c: (q[0], q[1]) for c, q in _train_quantiles(df, columns, list(PERCENTILE_RANGE), stored).items()}
    if method != "iqr":
        raise ValueError(f"unknown clipping method {method}")
    out = {}
    for c, (q1, q3) in _train_quantiles(df, columns, [0.25, 0.75], stored).items():
        out[c] = (None, None) if q1 is None else (q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1))
    return out


def clip_outliers(df: DataFrame, columns: list[str], method: str = "iqr", stored: bool = False) -> DataFrame:
    bounds = clip_bounds(df, columns, method, stored)
    return df.withColumns({c: clip(F.col(c).cast("double"), *bounds[c]) for c in columns})


# scaling


@dataclass(frozen=True)
class Scale:
    """``(x - shift) / divisor * width + base`` for one column."""

    shift: float
    divisor: float
    width: float = 1.0
    base: float = 0.0

    def forward(self, x: Column) -> Column:
        return (x - self.shift) / self.divisor * self.width + self.base

    def backward(self, x: Column) -> Column:
        return (x - self.base) / self.width * self.divisor + self.shift


def fit_scales(
    df: DataFrame, columns: list[str], method: str = "robust", interval: tuple[float, float] = (0.0, 1.0), stored: bool = False
) -> dict[str, Scale]:
    """Scales from training rows: median and quartile range, mean and population deviation, or the range."""
    train = train_rows(df)
    if method == "robust":
        q = _train_quantiles(df, columns, [0.25, 0.5, 0.75], stored)
        return {c: Scale(v[1] or 0.0, ((v[2] or 0.0) - (v[0] or 0.0)) or 1.0) for c, v in q.items()}
    if method not in ("standard", "minmax", "zscore"):
        raise ValueError(f"unknown scaling method {method}")
    spread = {"standard": F.stddev_pop, "zscore": F.stddev_samp}.get(method)
    aggs = []
    for c in columns:
        if spread is None:
            aggs += [F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}")]
        else:
            aggs += [F.avg(c).alias(f"a_{c}"), spread(c).alias(f"b_{c}")]
    row = train.agg(*aggs).first()
    out = {}
    for c in columns:
        a, b = row[f"a_{c}"] or 0.0, row[f"b_{c}"] or 0.0
        if spread is None:
            out[c] = Scale(a, (b - a) or 1.0, interval[1] - interval[0], interval[0])
        else:
            out[c] = Scale(a, b or 1.0)
    return out


def apply_scales(df: DataFrame, scales: dict[str, Scale]) -> DataFrame:
    return df.withColumns({c: s.forward(F.col(c).cast("double")) for c, s in scales.items()})


def undo_scales(df: DataFrame, scales: dict[str, Scale], names: dict[str, str] | None = None) -> DataFrame:
    """Back to original units; ``names`` maps a prediction column to the column it was scaled as."""
    pairs = names or {c: c for c in scales}
    return df.withColumns({p: scales[c].backward(F.col(p)) for p, c in pairs.items()})


def scale_features(df: DataFrame, columns: list[str], method: str = "robust", stored: bool = False) -> DataFrame:
    return apply_scales(df, fit_scales(df, columns, method, stored=stored))
