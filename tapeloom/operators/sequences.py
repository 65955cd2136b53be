"""Sliding windows for sequence models, batch scoring and distributed regressors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.numeric import finite, total
from .windows import series, whole

# ---- fixed values: lengths and sequence checks ----
SEQUENCE_ROWS = 60
LEAST_VARIANCE, LARGEST_LABEL = 1e-8, 5.0
ENCODER_ROWS, HORIZON_ROWS, LEAST_HORIZON_ROWS = 80, 16, 3
NAIVE_ROWS = [22, 66]
# ---- end of fixed values ----


def _steps(features: list[str], rows: tuple[int, int], fill: bool) -> Column:
    """The features of a row frame as an array of float arrays."""
    values = [F.coalesce(finite(f), F.lit(0.0)) if fill else finite(f) for f in features]
    return F.collect_list(F.array(*[v.cast("float") for v in values])).over(series().rowsBetween(*rows))


def _usable(features: list[str], frame: tuple[int, int]) -> Column:
    """All values of the frame present and their variance over all of them above the limit.

    The variance of rows and columns together is the mean of the variances inside
    the rows plus the variance of the rows' means, so one number per row and plain
    rolling aggregates are enough.
    """
    values = [finite(f).cast("float").cast("double") for f in features]
    mean = total(values) / len(values)
    inside = total([F.pow(v - mean, 2.0) for v in values]) / len(values)
    over = series().rowsBetween(*frame)
    complete = F.count(mean).over(over) == F.count(F.lit(1)).over(over)
    return complete & (F.avg(inside).over(over) + F.var_pop(mean).over(over) > LEAST_VARIANCE)


def training_windows(df: DataFrame, features: list[str], target: str, rows: int = SEQUENCE_ROWS) -> DataFrame:
    """``sequence`` of the ``rows`` rows before each row and the row's target as ``label``.

    Project first, window last: the result is ``rows`` times the input, so it is
    meant to be streamed into training or written, never cached.
    """
    slim = df.select("symbol", "date", *features, target)
    label, frame = finite(target), (-rows, -1)
    return (
        slim.withColumns({"sequence": _steps(features, frame, fill=False), "__usable": _usable(features, frame)})
        .filter((F.size("sequence") == rows) & label.isNotNull() & (F.abs(label) < LARGEST_LABEL) & F.col("__usable"))
        .select("symbol", "date", "sequence", label.cast("float").alias("label"))
    )


def inference_windows(df: DataFrame, features: list[str], rows: int = SEQUENCE_ROWS) -> DataFrame:
    """Every full window ending at a row, missing values as 0."""
    slim = df.select("symbol", "date", *features)
    return (
        slim.withColumn("sequence", _steps(features, (-(rows - 1), 0), fill=True))
        .filter(F.size("sequence") == rows)
        .select("symbol", "date", "sequence")
    )


def encoder_decoder_windows(
    df: DataFrame, features: list[str], target: str, encoder: int = ENCODER_ROWS, horizon: int = HORIZON_ROWS
) -> DataFrame:
    """Past features and future targets around each row, targets normalised per symbol.

    Encoders run from a third of ``encoder`` rows up, decoders from 3 rows up.  An
    unknown future target is a NULL at its place in the decoder.  With a ``split``
    column mean and deviation come from the symbol's training rows alone.
    """
    fitted = F.when(F.col("split") == "train", F.col(target)) if "split" in df.columns else F.col(target)
    df = df.withColumn("__fitted", fitted)
    slim = df.select("symbol", "date", *features, target, "__fitted")
    center, spread = F.avg("__fitted").over(whole()), F.stddev_samp("__fitted").over(whole())
    scaled = (F.col(target) - center) / F.coalesce(F.nullif(spread, F.lit(0.0)), F.lit(1.0))
    slim = slim.withColumns({"__y": scaled, "target_center": center, "target_scale": spread})
    steps = F.collect_list(F.struct(F.col("__y").cast("float").alias("y"))).over(series().rowsBetween(1, horizon))
    future = F.transform(steps, lambda s: s["y"])
    return (
        slim.withColumns({"encoder": _steps(features, (-(encoder - 1), 0), fill=True), "decoder": future})
        .filter((F.size("encoder") >= encoder // 3) & (F.size("decoder") >= LEAST_HORIZON_ROWS))
        .select("symbol", "date", "encoder", "decoder", "target_center", "target_scale")
    )


def score_windows(windows: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Predictions of any model over windows, batch by batch through Arrow.

    ``load`` runs once per task and returns a function from ``[n, rows, features]``
    to ``[n]``.
    """
    names = [c for c in windows.columns if c != "sequence"]
    schema = T.StructType([*[windows.schema[c] for c in names], T.StructField("prediction", T.DoubleType())])

    def tensor(sequence: pa.Array) -> np.ndarray:
        """The values as they lie in the batch, which has the lists of all windows end to end."""
        steps, n = sequence.flatten(), len(sequence)
        for lists in (sequence, steps):
            size = pc.min_max(pc.fill_null(pc.list_value_length(lists), -1))
            if size["min"] != size["max"]:
                raise ValueError("windows differ in their numbers of rows or features")
        return steps.flatten().to_numpy(zero_copy_only=False).reshape(n, len(steps) // n, -1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = load()
        for batch in batches:
            found = np.asarray(predict(tensor(batch.column("sequence"))), dtype=float) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, from_pandas=True)], [*names, "prediction"])

    return windows.mapInArrow(score, schema)


REGRESSORS = {
    "linear_ridge": lambda **o: LinearRegression(**{"regParam": 0.1, "elasticNetParam": 0.0, **o}),
    "random_forest": lambda **o: RandomForestRegressor(**{"numTrees": 20, "maxDepth": 6, "seed": 42, **o}),
    "boosted_trees": lambda **o: GBTRegressor(**{"maxIter": 20, "maxDepth": 4, "seed": 42, **o}),
}


def fit_regressor(df: DataFrame, features: list[str], target: str, kind: str, **options) -> PipelineModel:
    """A distributed regressor on rows with a known target, missing features as 0."""
    ready = df.filter(F.col(target).isNotNull()).fillna(0.0, subset=features)
    assembler = VectorAssembler(inputCols=features, outputCol="__features")
    model = REGRESSORS[kind](featuresCol="__features", labelCol=target, predictionCol="prediction", **options)
    return Pipeline(stages=[assembler, model]).fit(ready)


def predict(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(df.fillna(0.0, subset=features)).drop("__features")


def naive_forecasts(df: DataFrame, target: str, rows: list[int] = NAIVE_ROWS) -> DataFrame:
    """No-change, last value, running mean and moving means of the target, each from earlier rows only."""
    past = series().rowsBetween(Window.unboundedPreceding, -1)
    before = {f"moving_average_{n}": F.avg(target).over(series().rowsBetween(-n, -1)) for n in rows}
    return df.withColumns(
        {
            "random_walk": F.lit(0.0),
            "last_value": F.lag(target).over(series()),
            "historical_mean": F.avg(target).over(past),
            **before,
        }
    )
