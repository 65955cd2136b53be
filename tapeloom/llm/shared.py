"""Stages in the shared folder, size-checked broadcasts and small column helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tapeloom.session import stage_path

#: Sides up to this many rows of a few numbers are broadcast (about 16 MB); larger ones are joined with a shuffle.
BROADCAST_ROWS = 1_000_000


class Stage:
    """A table written to the shared folder, which outlives any executor.  ``drop`` removes it once later stages are
    written; nothing reads it after that."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark, self.path = df.sparkSession, stage_path(df.sparkSession, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when the counted ``rows`` are within the limit; else the planner shuffles."""
    return F.broadcast(df) if rows <= limit else df


def struct_of(columns: list[str]):
    """The columns in one struct, whatever characters their names have."""
    return F.struct(*[f"`{c.replace('`', '``')}`" for c in columns])


def with_row(rows: DataFrame, others: str) -> T.StructType:
    """The schema of ``row``, all of its fields nullable, and the ``others`` (as DDL)."""
    def open_(t):
        if isinstance(t, dict):
            return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else open_(v) if k != "metadata" else v for k, v in t.items()}
        return [open_(x) for x in t] if isinstance(t, list) else t

    whole = T.StructType([rows.schema["row"], *T.StructType.fromDDL(others).fields])
    return T.StructType.fromJson(open_(whole.jsonValue()))


def nullable(column: pa.ChunkedArray | pa.Array) -> pa.ChunkedArray | pa.Array:
    """The column under a type whose fields may all be null, as a schema given by names has it."""
    def open_(t: pa.DataType) -> pa.DataType:
        if pa.types.is_struct(t):
            return pa.struct([pa.field(f.name, open_(f.type), True, f.metadata) for f in t])
        if pa.types.is_list(t):
            return pa.list_(pa.field(t.value_field.name, open_(t.value_type), True, t.value_field.metadata))
        return t

    return column.cast(open_(column.type))


def parts_for(spark: SparkSession, units: float, per_part: float) -> int:
    """Partitions for ``units`` of work with at most ``per_part`` each, and no fewer than the session's default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-units // per_part)), 1)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.ascontiguousarray(values), kind))


def blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary per row from an array whose first axis the bounds cut."""
    data = np.ascontiguousarray(values)
    at = (bounds * (data.nbytes // max(len(data), 1))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def take_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after the other."""
    ends = np.cumsum(lengths)
    if len(ends) == 0 or ends[-1] == 0:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def n_words(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; 0 for null."""
    return F.coalesce(F.expr(f"regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("bigint")


def xxhash64(ids: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of a long column."""
    u = lambda x: np.uint64(x)
    p1, p2, p3, p4, p5 = map(u, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    roll = lambda x, r: (x << u(r)) | (x >> u(64 - r))
    h = (np.full(len(ids), 42 + 8, np.uint64) + p5) ^ (roll(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = roll(h, 27) * p1 + p4
    h = (h ^ (h >> u(33))) * p2
    h = (h ^ (h >> u(29))) * p3
    return (h ^ (h >> u(32))).view(np.int64)
