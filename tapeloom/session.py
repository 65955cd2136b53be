"""Session defaults and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings a job on a large cluster starts from.  All of them can be
#: overridden by the submitter; nothing in the library depends on them.
CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "tapeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword dots are written as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(CLUSTER_DEFAULTS)
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may run without it: there the driver's disk is every
    task's disk.  On a cluster a machine-local folder would be lost together
    with its executor, so that case is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    folder = tempfile.mkdtemp(prefix="tapeloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    Cuts the lineage with reliable storage, so a lost executor re-reads a file
    instead of re-running the plan, and non-repeatable values such as partition
    ids are frozen.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there.

    Like :func:`durable`, but later reads take only the columns and rows they need.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes above which the JVM never compiles a method, and the setting up to which Spark makes one of an operator chain.
_COMPILED, _CHAINED = "8000", "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Operator chains over so many columns that their method would never be compiled run one by one instead."""
    before = spark.conf.get(_CHAINED)
    spark.conf.set(_CHAINED, _COMPILED)
    try:
        yield
    finally:
        spark.conf.set(_CHAINED, before)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for a written stage."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
