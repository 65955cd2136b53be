"""Files processed in bounded chunks as they arrive.

A large news or trade folder is read as a file stream: every micro-batch is one
chunk, remembered in the stream's checkpoint, so a restart continues behind the
last finished chunk and an executor loss repeats one chunk at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import news
from ..session import stage_path
from ..sources.bars import order_number


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*", fmt: str = "parquet", files_per_chunk: int = 100
) -> DataFrame:
    """Unbounded table over the files of a folder; a pattern as ``folder`` may name folders and single files."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", pattern)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.option("maxFilesPerTrigger", files_per_chunk).load(folder)


def process_arrived(stream: DataFrame, chunk: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Apply ``chunk`` to everything that has arrived and append it to the table at ``out``.

    Each micro-batch owns one directory and overwrites it when repeated, which makes
    the write exactly-once.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunk(batch).write.mode("overwrite").parquet(f"{out}/chunk={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def clean_arrived_articles(articles: DataFrame, out: str) -> DataFrame:
    """Gate and clean arriving articles chunk by chunk; returns the table written so far, copies removed."""
    process_arrived(articles, news.clean_articles, out, f"{out}-progress")
    return news.distinct_articles(articles.sparkSession.read.parquet(out).drop("chunk"))


def partial_bars(trades: DataFrame, order: list[tuple[str, int]]) -> DataFrame:
    """Mergeable bars of one chunk: prices with the order keys that decide open and close.

    ``trades`` has ``symbol, date, price, size`` and the order columns.
    """
    return trades.withColumn("__o", order_number(order)).groupBy("symbol", "date").agg(
        F.min("__o").alias("first"), F.min_by("price", "__o").alias("open"),
        F.max("__o").alias("last"), F.max_by("price", "__o").alias("close"),
        F.max("price").alias("high"), F.min("price").alias("low"), F.sum("size").alias("size"),
    )


def merge_bars(partials: DataFrame) -> DataFrame:
    """Bars from the partial bars of any number of chunks."""
    return partials.groupBy("symbol", "date").agg(
        F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last").alias("close"), F.sum("size").cast("bigint").alias("volume"),
    )


def bars_of_arrived(trades: DataFrame, order: list[tuple[str, int]], out: str | None = None) -> DataFrame:
    """Daily bars of a trade stream, each chunk reduced before it is written."""
    out = out or stage_path(trades.sparkSession, "partial-bars")
    process_arrived(trades, lambda batch: partial_bars(batch, order), out, f"{out}-progress")
    return merge_bars(trades.sparkSession.read.parquet(out))
