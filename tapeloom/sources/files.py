"""Reading input tables and writing stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .schemas import RAW_NEWS, require_columns
from .spanning import read_spanning_csv
from .standardize import parse_date


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, line_breaks: bool = False) -> DataFrame:
    """Parquet, or CSV with a declared schema (no inference pass).

    Fields may hold quotes (doubled).  Say ``line_breaks`` when they may also hold
    line breaks: records are then put together by :func:`read_spanning_csv`, which
    reads the splits of a file in parallel as well.
    """
    if schema is None:
        return spark.read.parquet(path)
    if line_breaks:
        return read_spanning_csv(spark, path, schema)
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    return reader.option("quote", '"').option("escape", '"').csv(path)


def convert_news(spark: SparkSession, csv_path: str, path: str) -> DataFrame:
    """The raw news file as a Parquet table of ``date_text, date, symbol, headline``, every row of it.

    A date that fits no layout stays as text beside a NULL date; see :func:`undated`.
    """
    raw = read_table(spark, csv_path, RAW_NEWS, line_breaks=True)
    require_columns(raw, ["Date", "Article_title", "Stock_symbol"])
    news = raw.select(
        F.col("Date").alias("date_text"), parse_date(F.col("Date")).alias("date"),
        F.col("Stock_symbol").alias("symbol"), F.col("Article_title").alias("headline"),
    )
    news.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def undated(news: DataFrame) -> DataFrame:
    """One row: how many rows have a date, and how many have a text that is none."""
    return news.agg(F.count("date").alias("dated"), F.count_if(F.col("date").isNull()).alias("undated"))


def read_news(spark: SparkSession, path: str, symbols: list[str] | None, start: str, end: str) -> DataFrame:
    """A converted news table as ``date, symbol, headline`` limited to a universe and a date range.

    File splits take the place of hand-made chunks; both filters are pushed into the scan.
    """
    return in_universe(read_table(spark, path).select("date", "symbol", "headline"), symbols, start, end)


def in_universe(df: DataFrame, symbols: list[str] | None, start: str, end: str) -> DataFrame:
    """Rows of the listed symbols (all when None) with the date in the closed range."""
    df = df.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return df.filter(F.col("symbol").isin(symbols)) if symbols else df


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a stage table; rows of a file are sorted by symbol and date for later pruning."""
    order = [c for c in ("symbol", "date") if c in df.columns]
    writer = (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def write_splits(df: DataFrame, path: str) -> None:
    """All splits in one table partitioned by ``split``; the full set is the table itself."""
    write_stage(df, path, partition_by=["split"])


def write_report(report: DataFrame, path: str) -> None:
    """A report of bounded size as JSON lines."""
    report.write.mode("overwrite").json(path)
