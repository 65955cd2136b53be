"""The corpus pipeline: each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm.jaccard_join import ngram_jaccard_join
from tapeloom.llm.mixing import mix, training_order
from tapeloom.llm.ordinal import classify
from tapeloom.llm.packing import pack
from tapeloom.llm.shared import Stage
from tapeloom.llm.suffix_dedup import suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; without labels all stay."""
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, that of the smallest doc_id (of equal ids, all rows)."""
    classes = ngram_jaccard_join(docs, size=5, percent=80)
    gone = classes.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters of 50-byte strings that an earlier document has; emptied documents go."""
    cut = suffix_dedup(docs, whole_characters=True)
    text = F.when(F.size("spans") > 0, F.col("kept").cast("string")).otherwise(F.col("row.text"))
    count = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    out = cut.filter((F.size("spans") == 0) | (F.length("kept") > 0)).select("row", "spans", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": count}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, once per take, in training order."""
    return training_order(mix(docs, whole_documents=True)).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the words of each document go: pieces, bins, lengths and offsets."""
    return pack(docs, carry=["doc_id"]).select("row.doc_id", "piece", "first_word", "n_words", "bin_id", "bin_length", "bin_offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("mixing", mixture),
    ("packing", packing),
]

#: The classifier, the suffix sort and the packing have no SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Stage(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
