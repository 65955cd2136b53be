"""Lines that many documents share, dropped with built-in functions only.

Lines are exploded with their places; the key of a line is the line stripped and in lower case.  Only long keys go on, as
two 64-bit hashes with document and place, so the texts themselves are not shuffled to count.  A hash's documents are made
distinct on (hash, document) before they are counted, so a line of a third of all documents is dealt over all tasks and
arrives at its count as one partial sum a task.  Places to drop meet their documents again, and what is left is joined in
order of place.

Keys are equal when both hashes are; nothing else is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.functions import evaluate_once

from .shared import Stage, maybe_broadcast, struct_of

SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z as a-z; ASCII lines take the fast way."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def long_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, digest, pos, h, g``: place and hashes of every line with a key of ``min_chars`` code points."""
    lines = rows.filter(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select("doc_id", "digest", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.filter(F.length("line") >= min_chars).select("doc_id", "digest", "pos", line_key(F.col("line")).alias("key"))
    return lines.filter(F.length("key") >= min_chars).select("doc_id", "digest", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """``h, g, last``: keys found in at least ``min_docs`` documents, and the largest doc_id that holds each."""
    held = lines.select("h", "g", "doc_id").distinct().groupBy("h", "g")
    return held.agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")).filter(F.col("docs") >= min_docs).drop("docs")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, carry: list[str] | None = None) -> DataFrame:
    """``row, n_lines, n_dropped, kept`` of every row: a struct of the ``carry`` columns (all unless given), lines before,
    lines dropped, and the text of the others joined by line feeds.

    Needs ``doc_id, text``.  A key of at least ``min_chars`` code points that at least ``min_docs`` documents hold loses all
    its lines except those of the largest doc_id with it, where repeats stay too.  A null text is one empty line, as an empty
    one; so is what remains when every line goes.  Rows that share a doc_id are one document when counting, and each keeps or
    loses its own lines; equal rows get equal results.  A null doc_id counts for no key and keeps its text.  Columns of the
    input sit inside ``row``, so their names cannot clash.  An empty table gives no rows.
    """
    rows = docs.select(
        struct_of(carry or docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("digest", F.xxhash64("text"))
    lines = Stage(long_lines(rows, min_chars), "line-keys")
    shared = Stage(shared_lines(lines.df, min_docs), "shared-lines")
    hits = lines.df.join(maybe_broadcast(shared.df, shared.df.count()), ["h", "g"]).filter(F.col("doc_id") < F.col("last"))
    gone = Stage(hits.groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("gone")), "dropped-lines")  # places of one document
    lines.drop()
    shared.drop()
    places = gone.df.agg(F.sum(F.size("gone"))).first()[0] or 0
    joined = rows.join(maybe_broadcast(gone.df, places), ["doc_id", "digest"], "left")
    n = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    joined = joined.select("row", "text", "gone", n.alias("n_lines"))
    joined = evaluate_once(joined, "split", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))  # an own column: the lambda below reads it once a line
    left = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.col("split")[i]), "\n"))
    return joined.select("row", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
