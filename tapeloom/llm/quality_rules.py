"""Quality rules with risk-controlled thresholds, in built-in functions only.

Counts of a text give four scores in thousandths (``RULES``); a rule rejects scores above its cutoff.  Cutoffs are chosen
per stratum on labelled rows.  A language with at least ``POOL_BELOW`` good rows is a stratum of its own; all others, those
without labels too, are one pooled stratum, for which the bound then holds as a whole.

For every stratum and rule the good rows above each candidate cutoff are counted.  A cutoff is usable if, were the true rate of
false rejection the rule's share of ``risk``, so few would be seen with a probability of at most ``error`` / (strata x
rules), by the exact binomial tail.  The candidates of one stratum and rule are tested in a fixed order from the loosest to
the strictest, up to the first that fails, so they need no correction among themselves; the tail grows with the rows above,
so every candidate before the first failure passes and none behind it does.  That bounds the chance that any chosen cutoff of
any stratum exceeds its risk by ``error``.  The strictest usable cutoff wins; a rule without one rejects nothing there.  The
risks of the rules add up to ``RISK``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .shared import Stage, maybe_broadcast

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
RISK, ERROR = 0.02, 0.05
#: Good labelled rows from which a language is a stratum of its own, and the name of the stratum of all others.
POOL_BELOW, POOLED = 1500, "pooled"
#: Name, numerator, denominator, and candidate cutoffs in thousandths.
RULES: list[tuple[str, str, str, list[int]]] = [
    ("symbols", "n_symbols", "word_chars", [5, 10, 20, 30, 50, 80, 120, 200, 300, 500]),
    ("duplicate_lines", "n_dup_lines", "n_lines", [20, 50, 100, 150, 200, 300, 400, 500, 700]),
    ("repeated_words", "n_repeat_words", "n_words", [10, 30, 50, 100, 150, 200, 250]),
    ("word_length", "word_chars", "n_words", [6000, 7000, 8000, 9000, 10000, 12000, 15000, 20000, 30000]),
]


def _with_windows(t: DataFrame, size: int = 8) -> DataFrame:
    """``_windows``: one value per ``size`` (a power of two) words of ``_words`` in a row, by doubling.

    Texts without an equal pair of half windows have no equal windows; their last step is left out (null).  Every step is a
    column of its own, because an expression that refers to it several times would evaluate it as often.
    """
    t, held = t.withColumn("_w1", F.transform("_words", lambda w: F.xxhash64(w))), 1
    while held < size:
        values = F.col(f"_w{held}")
        n = F.greatest(F.size(values) - held, F.lit(0))
        pairs = F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(held + 1), n), lambda a, b: F.xxhash64(a, b))
        held *= 2
        if held == size:
            pairs = F.when(F.size(F.array_distinct(values)) < F.size(values), pairs)
        t = t.withColumn(f"_w{held}", pairs)
    return t.withColumnRenamed(f"_w{size}", "_windows")


def _covered(windows: Column, size: int = 8) -> Column:
    """Words covered by the windows whose value occurs twice or more."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    later = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1)))
    pairs = F.zip_with(ordered, later, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    places = F.sort_array(F.array_distinct(F.flatten(pairs)))
    zero = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["words"] + i + size - F.greatest(i, a["end"])).cast("long").alias("words"), (i + size).alias("end"))
    return F.aggregate(places, zero, step, lambda a: a["words"])


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` (long)."""
    t = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    t = t.withColumn("_plain", F.translate("_text", SPACES, " " * len(SPACES)))
    t = t.withColumn("_words", F.array_remove(F.split("_plain", " "), ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    t = _with_windows(t).select(
        *keep, F.size("_words").cast("long").alias("n_words"),
        F.length(F.replace("_plain", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"), "_windows",
    )
    t = t.withColumn("_repeats", F.coalesce(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.lit(False)))
    return t.select(
        *keep, "n_words", "word_chars", "n_symbols", F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_repeats"), _covered(F.col("_windows"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def score(numerator: str, denominator: str) -> Column:
    return F.when(F.col(denominator) > 0, F.floor(1000 * F.col(numerator) / F.col(denominator))).otherwise(0).cast("long")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """``P(X <= k)`` for X binomial (n, p), summed term by term; 1 where k is at the mean or above."""
    odds = math.log(p / (1 - p))
    zero = F.struct((n * math.log(1 - p)).alias("log"), F.lit(0.0).alias("total"))
    step = lambda a, i: F.struct(
        (a["log"] + F.log(F.greatest(n - i, F.lit(0)) / (i + 1)) + odds).alias("log"), (a["total"] + F.exp(a["log"])).alias("total")
    )
    return F.when(k >= n * p, 1.0).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), k), zero, step, lambda a: a["total"]))


def chosen_cutoffs(labelled: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``stratum, rule, cutoff``: the strictest usable cutoffs, from ``stratum`` and the counts of good rows."""
    above = [
        F.struct(
            F.lit(name).alias("rule"),
            sum(((score(a, b) > c).cast("int") for c in cutoffs), F.lit(0)).alias("passed"),  # candidates below the score
            F.array(*map(F.lit, cutoffs)).alias("cutoffs"),
        )
        for name, a, b, cutoffs in RULES
    ]
    seen = labelled.select("stratum", F.explode(F.array(*above)).alias("s")).groupBy("stratum", "s.rule", "s.passed", "s.cutoffs").count()
    tails = seen.groupBy("stratum", "rule", "cutoffs").agg(
        F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("passed", "count"))).alias("by_passed")  # a few per rule
    )
    tails = tails.select("stratum", "rule", "n", "by_passed", F.posexplode("cutoffs").alias("at", "cutoff"))
    over = F.aggregate(
        F.map_entries("by_passed"), F.lit(0).cast("long"), lambda t, e: t + F.when(e["key"] > F.col("at"), e["value"]).otherwise(F.lit(0).cast("long"))
    )
    strata = labelled.agg(F.count_distinct("stratum")).scalar()
    usable = tails.withColumn("k", over).filter(binomial_tail(F.col("n"), F.col("k"), risk / len(RULES)) * strata * len(RULES) <= error)
    return usable.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, pool_below: int = POOL_BELOW) -> DataFrame:
    """``doc_id, stratum``, the counts of ``text_counts``, ``base_failed`` and ``kept`` of every row of ``docs``.

    Needs ``doc_id, text, lang`` and labels ``doc_id, quality``; other columns are ignored.  A null or empty text has no
    words and fails the base; a null language counts as an empty one.  A document is good if none of its label rows has a
    quality other than 1; label rows with a null count for nothing.  Repeated rows are judged alike, each also in the
    calibration.  Without labels only the base rejects.  An empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    counts = Stage(text_counts(slim, ["doc_id", "lang"]), "text-counts").df
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("quality").alias("r"))
    good = good.filter("q = 1 AND r = 1").select("doc_id")
    labelled = Stage(counts.join(good, "doc_id", "left_semi"), "labelled-counts").df
    own = Stage(labelled.groupBy("lang").count().filter(F.col("count") >= pool_below).select(F.col("lang").alias("own")), "strata").df
    own = maybe_broadcast(own, own.count(), 10_000)
    placed = lambda df: df.join(own, F.col("lang") == F.col("own"), "left").withColumn("stratum", F.coalesce(F.concat(F.lit("lang "), "own"), F.lit(POOLED)))
    cutoffs = chosen_cutoffs(placed(labelled), risk, error)
    table = cutoffs.groupBy("stratum").pivot("rule", [r[0] for r in RULES]).agg(F.first("cutoff"))
    table = Stage(table.withColumnRenamed("stratum", "of"), "cutoffs").df
    joined = placed(counts).join(maybe_broadcast(table, table.count(), 10_000), F.col("stratum") == F.col("of"), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    passes = F.lit(True)
    for name, a, b, _ in RULES:
        passes = passes & F.coalesce(score(a, b) <= F.col(name), F.lit(True))
    kept = [c for c in counts.columns if c not in ("doc_id", "lang")]
    return joined.select("doc_id", "stratum", *kept, failed.alias("base_failed"), (~failed & passes).alias("kept"))
