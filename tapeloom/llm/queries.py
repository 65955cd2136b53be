"""The dealt operators as registered queries: whole tables, production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .centroids import centroid_clusters
from .chat_format import format_chat, read_back
from .embedding_dedup import embedding_dedup
from .hard_negatives import hard_negatives
from .jaccard_join import ngram_jaccard_join
from .language_model import score_texts
from .line_dedup import line_dedup
from .mixing import mix, taken_in_order, training_order
from .ordinal import classify
from .packing import pack
from .quality_rules import ERROR, POOL_BELOW, POOLED, RISK, RULES, quality_rules
from .shared import Stage
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


SQL["op1_ngram_jaccard_join"] = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                     ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
up AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
links AS (SELECT a, b FROM up UNION ALL SELECT b, a FROM up),
reach AS (SELECT a AS id, a AS r FROM (SELECT DISTINCT a FROM links) UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.id AND reach.r < l.b),
least_of AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(c, t.doc_id)) AS component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN least_of ON least_of.id = t.doc_id
"""


_SIZE = "coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)"


@_query
def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = Stage(mix(_table(spark, sf_dir, "documents"), carry=["doc_id"]), "mixed").df
    order = Stage(training_order(mixed, keep=("source", "start")), "training-order").df  # written in order, times and all
    return taken_in_order(mixed, order).select("row.doc_id", "size", "source_size", "target", "taken")


SQL["op2_mixing_sources"] = f"""
WITH sized AS (SELECT doc_id, source, CAST({_SIZE} AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM totals),
levels AS (
  SELECT *, ((sum(source_size) OVER () - (sum(cap) OVER w - cap))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER w) + weight)::DOUBLE) AS level
  FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
targets AS (SELECT source, source_size, least(cap::DOUBLE, (max(level) OVER ()) * weight) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(CAST(s.doc_id AS VARCHAR)), s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size
            + CASE WHEN words // source_size >= 3 THEN 0 ELSE least(greatest(words % source_size - start, 0), size) END END AS BIGINT) AS taken
FROM placed
"""


@_query
def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(mix(_table(spark, sf_dir, "documents"), carry=["doc_id"])).select("row.doc_id", "time", "words")


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _score_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST(floor(1000 * {a} / {b}) AS BIGINT) ELSE 0 END"


_RULE_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, stratum, '{name}' AS rule, {_score_sql(a, b)} AS score, unnest({cutoffs}) AS cutoff FROM counted" for name, a, b, cutoffs in RULES
)
_VERDICTS = " UNION ALL ".join(
    f"SELECT doc_id, {_score_sql(a, b)} > cutoff AS over FROM counted JOIN chosen USING (stratum) WHERE rule = '{name}'" for name, a, b, _ in RULES
)
SQL["op3_quality_rules"] = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM t)),
dups AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM dups) GROUP BY doc_id),
measured AS (
  SELECT t.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN reps USING (doc_id)),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
own AS (SELECT lang FROM measured SEMI JOIN good USING (doc_id) GROUP BY lang HAVING count(*) >= {POOL_BELOW}),
counted AS (SELECT *, CASE WHEN lang IN (SELECT lang FROM own) THEN 'lang ' || lang ELSE '{POOLED}' END AS stratum FROM measured),
tested AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (score > cutoff) AS k FROM ({_RULE_ROWS}) SEMI JOIN good USING (doc_id) GROUP BY ALL),
tails AS (
  SELECT stratum, rule, cutoff, (SELECT count(DISTINCT stratum) FROM tested) * {len(RULES)} AS tests,
         CASE WHEN k >= n * {RISK / len(RULES)} THEN 1 ELSE list_sum(list_transform(range(0, k + 1),
           lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK / len(RULES)}) + (n - i) * ln(1 - {RISK / len(RULES)})))) END AS tail FROM tested),
chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tails WHERE tail * tests <= {ERROR} GROUP BY ALL),
over AS (SELECT DISTINCT doc_id FROM ({_VERDICTS}) WHERE over)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM over) AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
"""


_CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@_query
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chat(turns.unionByName(spark.createDataFrame(_CONTROL_TURNS, turns.schema))))


def _escaped_sql(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for control in ("<s>", "</s>", "[INST]", "[/INST]"):
        x = f"replace({x}, '{control}', '{control[0]}\\{control[1:]}')"
    return x


SQL["op4_chat_formatting"] = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(replace({_escaped_sql("role")}, chr(10), '\\' || chr(10))) + length({_escaped_sql("text")})
            + CASE role WHEN 'assistant' THEN 0 ELSE 15 END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


@_query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), carry=["doc_id"])
    return docs.select("row.doc_id", "expected_grade", "p_poor_or_better", "p_good", "kept")


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


@_query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    cut = suffix_dedup(docs, carry=["doc_id", "n_bytes"])
    return cut.select(
        "row.doc_id", "row.n_bytes", (F.col("row.n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


SQL["op9_embedding_dedup"] = """
WITH RECURSIVE units AS (
  SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))
  WHERE list_dot_product(v, v) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u)
          WHERE list_dot_product(a.u, b.u) >= 9e-1),
reach AS (SELECT a AS id, a AS r FROM (SELECT DISTINCT a FROM links) UNION SELECT l.a, reach.r FROM reach JOIN links l ON l.b = reach.id AND reach.r < l.a),
least_of AS (SELECT id, min(r) AS c FROM reach GROUP BY id),
counted AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings e LEFT JOIN least_of ON least_of.id = vec_id LEFT JOIN counted ON counted.id = vec_id
"""


@_query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), carry=["doc_id"]).select("row.doc_id", "piece", "first_word", "n_words", "bin_id", "bin_length", "bin_offset")


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label))


def _finite_sql(x: str) -> str:
    return f"len({x}) = len(list_filter({x}, lambda x: x IS NOT NULL AND isfinite(x)))"


SQL["op11_hard_negatives"] = f"""
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_finite_sql("embedding")}),
s AS (SELECT a.k AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
             CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.k <> b.k AND len(a.v) = len(b.v)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS r FROM s WHERE alike QUALIFY r <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 10
"""


@_query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return cut.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op12_line_dedup"] = """
WITH lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
               FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM lines),
shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT r, doc_id, line, pos, coalesce(doc_id < last, false) AS dropped FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


@_query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_table(spark, sf_dir, "embeddings"))


def _assign_sql(n: int) -> str:
    return f"""d{n} AS MATERIALIZED (
  SELECT k, c.cluster, sum((x - y) * (x - y)) AS distance
  FROM parts JOIN (SELECT cluster, i, x AS y FROM c{n}) c USING (i) GROUP BY ALL),
a{n} AS MATERIALIZED (SELECT k, arg_min(cluster, distance * 8 + cluster) AS cluster, min(distance) AS distance FROM d{n} GROUP BY k)"""


def _move_sql(n: int) -> str:
    return f"""c{n + 1} AS MATERIALIZED (
  SELECT cluster, i, coalesce(m.x, c.x) AS x
  FROM c{n} c LEFT JOIN (SELECT cluster, i, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
                         FROM parts JOIN a{n} USING (k) GROUP BY cluster, i) m USING (cluster, i))"""


_ROUNDS = ",\n".join(part for n in range(10) for part in (_assign_sql(n), _move_sql(n)))
SQL["op13_centroid_clusters"] = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND {_finite_sql("embedding")}),
parts AS MATERIALIZED (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept),
first AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS cluster FROM kept QUALIFY cluster < 8),
c0 AS MATERIALIZED (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM first),
{_ROUNDS},
{_assign_sql(10)},
digests AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c10 GROUP BY cluster)
SELECT vec_id, CAST(a10.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY a10.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a10 JOIN kept USING (k) JOIN digests ON digests.cluster = a10.cluster
"""
