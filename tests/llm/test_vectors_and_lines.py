"""Line dedup, centroid clustering and hard negatives against plain versions, with skew, ties and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import hard_negatives as negatives_module
from tapeloom.llm.centroids import centroid_clusters, neighbours, orchard
from tapeloom.llm.hard_negatives import Best, Block, best_alike, best_in_windows, hard_negatives, window
from tapeloom.llm.line_dedup import line_dedup

from . import brute

LONG = "a line that stands in many of these documents"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def line_rows():
    rnd = random.Random(8)
    pool = [f"{w} {LONG} {k}" for k, w in enumerate(["alpha", "Beta", "gämma", "ÄRGER", "İstanbul", "ſhort", "straße", "K"])]
    pool += ["x" * 39, "X" * 40, "é" * 39, "É" * 40, "short", ""]
    rows = []
    for i in range(60):
        lines = [rnd.choice(["", " ", "\t"]) + (line.upper() if rnd.random() < 0.2 else line) + rnd.choice(["", "  ", "\r", "\x0b\x0c"])
                 for line in rnd.choices(pool, k=rnd.randint(1, 9))]
        rows.append((i * 3, "\n".join(lines)))
    rows += [(None, "\n".join(pool)), (None, None), (500, None), (501, ""), (502, "\n"), (503, "\n\n" + pool[0]), (504, " " * 50), (505, " " + LONG + " ")]
    rows += [(510 + k, "\n".join(["only four documents hold this rather long line"] * 3)) for k in range(4)]
    rows += [(600, "\n".join(f"{LONG} {k % 7}" for k in range(4000)))]  # a long text
    rows += [rows[5], rows[5], (rows[6][0], rows[7][1])]  # repeated rows; one id with two texts
    rnd.shuffle(rows)
    return rows


def test_line_dedup(spark):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, "p", "q") for i, t in rows], "doc_id long, text string, `a.b` string, gone string").repartition(4)
    out = line_dedup(df)
    assert got(out.select("row.doc_id", "n_lines", "n_dropped", "kept")) == brute.line_dedup(rows)
    assert out.select("row.*").columns == df.columns


@pytest.mark.parametrize("min_chars, min_docs", [(1, 2), (5, 1), (46, 30)])
def test_line_dedup_limits(spark, min_chars, min_docs):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(line_dedup(df, min_chars, min_docs, ["doc_id"]).select("row.doc_id", "n_lines", "n_dropped", "kept")) == brute.line_dedup(rows, min_chars, min_docs)


def test_line_dedup_hot_line_is_summed_before_the_shuffle(spark):
    """A line of every document: tasks of the last count get partial sums, not one row a document."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(LONG + "\n"), F.repeat(F.col("id").cast("string"), 20)).alias("text"))
    out = line_dedup(df)
    assert out.agg(F.sum("n_dropped")).first()[0] == 2999
    assert [tuple(r) for r in out.filter("n_dropped = 0").select("row.doc_id").collect()] == [(2999,)]


def test_line_dedup_uses_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = line_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("tapeloom.llm.line_dedup.maybe_broadcast", lambda df, n: df)
    rows = line_rows()
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id"])
    assert got(out.select("row.doc_id", "n_lines", "n_dropped", "kept")) == brute.line_dedup(rows)


def vectors(n, dim, seed, spread=1.0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [[float(np.float32(c + rnd.gauss(0, spread))) for c in rnd.choice(centres)] for _ in range(n)]


def test_orchard_equals_full_search():
    rng = np.random.default_rng(1)
    for k, dim, wide in [(1, 3, 9), (2, 1, 2), (9, 2, 3), (20, 5, 40), (64, 8, 30)]:
        centroids, x = rng.integers(-wide, wide, (k, dim)), rng.integers(-wide, wide, (500, dim))
        cluster, dist, measured = orchard(x, centroids, *neighbours(centroids))
        full = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert (dist == full.min(axis=1)).all() and (cluster == full.argmin(axis=1)).all()  # argmin: the first of equal ones
        assert measured <= 500 * k


def test_orchard_skips_far_centroids():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-100_000, 100_000, (50, 2))
    x = centroids[rng.integers(0, 50, 2000)] + rng.integers(-50, 50, (2000, 2))
    _, _, measured = orchard(x, centroids, *neighbours(centroids))
    assert measured < 2000 * 50 / 2


def test_centroid_clusters(spark):
    rows = list(enumerate(vectors(300, 4, 3)))
    rows += [(900, rows[0][1]), rows[1], rows[1], (None, rows[2][1]), (901, None), (902, []), (903, [1.0] * 5), (904, [1.0, None, 1.0, 1.0])]
    rows += [(905, [float("nan")] * 4), (906, [1.0, 1.0, float("inf"), 1.0]), (907, [0.0] * 4), (908, [-1e-9] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("vec", F.lit(1)).repartition(5)
    assert got(centroid_clusters(df, dim=4)) == brute.centroid_clusters([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], dim=4)


def test_centroid_clusters_few_and_equal_rows(spark):
    for rows in ([(1, [1.0, 2.0])], [(k, [0.5, 0.5]) for k in range(30)], [(k, [float(k % 2), 0.0]) for k in range(12)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert got(centroid_clusters(df, dim=2)) == brute.centroid_clusters(rows, dim=2)


def test_centroid_clusters_large_components(spark):
    rows = [(1, [60000.0, -60000.0]), (2, [-60000.0, 60000.0]), (3, [1e30, 0.0])]
    out = got(centroid_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1, dim=2))
    assert [r[0] for r in out] == [1, 2] and out == brute.centroid_clusters(rows[:2], k=1, dim=2)


def test_bounds_never_drop_a_result():
    rng = np.random.default_rng(5)
    for dim, wide in [(1, 3), (3, 4), (24, 200), (64, 60)]:
        x, q = rng.integers(-wide, wide + 1, (700, dim)), rng.integers(-wide, wide + 1, dim)
        block = Block(x, np.arange(700), np.arange(700)[::-1].copy(), np.zeros(700, np.int64))
        full, best = x @ q, Best(5)
        best_alike(q, block, np.arange(700), best)
        order = np.lexsort([block.id, -full])
        assert best.score.tolist() == full[order[:5]].tolist() and best.id.tolist() == block.id[order[:5]].tolist()
        found = [(*window(int(p), 30, 90), Best(10)) for p in best.score]
        best_in_windows(q, block, np.arange(700), found)
        for a, b, have in found:
            inside = [i for i in order if a <= full[i] <= b][:10]
            assert have.id.tolist() == block.id[inside].tolist()


def test_bounds_shrink_candidates():
    """Components that fall off fast: most columns are read for a few candidates only."""
    rng = np.random.default_rng(6)
    size = 1000 // (1 + np.arange(64))
    x, q = rng.integers(-size, size + 1, (2048, 64)), rng.integers(-size, size + 1, 64)
    block, best = Block(x, np.arange(2048), np.arange(2048), np.zeros(2048, np.int64)), Best(5)
    assert best_alike(q, block, np.arange(2048), best) < 2048 * 64 / 3
    assert sorted(best.score)[::-1] == sorted(x @ q)[::-1][:5]


def test_windows_are_exact():
    for p in range(-20, 60):
        a, b = window(p, 30, 90)
        assert [s for s in range(-60, 80) if 30 * p <= 100 * s <= 90 * p] == list(range(a, b + 1))


def negative_rows():
    rnd = random.Random(7)
    rows = [(k, rnd.choice([0, 0, 1, 2]), v) for k, v in enumerate(vectors(400, 6, 9, 0.6))]
    rows += [rows[100], rows[200], (1000, 0, rows[0][2]), (1100, 9, rows[3][2]), (1200, 1, [0.0] * 6), (1300, 1, [1.0] * 3), (1301, 1, [0.9] * 3), (1302, 0, [0.5] * 3)]
    rows += [(1400, None, rows[1][2]), (None, 1, rows[1][2]), (1500, 1, None), (1501, 1, [float("nan")] * 6), (1502, 1, [1.0, None] * 3), (1600, 2, [])]
    return rows


def test_hard_negatives(spark, monkeypatch):
    rows = negative_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, `rank` string, `a.b` int").repartition(3)
    want = brute.hard_negatives(rows)
    assert len(want) > 150 and got(hard_negatives(df)) == sorted(want, key=repr)
    monkeypatch.setattr(negatives_module, "LEAST_CELL", 40)
    monkeypatch.setattr(negatives_module, "CELL", 40)  # many cells, groups and blocks give the same
    monkeypatch.setattr(negatives_module, "ANCHORS", 2)
    assert got(hard_negatives(df)) == sorted(want, key=repr)


def test_hard_negatives_one_label_holds_most_rows(spark):
    rows = [(k, 0 if k % 10 else 1, v) for k, v in enumerate(vectors(600, 4, 4))]
    assert got(hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))) == sorted(brute.hard_negatives(rows), key=repr)


def test_hard_negatives_equal_vectors(spark):
    rows = [(k, k % 3, [1.0, 2.0] if k % 3 == 0 else [0.5, 1.0]) for k in range(120)]
    assert got(hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))) == sorted(brute.hard_negatives(rows), key=repr)


@pytest.mark.parametrize("run", [centroid_clusters, hard_negatives, line_dedup])
def test_empty_table(spark, run):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>, doc_id long, text string")
    assert run(df).count() == 0
