"""The pipeline's stages against plain versions, each on what its predecessor kept; all registered queries run."""

import collections

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from catalog.check import compare, duck
from tapeloom.llm.shared import Stage

from . import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = Stage(stage(spark, docs, SF_DIR), name).df
        out.append((name, docs, made))
        docs = made
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    columns = stages[0][1].columns
    assert [n for n, _, _ in stages] == ["quality_classifier", "ngram_jaccard", "suffix_dedup", "mixing", "packing"]
    assert all(made.columns == columns for _, _, made in stages[:-1])


def test_classifier_keeps_rows_unchanged(stages):
    _, before, after = stages[0]
    assert set(rows(after)) <= set(rows(before)) and after.count() >= 0.7 * before.count()  # a quarter is labelled poor or toxic


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    want = [i for i, _, c in brute.jaccard(rows(before), 5, 80) if i == c]
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)


def test_repeated_strings_go(stages):
    _, before, after = stages[2]
    new = dict(rows(after))
    plain = brute.repeated_strings(rows(before))
    removed, spans = {r[0]: r[2] for r in plain}, {r[0]: r[3] for r in plain}
    for i, text in rows(before):
        left = len((text or "").encode()) - len((new.get(i) or "").encode())
        assert 0 <= removed[i] - left <= 6 * spans[i]  # characters that a span would split stay
        assert removed[i] or new[i] == text


def test_mixture_takes_whole_documents(stages):
    _, before, after = stages[3]
    texts, taken = dict(rows(before)), collections.Counter(r.doc_id for r in after.collect())
    assert all(texts[i] == t for i, t in rows(after)) and max(taken.values()) <= 3
    full = [(r.doc_id, r.source, r.text) for r in before.collect()]
    _, target = brute.mixture(full)
    for s, want in target.items():
        sizes = {i: len(brute.words_of(t)) for i, x, t in full if x == s}
        assert abs(sum(taken[i] * n for i, n in sizes.items()) - want) <= max(sizes.values())


def test_packing_places_all_words(stages):
    _, before, after = stages[4]
    assert sum(r.n_words for r in after.collect()) == sum(len(brute.words_of(t)) for _, t in rows(before))


@pytest.mark.parametrize("name", sorted(n for n in queries() if n == "pipeline" or n.startswith("op")))
def test_query(spark, name):
    ok, info = compare(spark, duck(SF_DIR), SF_DIR, queries()[name], oracle_sql().get(name))
    assert ok, info
