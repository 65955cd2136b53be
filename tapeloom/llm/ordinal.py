"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade <= k) = sigmoid(cut_k - w . x)``: one weight per hashed term, shared by all grades, and ordered cut points.
The model gives every text an expected grade and the tail probabilities ``P(grade >= k)``; selection is by a tail.

Labels are graded 0 toxic, 1 poor, 2 good.  The fit takes at most ``sample`` labelled rows, those with the least hash of
their id, so what reaches the driver is bounded whatever the corpus; four fifths fit the weights, the rest set the tail
that rejects at most ``false_rejection`` of the good rows.  All texts are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scan
from .shared import Stage, blobs, nullable, struct_of, take_ranges, with_row

BUCKETS = 1 << 20
SAMPLE = 20_000
STEM_BYTES, LEAST_ROWS = 5, 5
STEPS, BATCH, RATE, DECAY = 1500, 128, 0.15, 1e-3
FALSE_REJECTION = 0.01

_CLASSES = {"symbols": b"#*$%&|<>!", "capitals": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "lines": b"\n"}


def _share_steps(share: np.ndarray) -> np.ndarray:
    """A share as a step of a logarithmic scale, 0 to 12."""
    return np.clip(np.ceil(np.log2(np.maximum(share, 2.0**-12)) + 12), 0, 12).astype(np.uint64)


def features(run: scan.Run) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each row and their bounds: its terms, their stems, and the steps of a few shares."""
    w = scan.words(run, between=scan.NOT_TERM)
    n_bytes, n_terms = np.diff(run.bounds), np.diff(w.rows)
    stem = scan.span_hash(scan.lowered(run.data), w.start, np.minimum(w.start + STEM_BYTES, w.end)) ^ np.uint64(1 << 50)
    _, distinct = scan.sets(w.value, w.rows)
    terms, rows = scan.sets(np.stack([w.value, stem], axis=1).ravel(), 2 * w.rows)
    shapes = []
    for k, members in enumerate(_CLASSES.values()):
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        upto = np.concatenate([[0], np.cumsum(table[run.data])])
        shapes.append(_share_steps((upto[run.bounds[1:]] - upto[run.bounds[:-1]]) / np.maximum(n_bytes, 1)) + np.uint64(100 * k))
    shapes.append(_share_steps(1 - np.diff(distinct) / np.maximum(n_terms, 1)) + np.uint64(900))
    shapes.append(np.floor(np.log2(n_terms + 1)).astype(np.uint64) + np.uint64(1000))
    shape = scan.mix(np.stack(shapes, axis=1) + np.uint64(1 << 40))
    bounds = rows + np.arange(len(rows)) * shape.shape[1]
    value = np.empty(bounds[-1], np.uint64)
    at = np.arange(len(terms)) + np.repeat(np.arange(len(n_terms)) * shape.shape[1], np.diff(rows))
    value[at] = terms
    value[(bounds[1:, None] - np.arange(shape.shape[1], 0, -1)).ravel()] = shape.ravel()
    return (value % np.uint64(BUCKETS)).astype(np.int32), bounds


class Model(NamedTuple):
    weights: np.ndarray
    cuts: np.ndarray
    reject_below: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _scores(weights: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[value], bounds[:-1]) if len(value) else np.zeros(len(bounds) - 1)


def tails(model: Model, scores: np.ndarray) -> np.ndarray:
    """``P(grade >= k)`` for k = 1, 2, ... as columns."""
    return 1 - _sigmoid(model.cuts[None, :] - scores[:, None])


class Sample(NamedTuple):
    """Labelled rows; the features of row i are ``value[start[i] : start[i] + length[i]]``."""

    value: np.ndarray
    start: np.ndarray
    length: np.ndarray
    grade: np.ndarray
    doc_id: np.ndarray


def fit(sample: Sample, held: np.ndarray, n_grades: int = 3, false_rejection: float = FALSE_REJECTION) -> Model:
    """Fit on the rows that are not ``held``; held rows of the best grade set the rejection tail.

    Features found in fewer than ``LEAST_ROWS`` fitted rows keep the weight 0.
    AdaGrad on the negative log likelihood, in a fixed order, so that equal rows give an equal model.
    """
    value, start, length, grades, _ = sample
    fitted = np.flatnonzero(~held)
    share = np.array([(np.mean(grades[fitted] <= k) if len(fitted) else 0.5) for k in range(n_grades - 1)])
    cuts = np.log((share + 1e-3) / (1 - share + 1e-3)) + np.arange(n_grades - 1) * 1e-3
    found = np.zeros(BUCKETS, np.int32)
    for a in range(0, len(fitted), BATCH):
        rows = fitted[a : a + BATCH]
        np.add.at(found, value[take_ranges(start[rows], length[rows])], 1)
    found = found >= LEAST_ROWS
    weights, seen, seen_cuts = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), np.full(n_grades - 1, 1e-6)
    shuffle = np.random.default_rng(7)
    for _ in range(-(-STEPS * BATCH // max(len(fitted), 1)) if len(fitted) else 0):
        shuffle.shuffle(fitted)
        for a in range(0, len(fitted), BATCH):
            rows = fitted[a : a + BATCH]
            lengths = length[rows]
            v, g = value[take_ranges(start[rows], lengths)], grades[rows]
            s = np.add.reduceat(weights[v], np.cumsum(lengths) - lengths)
            below = np.concatenate([np.zeros((len(rows), 1)), _sigmoid(cuts[None, :] - s[:, None]), np.ones((len(rows), 1))], axis=1)
            dens = below * (1 - below)
            at = np.arange(len(rows))
            p = np.maximum(below[at, g + 1] - below[at, g], 1e-9)
            slope_s = (dens[at, g + 1] - dens[at, g]) / p  # of the loss by the score
            used, back = np.unique(v, return_inverse=True)
            slope = np.bincount(back, np.repeat(slope_s, lengths)) / len(rows) + DECAY * weights[used]
            slope[~found[used]] = 0  # too rare to tell
            seen[used] += slope**2
            weights[used] -= RATE * slope / np.sqrt(seen[used])
            slope_c = np.array([np.sum(((g == k + 1) * 1.0 - (g == k)) * dens[:, k + 1] / p) for k in range(n_grades - 1)]) / len(rows)
            seen_cuts += slope_c**2
            cuts = np.maximum.accumulate(cuts - RATE * slope_c / np.sqrt(seen_cuts))
    model = Model(weights.astype(np.float32), cuts, 0.0)
    best = held & (grades == n_grades - 1)
    if best.any():
        keep = np.flatnonzero(best)
        s = np.array([weights[value[start[r] : start[r] + length[r]]].sum() for r in keep])
        tail = np.sort(tails(model, s)[:, -1])
        model = model._replace(reject_below=float(min(tail[int(false_rejection * len(tail))], 0.5)))
    return model


def _read_features() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in scan.runs(batch.column("text")):
                value, bounds = features(r)
                n = r.last - r.first
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(r.first, n), batch.column("grade").slice(r.first, n), blobs(value, bounds)],
                    ["doc_id", "grade", "features"],
                )

    return run


def _score(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if model.value is None else Model(*model.value)  # sent as a plain tuple: an executor need not know the class
        for batch in batches:
            row = nullable(batch.column("row"))
            for r in scan.runs(batch.column("text")):
                own = row.slice(r.first, r.last - r.first)
                if m is None:
                    blank = pa.nulls(len(own), pa.float64())
                    yield pa.RecordBatch.from_arrays([own, blank, blank, blank, pa.array([True] * len(own))], _NAMES)
                    continue
                t = tails(m, _scores(m.weights, *features(r)))
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(t.sum(axis=1)), pa.array(t[:, 0]), pa.array(t[:, 1]), pa.array(t[:, 1] >= m.reject_below)], _NAMES
                )

    return run


_NAMES = ["row", "expected_grade", "p_poor_or_better", "p_good", "kept"]


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 toxic, 1 poor, 2 good; the worst of several rows; rows with nulls are left out."""
    g = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("toxic").isNotNull() & F.col("quality").isNotNull(), 2)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), g.alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of at most ``sample`` labelled documents; None without any."""
    picked = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(picked), "doc_id")  # at most `sample` rows of two numbers
    stage = Stage(joined.mapInArrow(_read_features(), "doc_id long, grade int, features binary"), "labelled")
    drawn = _gathered(stage.df)
    stage.drop()
    if not len(drawn.grade):
        return None
    return fit(drawn, scan.mix(drawn.doc_id.view(np.uint64)) % np.uint64(5) == 0)


def _gathered(rows: DataFrame) -> Sample:
    """The rows in a fixed order.  One partition at a time is fetched and the driver holds every feature once."""
    features, found = bytearray(), []
    for r in rows.toLocalIterator():
        found.append((r.doc_id, r.grade, blake2b(r.features, digest_size=16).digest(), len(features) // 4, len(r.features) // 4))
        features += r.features
    found.sort()  # rows with the same digest are equal
    column = lambda i: np.array([f[i] for f in found], np.int64)
    return Sample(np.frombuffer(features, np.int32), column(3), column(4), column(1), column(0))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, carry: list[str] | None = None) -> DataFrame:
    """``row, expected_grade, p_poor_or_better, p_good, kept`` of every row of ``docs``.

    ``row`` is a struct of the ``carry`` columns (all unless given), so names cannot clash.  A null text is scored as an
    empty one.  Repeated rows get equal scores; a row is scored whether or not it is labelled, also with a null doc_id.
    Without labelled documents the scores are null and everything is kept.  An empty table gives no rows.
    """
    fitted = fit_on(docs, labels, sample)
    model = docs.sparkSession.sparkContext.broadcast(None if fitted is None else tuple(fitted))  # BUCKETS floats
    rows = docs.select(struct_of(carry or docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), with_row(rows, "expected_grade double, p_poor_or_better double, p_good double, kept boolean"))
