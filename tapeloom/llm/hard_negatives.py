"""Hard negatives of anchors by a BOND vertical scan, in exact integers.

Anchors are dealt to groups and all vectors to cells; every group meets every cell once, in a task of its own whose size is
bounded on both sides.  There a block of vectors lies column by column.  An anchor reads the columns in descending order of
its own components; after a few columns the part still unread of a vector's score lies between the sums of the remaining
products with the least and greatest component of each column.  These bounds shrink the candidates' bitmap, and only what
stays is read further, so that scores at the end are exact.

The scan runs twice.  The first finds each anchor's best vectors of its own label: a candidate goes when its greatest
possible score is below the k-th best score sure so far.  Their scores fix the windows; the second scan finds the best vectors
of other labels in each window: a candidate goes when its bounds miss every window, or when k better ones are sure in each
that they meet.  A task keeps the best k of an anchor (and window) over all its blocks and sends only those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import Stage, parts_for

#: Anchors of a group, most vectors of a cell (about 64 MB at 64 components), vectors that are worth a cell of their own,
#: vectors of a block, and columns read between two looks at the bounds.
ANCHORS, CELL, LEAST_CELL, BLOCK, STEP = 4096, 1 << 18, 4096, 2048, 8
#: Integers above this size would not surely give scores within a long.
LIMIT = 1 << 23
LONGEST = 4096


def integers(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null unless all components are finite and the integers within ``LIMIT``."""
    parts = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < LIMIT), F.lit(False)))
    return F.when(fine & (F.size(embedding) <= LONGEST), parts).cast("array<int>")


class Block:
    """Vectors column by column, with the least and greatest component of each column."""

    def __init__(self, x: np.ndarray, key: np.ndarray, id_: np.ndarray, label: np.ndarray) -> None:
        self.columns = np.ascontiguousarray(x.T)
        self.low, self.high = (self.columns.min(axis=1), self.columns.max(axis=1)) if len(x) else (np.zeros(x.shape[1], np.int64),) * 2
        self.key, self.id, self.label = key, id_, label


def scan(q: np.ndarray, block: Block, rows: np.ndarray, stays: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and exact scores of the candidates ``rows`` (places) that no look at the bounds drops, and how many components were read.

    ``stays(low, high)`` is the bitmap of candidates that stay, given bounds of their scores.
    """
    order = np.argsort(-np.abs(q), kind="stable")
    a, b = q * block.low, q * block.high
    least, most = np.minimum(a, b)[order], np.maximum(a, b)[order]
    score, read = np.zeros(len(rows), np.int64), 0
    for start in range(0, len(order), STEP):
        step = order[start : start + STEP]
        for d in step.tolist():
            score += q[d] * block.columns[d][rows]
        read += len(step) * len(rows)
        rest = start + len(step)
        alive = stays(score + least[rest:].sum(), score + most[rest:].sum())
        if not alive.all():
            rows, score = rows[alive], score[alive]
            if not len(rows):
                break
    return rows, score, read


class Best:
    """The first ``k`` by (score descending, id ascending) of what was added."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def sure(self, low: np.ndarray) -> int | None:
        """The k-th best score, the lower bounds ``low`` being scores of further candidates; None with fewer than k."""
        have = np.concatenate([self.score, low])
        return int(np.partition(have, len(have) - self.k)[len(have) - self.k]) if len(have) >= self.k else None

    def add(self, score: np.ndarray, id_: np.ndarray) -> None:
        score, id_ = np.concatenate([self.score, score]), np.concatenate([self.id, id_])
        first = np.lexsort([id_, -score])[: self.k]
        self.score, self.id = score[first], id_[first]


def best_alike(q: np.ndarray, block: Block, rows: np.ndarray, best: Best) -> int:
    """Add to ``best`` the candidates with the highest scores."""

    def stays(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        t = best.sure(low)
        return np.ones(len(low), bool) if t is None else high >= t

    rows, score, read = scan(q, block, rows, stays)
    best.add(score, block.id[rows])
    return read


def best_in_windows(q: np.ndarray, block: Block, rows: np.ndarray, windows: list[tuple[int, int, Best]]) -> int:
    """Add to the ``Best`` of every window (least score, greatest score, Best) the candidates with the highest scores inside."""

    def stays(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        alive = np.zeros(len(low), bool)
        for a, b, best in windows:
            t = best.sure(low[(low >= a) & (high <= b)])  # surely inside
            alive |= (low <= b) & (high >= (a if t is None else max(a, t)))
        return alive

    rows, score, read = scan(q, block, rows, stays)
    for a, b, best in windows:
        inside = (score >= a) & (score <= b)
        best.add(score[inside], block.id[rows[inside]])
    return read


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    return t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim).astype(np.int64)


def _blocks(t: pa.Table, dim: int) -> Iterator[Block]:
    for start in range(0, t.num_rows, BLOCK):
        part = t.slice(start, BLOCK)
        yield Block(_matrix(part, dim), _column(part, "key"), _column(part, "vec_id"), _column(part, "label"))


_FOUND = "anchor long, positive_score long, score long, vec_id long"


def _found(parts: list[tuple[int, int | None, Best]]) -> pa.Table:
    anchor = [np.full(len(b.id), a) for a, _, b in parts] or [np.zeros(0, np.int64)]
    ps = [p for _, p, b in parts for _ in range(len(b.id))]
    score, ids = ([getattr(b, n) for _, _, b in parts] or [np.zeros(0, np.int64)] for n in ("score", "id"))
    return pa.table(
        [pa.array(np.concatenate(anchor), pa.int64()), pa.array(ps, pa.int64()), pa.array(np.concatenate(score), pa.int64()), pa.array(np.concatenate(ids), pa.int64())],
        ["anchor", "positive_score", "score", "vec_id"],
    )


def _positives(k: int) -> Callable:
    def run(cell: pa.Table, anchors: pa.Table) -> pa.Table:
        if not cell.num_rows or not anchors.num_rows:
            return _found([])
        dim = cell.column("dim")[0].as_py()
        q, key, label = _matrix(anchors, dim), _column(anchors, "key"), _column(anchors, "label")
        best = [Best(k) for _ in key]
        for block in _blocks(cell, dim):
            for i in range(len(key)):
                best_alike(q[i], block, np.flatnonzero((block.label == label[i]) & (block.key != key[i])), best[i])
        return _found([(a, None, b) for a, b in zip(key.tolist(), best)])

    return run


def _negatives(k: int, low: int, high: int) -> Callable:
    def run(cell: pa.Table, anchors: pa.Table) -> pa.Table:
        if not cell.num_rows or not anchors.num_rows:
            return _found([])
        dim = cell.column("dim")[0].as_py()
        q, key, label = _matrix(anchors, dim), _column(anchors, "key"), _column(anchors, "label")
        sought = [[(p, *window(p, low, high), Best(k)) for p in ps] for ps in anchors.column("positives").to_pylist()]
        for block in _blocks(cell, dim):
            for i in range(len(key)):
                best_in_windows(q[i], block, np.flatnonzero(block.label != label[i]), [(a, b, best) for _, a, b, best in sought[i] if a <= b])
        return _found([(a, p, best) for a, each in zip(key.tolist(), sought) for p, _, _, best in each])

    return run


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100, scale: int = 256
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the anchors of ``vectors`` (needs
    ``vec_id, label, embedding``): rows whose vec_id is divisible by ``every``.

    A component x counts as floor(scale * x); scores are inner products with the anchor.  Higher scores come first, ties by
    smaller vec_id.  An anchor's positives are its first ``positives`` other rows of its label; per positive come the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * score <= high * positive_score, all if fewer.  A
    positive without such rows gives none, nor does an anchor without positives.

    Rows with a null vec_id or label, a null vector, or a null or non-finite component take no part, nor do vectors of over
    ``LONGEST`` components or with an integer of ``LIMIT`` or more in size.  Vectors of different lengths do not meet.
    Repeated rows are rows of their own: each is an anchor, and a copy of an anchor is one of its positives.  Other columns
    are ignored.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integers(F.col("embedding"), scale).alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
    table = Stage(rows.select(F.monotonically_increasing_id().alias("key"), "*", F.size("vec").alias("dim")), "vectors")  # keys are frozen here
    chosen = table.df.filter(F.col("vec_id") % every == 0)
    n, groups = table.df.count(), -(-chosen.count() // ANCHORS)
    cells = max(-(-n // CELL), min(parts_for(spark, 0, 1), -(-n // LEAST_CELL)))  # a cell sends its best k, however few vectors it has
    dealt = lambda n, name: F.pmod(F.xxhash64("key", F.lit(name)), F.lit(max(n, 1))).cast("int").alias(name)
    all_of = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias(name)
    cell_rows = table.df.select("key", "vec_id", "label", "vec", "dim", dealt(cells, "cell"), all_of(groups, "group"))

    def meet(anchors: DataFrame, run: Callable) -> DataFrame:
        placed = anchors.select("*", dealt(groups, "group"), all_of(cells, "cell"))
        return cell_rows.groupBy("dim", "cell", "group").cogroup(placed.groupBy("dim", "cell", "group")).applyInArrow(run, _FOUND)

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")  # at most k rows a cell
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    alike = Stage(first(meet(chosen.select("key", "label", "vec", "dim"), _positives(positives)), ["anchor"], positives), "positives")
    windows = alike.df.groupBy("anchor").agg(F.collect_set("score").alias("positives"))  # at most ``positives`` scores
    sought = chosen.select("key", "label", "vec", "dim").join(windows, F.col("key") == F.col("anchor")).drop("anchor")
    found = first(meet(sought, _negatives(negatives, low, high)), ["anchor", "positive_score"], negatives)
    named = alike.df.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.select("anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "positive_score"])
    out = out.join(chosen.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
