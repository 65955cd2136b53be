"""Best-fit packing into bins of several permitted lengths.

Words are counted once and rows numbered; then documents are cut in pieces of at most the largest length and dealt by a hash
of row number and piece to shards of about ``PER_SHARD`` pieces, so equal rows are dealt over all shards like others.  A
shard has the length mix of the corpus, so packing shards apart costs next to nothing and needs bounded memory.  Within a
shard pieces go from long to short into the open bin that they fill best.  Where none has room, a bin is opened in the
size of least cost per word expected in it, given the pieces that are left and would fit beside this one.  At the end
every bin shrinks to the least permitted length that holds what it got.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Stage, n_words, nullable, struct_of, with_row

LENGTHS = (512, 1024, 2048, 4096)
PER_SHARD = 8192
_SHARD_BINS = 1 << 32


def bin_cost(length: int, longest: int) -> float:
    """Cost of a sequence: its positions, and a share for attention that grows with its square."""
    return length * (1 + length / (4 * longest))


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final bin length of each piece; ``sizes`` in descending order, 1 to the largest length."""
    lengths = tuple(sorted(lengths))
    held = sizes.tolist()
    ascending = sizes[::-1]
    volume = np.concatenate([[0], np.cumsum(ascending)]).tolist()  # of the k smallest
    ascending = ascending.tolist()
    spaces: list[int] = []  # distinct free spaces of open bins, sorted
    open_bins: dict[int, list[int]] = {}
    used: list[int] = []
    room: list[int] = []
    bins, offsets = np.empty(len(held), np.int64), np.empty(len(held), np.int64)
    for i, size in enumerate(held):
        at = bisect_left(spaces, size)
        if at < len(spaces):
            space = spaces[at]
            b = open_bins[space].pop()
            if not open_bins[space]:
                del open_bins[space]
                spaces.pop(at)
        else:
            left = len(held) - i - 1
            best = None
            for length in lengths[bisect_left(lengths, size) :]:
                fitting = min(bisect_left(ascending, length - size + 1), left)
                expected = min(length, size + volume[fitting])
                cost = bin_cost(length, lengths[-1]) / expected
                if best is None or cost < best[0]:
                    best = (cost, length)
            b, space = len(used), best[1]
            used.append(0)
            room.append(space)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        space -= size
        if space:
            if space not in open_bins:
                insort(spaces, space)
                open_bins[space] = []
            open_bins[space].append(b)
    shrunk = np.array([lengths[bisect_left(lengths, u)] for u in used], np.int64)
    return bins, offsets, shrunk[bins]


def _pack(lengths: tuple[int, ...]) -> Callable:
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        size = shard.column("n_words").to_numpy()
        order = np.lexsort((shard.column("uid").to_numpy(), shard.column("tie").to_numpy(), -size))
        bins, offsets, length = best_fit(size[order], lengths)
        shard = shard.take(pa.array(order))
        own = shard.column("shard").to_numpy() * _SHARD_BINS + bins
        return pa.table(
            [nullable(shard.column("row")), shard.column("piece"), shard.column("first_word"), shard.column("n_words"),
             pa.array(own), pa.array(length), pa.array(offsets)], _NAMES
        )

    return run


_NAMES = ["row", "piece", "first_word", "n_words", "bin_id", "bin_length", "bin_offset"]


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, per_shard: int = PER_SHARD, carry: list[str] | None = None) -> DataFrame:
    """``row, piece, first_word, n_words, bin_id, bin_length, bin_offset``: one row per piece of a document.

    ``row`` is a struct of the ``carry`` columns (all unless given), so names cannot clash.  A document of n words has
    ``ceil(n / max(lengths))`` pieces; all but the last are full.  A null or empty text has one piece of no words, in no
    bin (null).  Repeated rows are packed each on its own.  Which bin a piece gets depends on the place of its row in the
    input.  An empty table gives no rows.
    """
    longest = max(lengths)
    rows = docs.select(
        struct_of(carry or docs.columns).alias("row"), n_words("text").alias("size"),
        F.xxhash64(F.col("doc_id"), F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("uid"),
    )
    rows = Stage(rows, "sized-rows").df  # numbers are frozen here
    last = F.greatest(F.ceil(F.col("size") / longest).cast("int") - 1, F.lit(0))
    pieces = rows.select("row", "size", "digest", "uid", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "row", "piece", (F.col("piece") * F.lit(longest).cast("long")).alias("first_word"),
        F.least(F.col("size") - F.col("piece") * longest, F.lit(longest)).cast("long").alias("n_words"),
        F.xxhash64("digest", "piece").alias("tie"), "uid",
    )
    shards = max(1, -(-(rows.agg(F.sum(last + 1)).first()[0] or 0) // per_shard))
    kinds = with_row(pieces, "piece int, first_word long, n_words long, bin_id long, bin_length long, bin_offset long")
    filled = pieces.filter("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("uid", "piece"), F.lit(shards)))
    packed = filled.groupBy("shard").applyInArrow(_pack(lengths), kinds)
    blank = [F.lit(None).cast("long").alias(c) for c in _NAMES[4:]]
    return packed.unionByName(pieces.filter("n_words = 0").select("row", "piece", "first_word", "n_words", *blank))
