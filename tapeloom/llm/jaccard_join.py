"""N-gram Jaccard join with set-relation skipping.

Documents are sets of word shingles; two link when ``100 * |A n B| >= percent * |A u B|``.

* Index lists hold, for each shingle, the sets that have it among their first ``n - ceil(percent * n / 100) + 1``
  shingles, in one global order: shingles of long lists last, else by hash.  Two sets that link meet in a list.
* Shingles with the same list are one list, that of the first of them in the order: sets that meet in the others meet there
  as well, and at an earlier position.  Lists are the same if count, ends and two sums of 31-bit hashes of the ids are.
* Long lists are cut in blocks of similar set size.  Blocks more than one apart, and entries whose position leaves too few
  shingles behind it, are skipped without being read against each other.
* Answers are derived from the answers of a similar set.  Every longer list has a pivot, its smallest id; the sets of
  the list are first compared with the pivot alone.  A set that links with a pivot takes over its component, and from
  then on only sets outside of that component are compared with it.
* A parity map of each set (``64 * MAPS`` bits) bounds ``|A xor B|`` from below, so most pairs fall inside the join, without
  reading the sets; what remains is decided by the sets themselves.

Copies are one set.  A group of n near copies costs n comparisons per pivot, not n * n.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scan
from .components import components
from .shared import Stage, blobs, lists, maybe_broadcast, signed, take_ranges

#: Lists of so many sets get a pivot; lists of so many are cut in blocks.  Both only steer the order of the work.
PIVOT_FROM, BLOCKS_FROM = 8, 64

#: Size of the table of shingles that go last in the order.  It only steers speed: any order gives the same links.
LONG_LISTS = 1 << 16
LONG_FROM = 16

#: Longs of a parity map, and sets with their maps that are broadcast (about 8 MB).
MAPS, WITH_MAPS = 16, 50_000
_MAPS = [f"m{k}" for k in range(MAPS)]
_SIGNATURE = "doc_id long, n_shingles long, lo long, hi long, " + ", ".join(f"{m} long" for m in _MAPS) + ", prefix array<long>"
_POSTING = "token long, doc_id long, pos int"


def _sets_of(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for run in scan.runs(batch.column("text")):
        value, bounds = scan.sets(*scan.grams(scan.words(run), size))
        yield run.first, run.last, value, bounds


def _prefix(counts: np.ndarray, percent: int) -> np.ndarray:
    return np.where(counts > 0, counts - (percent * counts + 99) // 100 + 1, 0)


def _signatures(size: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, value, bounds in _sets_of(batch, size):
                counts = np.diff(bounds)
                row = np.repeat(np.arange(len(counts)), counts)
                total = np.zeros((2, len(value) + 1), np.uint64)
                np.cumsum(scan.mix(value), out=total[0, 1:])
                np.cumsum(scan.mix(value ^ np.uint64(0xA5A5A5A55A5A5A5A)), out=total[1, 1:])
                lo, hi = total[:, bounds[1:]] - total[:, bounds[:-1]]
                bits = 64 * MAPS
                parity = np.bincount(row * bits + (value % np.uint64(bits)).astype(np.int64), minlength=bits * len(counts))
                maps = np.packbits((parity & 1).astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64).reshape(-1, MAPS)
                ahead = _prefix(counts, percent)
                taken = value[take_ranges(bounds[:-1], ahead)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(counts.astype(np.int64)), signed(lo), signed(hi),
                     *[pa.array(maps[:, k].copy()) for k in range(MAPS)],
                     lists(taken.view(np.int64), np.concatenate([[0], np.cumsum(ahead)]), pa.int64())],
                    ["doc_id", "n_shingles", "lo", "hi", *_MAPS, "prefix"],
                )

    return run


def _postings(size: int, percent: int, long_lists) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = long_lists.value  # sorted tokens, and their places at the end of the order
        for batch in batches:
            for first, last, value, bounds in _sets_of(batch, size):
                counts = np.diff(bounds)
                row = np.repeat(np.arange(len(counts)), counts)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, value), len(tokens) - 1)
                    late = np.where(tokens[at] == value, ranks[at] + 1, 0)
                    if late.any():
                        value = value[np.argsort(row * (len(tokens) + 2) + late, kind="stable")]
                ahead = _prefix(counts, percent)
                index = take_ranges(bounds[:-1], ahead)
                own = np.repeat(np.arange(len(counts)), ahead)
                ids = batch.column("doc_id").slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [signed(value[index]), ids.take(pa.array(own)), pa.array((index - bounds[:-1][own]).astype(np.int32))],
                    ["token", "doc_id", "pos"],
                )

    return run


def _whole_sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, value, bounds in _sets_of(batch, size):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), blobs(value, bounds)], ["doc_id", "members"]
                )

    return run


def _linked(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("a_set"), batch.column("b_set")
            passes, seen, x = [], None, None
            for i in range(len(batch)):
                raw = left[i].as_buffer()
                if seen is None or not raw.equals(seen):
                    x, seen = np.frombuffer(raw, np.uint64), raw
                y = np.frombuffer(right[i].as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                passes.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(passes, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _verified(docs: DataFrame, pairs: Stage, size: int, percent: int) -> Stage:
    """The pairs whose sets pass.  Only texts of the pairs are read into sets; a doc_id with several rows has several."""
    ids = pairs.df.select(F.col("a").alias("doc_id")).union(pairs.df.select(F.col("b").alias("doc_id"))).distinct()
    needed = docs.join(maybe_broadcast(ids, ids.count()), "doc_id", "left_semi").select("doc_id", "text")
    whole = Stage(needed.mapInArrow(_whole_sets(size), "doc_id long, members binary").filter(F.length("members") > 0), "sets")
    both = (
        pairs.df.join(whole.df.select(F.col("doc_id").alias("b"), F.col("members").alias("b_set")), "b")
        .join(whole.df.select(F.col("doc_id").alias("a"), F.col("members").alias("a_set")), "a")
        .select("a", "b", "a_set", "b_set")
    )
    links = Stage(both.mapInArrow(_linked(percent), "a long, b long").distinct(), "verified")
    whole.drop()
    pairs.drop()
    return links


def _possible(x: str, y: str, percent: int):
    """Whether sizes and parity maps allow that the sets of aliases ``x`` and ``y`` link."""
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    apart = sum((F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in _MAPS), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def _long_lists(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens found in most prefixes of different sets, and their places, the longest list last."""
    top = (
        sets.select(F.explode("prefix").alias("token")).groupBy("token").count().filter(F.col("count") >= LONG_FROM)
        .orderBy(F.desc("count"), "token").limit(LONG_LISTS).collect()
    )
    tokens = np.array([r[0] for r in top], np.int64).view(np.uint64)
    ranks = len(top) - 1 - np.arange(len(top))
    order = np.argsort(tokens)
    return tokens[order], ranks[order]


def _shared_lists(posts: DataFrame, long_lists: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``token, first, entries`` of every list with different ids; of the same lists the one that comes first in the order."""
    late = posts.sparkSession.createDataFrame(
        pa.table([signed(long_lists[0]), pa.array(long_lists[1].astype(np.int64) + 1)], ["token", "late"])
    )
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "doc_id").bitwiseAND((1 << 31) - 1))
    whole = posts.groupBy("token").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("end"), F.count("*").alias("entries"), part(0).alias("f"), part(1).alias("g")
    )
    unsigned = F.col("token").bitwiseXOR(F.lit(-(1 << 63)))
    placed = whole.filter("first < end").join(F.broadcast(late), "token", "left").withColumn("place", F.struct(F.coalesce("late", F.lit(0)).alias("late"), unsigned.alias("token")))
    kept = placed.groupBy("first", "end", "entries", "f", "g").agg(F.min_by("token", "place").alias("token"))
    return kept.select("token", "first", "entries")


def ngram_jaccard_join(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (needs ``doc_id, text``; other columns are ignored).

    A row without words, or with a null text, has no shingles, links with nothing and is its own component.  A text
    with fewer than ``size`` words has its whole sequence as one shingle.  Rows that share a doc_id are one node, with
    the links of each of them.  A null doc_id takes no part and has a null component.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signature = Stage(docs.mapInArrow(_signatures(size, percent), _SIGNATURE), "signatures")
    sets_key = ["lo", "hi", "n_shingles"]
    found = signature.df.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = Stage(found.groupBy(*sets_key).agg(F.min("doc_id").alias("rep")), "classes")
    key = classes.df.withColumnRenamed("rep", "doc_id")
    one = found.join(key, [*sets_key, "doc_id"], "left_semi")
    sets = Stage(one.select("doc_id", "n_shingles", *_MAPS).distinct(), "sets")
    n_sets = sets.df.count()
    order = _long_lists(one)
    long_lists = spark.sparkContext.broadcast(order)
    slim = Stage(signature.df.select("doc_id", *sets_key), "sizes")
    signature.drop()
    copies = Stage(
        slim.df.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(classes.df, sets_key)
        .select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).filter("a <> b"), "copies",
    )
    classes.drop()
    stands = docs.join(maybe_broadcast(sets.df.select("doc_id").distinct(), n_sets), "doc_id", "left_semi")
    posts = stands.select("doc_id", "text").mapInArrow(_postings(size, percent, long_lists), _POSTING)
    listed = posts.join(_shared_lists(posts, order), "token")
    several = sets.df.groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("several"))
    if not several.isEmpty():  # texts of one doc_id lie in one another's lists, at positions of their own
        listed = listed.join(several, "doc_id", "left").withColumn("pos", F.when(F.col("several"), 0).otherwise(F.col("pos"))).drop("several")
    listed = Stage(listed.select("token", "doc_id", "pos", "first", "entries"), "lists")

    of = lambda name: maybe_broadcast(sets.df, n_sets, WITH_MAPS).alias(name)
    stars = (
        listed.df.filter((F.col("entries") >= PIVOT_FROM) & (F.col("first") < F.col("doc_id"))).select("first", "doc_id").distinct().alias("p")
        .join(of("x"), F.col("p.first") == F.col("x.doc_id")).join(of("y"), F.col("p.doc_id") == F.col("y.doc_id"))
        .filter(_possible("x", "y", percent)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    )
    links = _verified(docs, Stage(stars, "stars"), size, percent)
    known = Stage(components(links.df.unionAll(copies.df)), "known")

    placed = sets.df.select("doc_id", "n_shingles").distinct().join(known.df.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    placed = placed.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("c"))
    band = F.floor(F.log("n_shingles") / -math.log(percent / 100)) if percent < 100 else F.col("n_shingles")
    entries = listed.df.drop("first").join(maybe_broadcast(placed, n_sets), "doc_id")
    mixed = entries.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("token")
    entries = entries.withColumn("band", band.cast("int")).join(mixed, "token", "left_semi")
    entries = Stage(entries.join(maybe_broadcast(sets.df, n_sets, WITH_MAPS), ["doc_id", "n_shingles"]), "entries")
    listed.drop()
    cut = F.col("entries") >= BLOCKS_FROM
    x = entries.df.withColumn("block", F.when(cut, F.col("band")).otherwise(0)).alias("x")
    y = entries.df.withColumn("block", F.explode(F.when(cut, F.array(F.col("band"), F.col("band") - 1)).otherwise(F.array(F.lit(0))))).alias("y")
    ahead = F.least(F.col("x.n_shingles") - F.col("x.pos"), F.col("y.n_shingles") - F.col("y.pos"))
    rest = x.join(
        y,
        (F.col("x.token") == F.col("y.token")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.c") != F.col("y.c"))
        & F.when(F.col("x.band") == F.col("y.band"), F.col("x.doc_id") < F.col("y.doc_id")).otherwise(F.col("x.band") < F.col("y.band"))
        & (ahead * (100 + percent) >= (F.col("x.n_shingles") + F.col("y.n_shingles")) * percent) & _possible("x", "y", percent),
    ).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    more = _verified(docs, Stage(rest, "rest"), size, percent)
    entries.drop()
    known.drop()
    sets.drop()
    last = components(links.df.unionAll(more.df).unionAll(copies.df))
    out = slim.df.select("doc_id", "n_shingles").join(last.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
