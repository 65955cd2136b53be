"""Suffix-array dedup: bytes of any ``size``-byte string that also starts in a document with a smaller id.

The suffix array is sparse.  Of every ``size``-byte window the ``GRAM``-byte gram with the least hash is an anchor; equal
windows have equal anchors, so only suffixes at anchors need sorting, about one position in eighteen.

1. Documents -> anchors, dealt by gram hash.  Anchors found in one document only are done with.  An anchor that several
   documents of one run of texts share is known to be shared at once and only its smallest document is sent on, so a
   passage in a third of all documents costs a row per run.
2. Shared anchors meet their texts again (blocks of documents by id) and take the bytes around them, ``size - GRAM`` to
   the left and ``size`` from their start.  Equal surroundings within a block are sent once, for their smallest document.
3. Dealt by gram hash, the suffixes right of the anchors and the reversed texts left of them are put in order by
   deep-shallow sorting.  Common prefix lengths cut both orders into classes for each depth; a window is a pair of
   classes, and it is removed where a smaller document has the same pair.
4. Spans go back to their documents, merge, and the bytes outside of them are kept.

Nothing is collected; a document's spans are bounded by its own length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import scan
from .shared import BROADCAST_ROWS, Stage, blobs, nullable, parts_for, struct_of, take_ranges, with_row, xxhash64
from .suffix_sort import deep_shallow_sort
from .wire import dealt, gathered

GRAM = 16
SENT_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` values in a row."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: -(width - span)], values[width - span :]) if width > span else values


def anchors(run: scan.Run, size: int) -> tuple[np.ndarray, ...]:
    """Hash, row and byte position of the anchors of a run, and the bytes before it and from its start on that the windows
    it stands for reach.  A window's anchor is the leftmost of its least grams, so each window has one."""
    n, width = len(run.data), size - GRAM + 1
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    if n < size:
        return none
    starts = np.arange(n - GRAM + 1)
    gram = scan.span_hash(run.data, starts, starts + GRAM)
    least = _slide(gram, width, np.minimum)
    whole = np.zeros(len(least), bool)
    whole[take_ranges(run.bounds[:-1], np.maximum(np.diff(run.bounds) - size + 1, 0))] = True
    least[~whole] = 0
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum)[: len(gram)] == gram)
    row = np.searchsorted(run.bounds, at, "right") - 1
    own = gram[at]
    first = np.maximum(at - width + 1, run.bounds[row])  # the first and last window this anchor may stand for
    last = np.minimum(at, run.bounds[row + 1] - size)
    for d in range(width - 1, 0, -1):
        before, after = at - d, at + d
        first = np.where((before >= first) & (gram[np.maximum(before, 0)] <= own), before + 1, first)
        last = np.where((after < len(gram)) & (gram[np.minimum(after, len(gram) - 1)] < own), np.minimum(last, after - width), last)
    used = first <= last
    at, row, first, last = at[used], row[used], first[used], last[used]
    return own[used], row, at - run.bounds[row], at - first, last + size - at


def _block_of(ids: np.ndarray, n: int) -> np.ndarray:
    """What ``pmod(xxhash64(doc_id), n)`` is in Spark."""
    return (xxhash64(ids) % n).astype(np.int32)


_GRAM_ROW, _PLACE_ROW = 0, 1
_SENT = "kind int, bucket int, n int, data binary"


def _batch(kind: int, bucket, n, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(bucket), kind, np.int32)), pa.array(bucket), pa.array(n), pa.array(data, pa.binary())],
        ["kind", "bucket", "n", "data"],
    )


def _shared_in(gram: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (gram, id); the first place of each gram in it; whether two ids have the gram, per place."""
    order = np.lexsort((ids, gram))
    g, d = gram[order], ids[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = g[1:] != g[:-1]
    starts = np.flatnonzero(fresh)
    last = np.append(starts[1:], len(g)) - 1
    return order, starts, np.repeat(d[starts] != d[last], last - starts + 1)


def _find_anchors(size: int, n_buckets: int, n_blocks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_all = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for r in scan.runs(batch.column("text")):
                gram, row, pos, _, _ = anchors(r, size)
                if not len(gram):
                    continue
                ids = ids_all[r.first + row]
                order, starts, shared = _shared_in(gram, ids)
                here = np.sort(order[shared])
                if len(here):
                    yield _batch(_PLACE_ROW, *dealt(_block_of(ids[here], n_blocks), [ids[here], pos[here].astype(np.uint32)], n_blocks))
                alone = np.zeros(len(order), bool)
                alone[~shared] = True
                alone[starts] = True  # of a shared gram, the smallest document speaks for the run
                sent = np.sort(order[alone])
                bucket = (gram[sent] % np.uint64(n_buckets)).astype(np.int32)
                yield _batch(_GRAM_ROW, *dealt(bucket, [gram[sent], ids[sent], pos[sent].astype(np.uint32)], n_buckets))

    return run


def _split(batches: Iterator[pa.RecordBatch], passed: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram rows of each batch; the others, which are decided already, are put aside as they are."""
    for batch in batches:
        grams = pc.equal(batch.column("kind"), _GRAM_ROW)
        passed.append(batch.filter(pc.invert(grams)))
        yield batch.filter(grams)


def _find_shared(n_blocks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        got = gathered(_split(batches, passed), ["<u8", "<i8", "<u4"])
        yield from passed
        if not got:
            return
        gram, ids, pos = got
        order, _, shared = _shared_in(gram, ids)
        here = order[shared]
        if len(here):
            yield _batch(_PLACE_ROW, *dealt(_block_of(ids[here], n_blocks), [ids[here], pos[here]], n_blocks))

    return run


def _around(size: int, n_buckets: int) -> Callable:
    """Texts of a block and places in them -> the bytes around each place, and the spans decided here."""
    left, wide = size - GRAM, 2 * size - GRAM

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        docs, places = docs.combine_chunks(), places.combine_chunks()
        out: list[tuple] = []
        got = gathered(iter(places.to_batches()), ["<i8", "<u4"])
        if got and docs.num_rows:
            ids, pos = got
            order = np.lexsort((pos, ids))
            ids, pos = ids[order], pos[order].astype(np.int64)
            text = docs.column("text").combine_chunks()
            docs_ids = docs.column("doc_id").to_numpy()
            for r in scan.runs(text, 1 << 21):
                own = docs_ids[r.first : r.last]
                gram, row, p, before, after = anchors(r, size)
                a, b = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
                known = np.repeat(np.arange(len(own)), b - a) << 32 | pos[take_ranges(a, b - a)]
                here = row << 32 | p
                if not len(known) or not len(here):
                    continue
                shared = known[np.minimum(np.searchsorted(known, here), len(known) - 1)] == here
                gram, row, p, before, after = (x[shared] for x in (gram, row, p, before, after))
                if not len(p):
                    continue
                at = r.bounds[:-1][row] + p
                cells = np.empty((len(p), wide), np.uint8)
                for c in range(wide):
                    k = c - left
                    real = (before >= -k) if k < 0 else (after > k)
                    cells[:, c] = np.where(real, r.data[np.clip(at + k, 0, len(r.data) - 1)], 0)
                weights = scan.mix(np.arange(1, wide + 3, dtype=np.uint64))
                code = scan.mix((cells * weights[:wide]).sum(axis=1, dtype=np.uint64) + before.astype(np.uint64) * weights[wide] + after.astype(np.uint64) * weights[wide + 1])
                doc = own[row]
                order_ = np.lexsort((doc, code))
                fresh = np.ones(len(p), bool)
                fresh[1:] = code[order_][1:] != code[order_][:-1]
                lead = order_[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]  # the first of its code
                me = order_
                same = (cells[me] == cells[lead]).all(axis=1) & (before[me] == before[lead]) & (after[me] == after[lead])
                done = same & (doc[me] > doc[lead])
                gone = np.sort(me[done])
                if len(gone):
                    out.append((_PLACE_ROW, *dealt(_block_of(doc[gone], n_buckets), [doc[gone], (p - before)[gone].astype(np.uint32), (p + after)[gone].astype(np.uint32)], n_buckets)))
                keep = np.sort(me[~done])
                bucket = (gram[keep] % np.uint64(n_buckets)).astype(np.int32)
                out.append((_GRAM_ROW, *dealt(bucket, [doc[keep], p[keep].astype(np.uint32), before[keep].astype(np.uint8), after[keep].astype(np.uint8), cells[keep]], n_buckets)))
        if not out:
            return pa.Table.from_batches([_batch(0, np.zeros(0, np.int32), np.zeros(0, np.int32), [])])
        return pa.Table.from_batches([_batch(*o) for o in out])

    return run


def _find_repeats(size: int, n_buckets: int) -> Callable:
    left, wide = size - GRAM, 2 * size - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        got = gathered(_split(batches, passed), ["<i8", "<u4", "u1", "u1", np.dtype(("u1", (wide,)))])
        yield from passed
        if not got:
            return
        doc, pos, before, after, cells = got
        pos, before, after = (x.astype(np.int64) for x in (pos, before, after))
        n = len(doc)
        right_order, right_common = deep_shallow_sort(cells[:, left:])
        left_order, left_common = deep_shallow_sort(np.ascontiguousarray(cells[:, :left][:, ::-1]))
        furthest, nearest = np.full(n, -1), np.full(n, size)
        right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
        for a in range(left + 1):
            right_class[right_order] = np.cumsum(right_common < size - a)
            left_class[left_order] = np.cumsum(left_common < a) if a else 0
            able = np.flatnonzero((before >= a) & (after >= size - a))
            key = right_class[able] * (n + 1) + left_class[able]
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.ones(len(able), bool)
            fresh[1:] = ordered[1:] != ordered[:-1]
            starts = np.flatnonzero(fresh)
            if not len(starts):
                continue
            least = np.minimum.reduceat(doc[able][order], starts)
            hit = able[order[doc[able][order] > np.repeat(least, np.diff(np.append(starts, len(able))))]]
            furthest[hit] = a
            nearest[hit] = np.minimum(nearest[hit], a)
        hit = np.flatnonzero(furthest >= 0)
        if len(hit):
            yield _batch(_PLACE_ROW, *dealt(_block_of(doc[hit], n_buckets), [doc[hit], (pos - furthest)[hit].astype(np.uint32), (pos + size - nearest)[hit].astype(np.uint32)], n_buckets))

    return run


def _merge_spans() -> Callable:
    """Spans as sent, all of a document in one task -> one row per document, its spans merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches, ["<i8", "<u4", "<u4"])
        if not got:
            return
        doc, start, end = got
        order = np.lexsort((start, doc))
        doc, spans = doc[order], np.stack([start[order], end[order]], axis=1).astype(np.int64)
        ids, first = np.unique(doc, return_index=True)
        far = np.arange(len(ids)) << 33  # documents end to end, so that one pass merges them all
        far = np.repeat(far, np.diff(np.append(first, len(doc))))[:, None]
        spans = _union(spans + far)
        owner = spans[:, 0] >> 33
        spans = (spans - (owner << 33)[:, None]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), blobs(spans, np.searchsorted(owner, np.arange(len(ids) + 1)))], ["doc_id", "spans"]
        )

    return run


def _union(spans: np.ndarray) -> np.ndarray:
    """Merge spans that overlap or touch."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.ones(len(spans), bool)
    fresh[1:] = spans[1:, 0] > reach[:-1]
    starts = np.flatnonzero(fresh)
    return np.stack([spans[starts, 0], reach[np.append(starts[1:], len(spans)) - 1]], axis=1)


def _to_characters(spans: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Spans shrunk to whole UTF-8 characters."""
    inner = np.append((data & 0xC0) == 0x80, False)
    at = np.flatnonzero(~inner)
    spans = spans.copy()
    spans[:, 0] = at[np.searchsorted(at, spans[:, 0])]
    spans[:, 1] = at[np.searchsorted(at, spans[:, 1], "right") - 1]
    return spans


def _cut(whole_characters: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, kept = batch.column("spans"), []
            starts, ends, counts = [], [], []
            texts = pc.fill_null(batch.column("text").cast(pa.binary()), b"")
            for i in range(len(batch)):
                raw = texts[i].as_py()
                if not held[i].is_valid:
                    kept.append(raw)
                    counts.append(0)
                    continue
                spans = np.minimum(np.frombuffer(held[i].as_buffer(), np.int32).reshape(-1, 2), len(raw))
                if whole_characters:
                    spans = _to_characters(spans, np.frombuffer(raw, np.uint8))
                spans = spans[spans[:, 0] < spans[:, 1]]
                starts += spans[:, 0].tolist()
                ends += spans[:, 1].tolist()
                counts.append(len(spans))
                edges = [0, *spans.ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            pairs = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["start", "end"])
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [nullable(batch.column("row")), pa.ListArray.from_arrays(at, pairs), pa.array(kept, pa.binary())], ["row", "spans", "kept"]
            )

    return run


def repeated_spans(docs: DataFrame, size: int = 50) -> DataFrame:
    """``doc_id, spans`` of each document with such bytes: its merged spans, binary pairs of int32."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= size))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets, n_blocks = parts_for(spark, total, SENT_BYTES), parts_for(spark, total, BLOCK_BYTES)
    grams = docs.mapInArrow(_find_anchors(size, n_buckets, n_blocks), _SENT).repartitionById(n_buckets, F.expr(f"pmod(bucket, {n_buckets})"))
    places = grams.mapInArrow(_find_shared(n_blocks), _SENT)
    blocked = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int")).groupBy("block")
    around = blocked.cogroup(places.withColumn("block", F.col("bucket")).groupBy("block"))
    near = around.applyInArrow(_around(size, n_buckets), _SENT).repartitionById(n_buckets, F.expr(f"pmod(bucket, {n_buckets})"))
    spans = near.mapInArrow(_find_repeats(size, n_buckets), _SENT).repartitionById(n_buckets, F.col("bucket"))
    return Stage(spans.mapInArrow(_merge_spans(), "doc_id long, spans binary"), "spans").df


def suffix_dedup(docs: DataFrame, size: int = 50, carry: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
    """``row, spans, kept`` of every row: a struct of the ``carry`` columns (all columns unless given), the removed byte
    spans, and the bytes that stay, in order.

    A byte goes if a ``size``-byte string that covers it also starts in a document with a smaller ``doc_id``; the input
    decides, not what is left of it.  A null text counts as empty; texts shorter than ``size`` bytes stay whole.  Rows with
    the same doc_id do not remove from each other.  ``whole_characters`` keeps characters that a span would split.  A null doc_id is smaller than none and keeps its text.  Columns of the
    input sit inside ``row``, so their names cannot clash.  An empty table gives no rows.
    """
    if not GRAM < size < 256:
        raise ValueError(f"size must be above {GRAM} and below 256")
    spans = repeated_spans(docs, size)
    found = spans.agg(F.count("*"), F.sum(F.length("spans"))).first()
    small = found[0] <= BROADCAST_ROWS and (found[1] or 0) <= 32 << 20
    rows = docs.select(
        struct_of(carry or docs.columns).alias("row"), F.col("text").cast("string").alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
    )
    joined = rows.join(F.broadcast(spans) if small else spans, "doc_id", "left").select("row", "text", "spans")
    return joined.mapInArrow(_cut(whole_characters), with_row(rows, "spans array<struct<start:int,end:int>>, kept binary"))
