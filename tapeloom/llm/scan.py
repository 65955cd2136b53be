"""Whole texts as byte buffers: words, word hashes and shingles with numpy.

Every function works on a run of rows whose texts lie end to end in one buffer, as they do in an Arrow string column.
A batch is cut into runs of about a megabyte, so that memory depends on the run and on the longest single text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


#: Every byte that is neither a letter, a digit nor part of a longer character separates terms.
NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class _Powers:
    """Powers of the hash base and of its inverse, grown to the longest run seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, RUN_BYTES + 1)
            self.up = np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE, np.uint64)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([np.ones(1, np.uint64), np.full(size, _INVERSE, np.uint64)]).cumprod(dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS: list[_Powers] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        _POWERS.append(_Powers())
    return _POWERS[0].upto(n)


class Run(NamedTuple):
    """Texts of rows ``first`` to ``last`` of a batch: row i has bytes ``data[bounds[i]:bounds[i + 1]]``."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[Run]:
    """Cut a string or binary column into runs; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not (pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)):
        texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    texts = pc.fill_null(texts, b"")
    n = len(texts)
    if n == 0:
        return
    wide = pa.types.is_large_binary(texts.type)
    _, at, values = texts.buffers()
    bounds = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield Run(first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


class Words(NamedTuple):
    """Words of a run: byte places, hash, and ``rows[i]:rows[i + 1]`` as the words of row i."""

    start: np.ndarray
    end: np.ndarray
    value: np.ndarray
    rows: np.ndarray


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal strings wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(run: Run, lower: bool = True, between: np.ndarray = _SPACE) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``, or what lies between other bytes; A-Z count as a-z when ``lower``."""
    data = _LOWER[run.data] if lower else run.data
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~between[data]
    rise = np.diff(inside)
    begins, ends = rise[:-1] == 1, rise[1:] == -1
    cut = run.bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    begins[cut] = True
    ends[cut - 1] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, span_hash(data, start, end), np.searchsorted(start, run.bounds))


def grams(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size`` words in a row; a row with fewer words gives one of them all, without words none.

    Returns the values and the bounds of each row's values.
    """
    counts = np.diff(w.rows)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(counts)), made)
    at = w.rows[:-1][row] + np.arange(bounds[-1]) - bounds[:-1][row]
    held = np.minimum(counts, size)[row]
    value = held.astype(np.uint64)
    padded = np.concatenate([w.value, np.zeros(size, np.uint64)])
    for k in range(size):
        part = padded[at + k]
        if k:
            part = np.where(held > k, part, np.uint64(0))
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + part)
    return value, bounds


def sets(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their bounds."""
    value = value.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            value[a:b].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = value[1:] != value[:-1]
    starts = bounds[:-1]
    fresh[starts[starts < len(value)]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return value[fresh], kept[bounds]
