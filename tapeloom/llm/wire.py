"""Many small rows as one: columns of numbers dealt to buckets as compressed binaries.

A row ``bucket, n, data`` holds n values of each column, end to end.  Ids and places (signed 8 and unsigned 4 bytes) go as
differences, which compress well when they ascend.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

_STEPS = (np.dtype("<i8"), np.dtype("<u4"))


def packed(columns: list[np.ndarray]) -> bytes:
    raw = b"".join((np.diff(c, prepend=c.dtype.type(0)) if c.dtype in _STEPS else np.ascontiguousarray(c)).tobytes() for c in columns)
    return pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: pa.Scalar, n: int, kinds: list) -> list[np.ndarray]:
    wide = [np.dtype(k) for k in kinds]
    raw, out, at = pa.decompress(data.as_buffer(), n * sum(w.itemsize for w in wide), "zstd", asbytes=True), [], 0
    for w in wide:
        part = np.frombuffer(raw, w, n, at)
        out.append(np.cumsum(part, dtype=w) if w in _STEPS else part)
        at += n * w.itemsize
    return out


def dealt(bucket: np.ndarray, columns: list[np.ndarray], n_buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """``bucket, n, data`` of each bucket used, its values in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    columns = [c[order] for c in columns]
    used = np.flatnonzero(np.diff(cuts))
    return used.astype(np.int32), np.diff(cuts)[used].astype(np.int32), [packed([c[cuts[b] : cuts[b + 1]] for c in columns]) for b in used]


def gathered(batches: Iterable, kinds: list) -> list[np.ndarray]:
    """All values of the rows, column by column; an empty list without rows."""
    held = [unpacked(data, n, kinds) for b in batches for n, data in zip(b.column("n").to_pylist(), b.column("data"))]
    return [np.concatenate(c) for c in zip(*held)] if held else []
