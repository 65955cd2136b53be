"""Deep-shallow sorting of strings: multikey quicksort to a shallow depth, blind tries below it.

Eight bytes are one character of the quicksort, compared as a big-endian number.  Groups that still tie after the
shallow depth share a long prefix; comparing their bytes again and again would be slow, so each is ordered by a blind
trie, which stores branching bits only and compares one pair of strings per insertion.
"""

from __future__ import annotations

import numpy as np

SHALLOW_BYTES = 16
_SMALL = 4096


def _shallow(chars: np.ndarray) -> np.ndarray:
    """Order of rows by their few 8-byte characters: ternary partitions around a median, small parts sorted directly."""
    depth_end, parts, todo = chars.shape[1], [], [(np.arange(len(chars)), 0)]
    while todo:
        index, depth = todo.pop()
        if depth == depth_end or len(index) <= 1:
            parts.append(index)
            continue
        if len(index) <= _SMALL:
            parts.append(index[np.lexsort(tuple(chars[index, k] for k in range(depth_end - 1, depth - 1, -1)))])
            continue
        c = chars[index, depth]
        pivot = np.partition(c[:: max(1, len(c) // 99)], min(len(c), 99) // 2)[min(len(c), 99) // 2]
        less, more = c < pivot, c > pivot
        todo += [(index[more], depth), (index[~(less | more)], depth + 1), (index[less], depth)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def blind_trie_order(keys: list[int]) -> list[int]:
    """Positions of distinct equal-width keys in ascending order."""
    root: list | int = 0
    for i in range(1, len(keys)):
        key, node = keys[i], root
        while type(node) is list:
            node = node[1 + (key >> node[0] & 1)]
        bit = (key ^ keys[node]).bit_length() - 1
        above, side, node = None, 0, root
        while type(node) is list and node[0] > bit:
            above, side = node, 1 + (key >> node[0] & 1)
            node = above[side]
        fresh = [bit, node, i] if key >> bit & 1 else [bit, i, node]
        if above is None:
            root = fresh
        else:
            above[side] = fresh
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if type(node) is list:
            todo += [node[2], node[1]]
        else:
            order.append(node)
    return order


def deep_shallow_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the byte rows of a matrix, and the common prefix length of each with the row before it in that order."""
    n, width = rows.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shallow = min(SHALLOW_BYTES, width // 8 * 8)
    chars = np.ascontiguousarray(rows[:, :shallow]).view(">u8").astype(np.uint64)
    order = _shallow(chars)
    if shallow < width:
        ordered = chars[order]
        fresh = np.ones(n, bool)
        fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], n)
        deep = ends - starts > 1
        rest = width - shallow
        for a, b in zip(starts[deep].tolist(), ends[deep].tolist()):
            group = order[a:b]
            raw = rows[group, shallow:].tobytes()
            held: dict[int, list[int]] = {}
            for i in range(b - a):
                held.setdefault(int.from_bytes(raw[i * rest : (i + 1) * rest], "big"), []).append(i)
            if len(held) == 1:
                continue
            same = list(held.values())
            order[a:b] = group[[i for k in blind_trie_order(list(held)) for i in same[k]]]
    common = np.zeros(n, np.int64)
    for a in range(0, n - 1, 1 << 16):
        b = min(a + (1 << 16), n - 1)
        apart = rows[order[a:b]] != rows[order[a + 1 : b + 1]]
        common[a + 1 : b + 1] = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    return order, common
