"""Token counts by a finite-state transducer compiled from a tokenizer's vocabulary.

A byte-pair tokenizer looks at the whole text, but its result for a growing prefix follows from little: the encoding of a
prefix ends in one certain token, and a token may follow another exactly if the pair encodes to itself.  So a state holds,
for each place where a piece of the vocabulary may still be under way, the token before that place and the count there,
relative to the count now.  Reading a character leads to one next state and emits a count (which may be negative, when
short tokens give way to a longer one).  States and transitions are compiled as texts need them and are shared by all texts
of a task; the vocabulary, its merge order and its last merges are compiled once and broadcast.

Texts are cut in chunks between characters that no piece joins.  Whatever state enters such a chunk, it behaves as the start
state, so the state map of a chunk is constant: it maps all states to one and adds a count.  Such maps compose by addition,
and a prefix scan (a cumulative sum) over the counts of all chunks of a run gives the counts of its texts.  Equal chunks
are run once per task.

Runs of spaces tie in the merge order, where the pairwise rule does not hold; chunks with two spaces in a row are merged
step by step instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scan

LIMIT = 4096
SPACE = "▁"


class Vocabulary(NamedTuple):
    """Pieces with their place in the merge order (single characters come before all merges), the two halves of each
    piece's last merge, and the byte pairs that some piece joins."""

    place: dict[str, int]
    halves: dict[str, tuple[str, str]]
    joined: np.ndarray


def merge(text: str, place: dict[str, int]) -> list[str]:
    """Byte-pair merging step by step: the best pair first, of equal ones the leftmost."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(place[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in place]
    heapq.heapify(heap)
    while heap:
        _, i, made = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or parts[i] + parts[j] != made:
            continue
        parts[i], parts[j] = made, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and parts[a] + parts[b] in place:
                heapq.heappush(heap, (place[parts[a] + parts[b]], a, parts[a] + parts[b]))
    return [p for p in parts if p is not None]


def read_vocabulary(model_file: str) -> Vocabulary:
    """The vocabulary of a sentencepiece byte-pair model with byte fallback and a leading space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    scores = {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }
    levels = {s: k for k, s in enumerate(sorted({s for p, s in scores.items() if len(p) > 1}, reverse=True), 1)}
    place = {p: levels[s] if len(p) > 1 else 0 for p, s in scores.items()}
    halves = {}
    for piece, at in place.items():
        if len(piece) == 1 or SPACE * 2 in piece:
            continue
        parts = merge(piece, {p: k for i in range(len(piece)) for j in range(i + 1, len(piece) + 1) if (p := piece[i:j]) != piece and (k := place.get(p)) is not None})
        if len(parts) == 2:
            halves[piece] = (parts[0], parts[1])
    joined = np.zeros((256, 256), bool)
    joined[:, 0x80:0xC0] = True
    for piece in place:
        raw = piece.replace(SPACE, " ").encode()
        for x, y in zip(raw, raw[1:]):
            joined[x, y] = True
    return Vocabulary(place, halves, joined)


class Transducer:
    """States are ``[transitions, active]``; a transition is ``(state, emitted count)``."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.place, self.halves, _ = vocabulary
        self.fits: dict[tuple[str, str], bool] = {}
        self.prefixes = {p[:k] for p in self.halves for k in range(1, len(p))}
        self.states: dict[tuple, list] = {}
        self.start = self._state((("", "", 0),))

    def _state(self, active: tuple) -> list:
        if active not in self.states:
            self.states[active] = [{}, active]
        return self.states[active]

    def _follows(self, a: str, b: str) -> bool:
        """Whether ``a + b`` encodes to ``a, b``: undoing merges from the last on, no earlier merge spans the seam."""
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self._seam_holds(a, b)
        return known

    def _seam_holds(self, a: str, b: str) -> bool:
        place, halves = self.place, self.halves
        left, right = place.get(a, 0), place.get(b, 0)
        bound = (1 << 60, 0)  # the seam's merge must not come before the merge undone last
        while True:
            across = place.get(a + b)
            if across is not None and (across, 0) < bound:
                return False
            if left == 0 and right == 0:
                return True
            if left > right:
                bound = (left, 0)  # a tie cannot be: places of merges differ
                a = halves[a][1]
                left = place[a]
            else:
                bound = (right, 1)  # merges left of this one go first
                b = halves[b][0]
                right = place[b]

    def step(self, state: list, c: str) -> tuple[list, int]:
        active, token, count, still = state[1], None, 0, []
        for prefix, last, ago in active:
            grown = prefix + c
            if grown in self.prefixes:
                still.append((grown, last, ago))
            if token is None and (grown in self.halves if prefix else c in self.place) and (not last or self._follows(last, grown)):
                token, count = grown, ago + 1
        if token is None:  # an unknown character: its bytes, joined to nothing
            token, count = c, len(c.encode())
            still = [x for x in still if x[0] == c]
        fresh = [(p, last, ago - count) for p, last, ago in still]
        made = (self._state((*fresh, ("", token, 0))), count)
        state[0][c] = made
        return made

    def count(self, text: str) -> int:
        if SPACE * 2 in text:
            return sum(1 if p in self.place else len(p.encode()) for p in merge(text, self.place))
        state, total = self.start, 0
        for c in text:
            state, emitted = state[0].get(c) or self.step(state, c)
            total += emitted
        return total


def chunks(run: scan.Run, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts, each behind its leading space, and the places where chunks start and end; the chunks of row i are
    ``rows[i]:rows[i + 1]``.  An empty text has none."""
    length = np.diff(run.bounds)
    filled = (length > 0).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(length + filled)])
    data = np.full(bounds[-1], 32, np.uint8)
    data[np.arange(len(run.data)) + np.repeat(np.cumsum(filled), length)] = run.data
    cut = np.ones(len(data), bool)
    cut[1:] = ~joined[data[:-1], data[1:]]
    cut[bounds[:-1][filled == 1]] = True
    start = np.flatnonzero(cut)
    return data, start, np.append(start[1:], len(data)), np.searchsorted(start, bounds)


def _plain(run: scan.Run) -> scan.Run:
    """The run with literal marks for a space replaced by spaces, as the tokenizer reads them."""
    mark = SPACE.encode()
    raw = run.data.tobytes()
    if mark not in raw:
        return run
    texts = [raw[a:b].replace(mark, b" ") for a, b in zip(run.bounds[:-1], run.bounds[1:])]
    return run._replace(data=np.frombuffer(b"".join(texts), np.uint8), bounds=np.concatenate([[0], np.cumsum([len(t) for t in texts])]))


def _counts(vocabulary, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*vocabulary.value)
        machine = Transducer(v)
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for r in scan.runs(batch.column("text")):
                data, start, end, rows = chunks(_plain(r), v.joined)
                value, first, back = np.unique(scan.span_hash(data, start, end), return_index=True, return_inverse=True)
                at = np.searchsorted(keys, value)
                fresh = np.ones(len(value), bool)
                if len(keys):
                    fresh = keys[np.minimum(at, len(keys) - 1)] != value
                if fresh.any():
                    raw, pick = data.tobytes(), first[fresh]
                    made = [machine.count(raw[a:b].replace(b" ", SPACE.encode()).decode()) for a, b in zip(start[pick].tolist(), end[pick].tolist())]
                    keys, counts = np.insert(keys, at[fresh], value[fresh]), np.insert(counts, at[fresh], made)
                    at = np.searchsorted(keys, value)
                upto = np.concatenate([[0], np.cumsum(counts[at][back])])  # the chunk maps, composed
                tokens = upto[rows[1:]] - upto[rows[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(r.first, r.last - r.first), pa.array(np.diff(r.bounds)), pa.array(tokens), pa.array(tokens > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, model_file: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs`` (needs ``doc_id, text``; other columns are ignored).

    Counts are those of the model's own library without added tokens; control strings inside texts are plain text.  A null
    or empty text has no bytes and no tokens.  A null doc_id stays null; repeated rows are counted each.  An empty table
    gives no rows.  ``model_file`` is read on the driver only.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(tuple(read_vocabulary(model_file)))  # bounded by the vocabulary
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_counts(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
