"""Language-model scoring with a hierarchical Pitman-Yor model.

Every context has a restaurant whose customers are the training tokens that follow it; all restaurants share one parent, a
restaurant over words whose customers are their tables, above a uniform base over the known words and one unknown.  The
context of a token is the word before it, or the start of a text: every training word is a context, rare ones lean on the
parent, and a word that no training row has is an empty restaurant, which is the parent.  With ``contexts`` given only so
many most frequent words are contexts and all others share one.

Seating is sampled by Gibbs sweeps: for each dish of each restaurant the number of its tables is drawn anew, all customers
of the dish getting up and sitting down together.  Given the other dishes, t tables of c customers weigh
``S(c, t) * parent ** t * (strength + discount * other tables) (... + discount) ... (t factors)``, S being the generalised
Stirling numbers (the ways to seat them): their logs are a table up to ``EXACT`` customers, and above it a sum that is
exact where it does not cancel, else a saddle point.  Then the parent's dishes are drawn alike.  All dishes of a sweep are
drawn against the table counts and parent before it.  Given those totals words are independent, so state is dealt by word
hash.  Before a sweep every bucket of words sends its tables per context to the bucket of the context, which sums them and
answers in the same order; a context is one row of numbers per bucket of words, however many tokens follow it.  The state
itself stays where it is, in a table bucketed by word bucket.  Only eight totals reach the driver.  The
predictive probabilities of the states after ``BURN`` sweeps are averaged.  Discounts come from the counts of counts,
``n1 / (n1 + 2 n2)``.

Scoring: a block of documents asks for its distinct (context, word) pairs and words, the word's bucket answers in the same
order, and the block adds up its texts.  A block is all of training rows or all held out: every pair of the former has been
counted, so only the latter get what an uncounted pair needs.  Blocks go in up to ``WAVES`` waves, whose scores are written.  Counting, asking and answering send distinct pairs per task or block, never tokens,
so a word or word pair with a third of all tokens is one row per block.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.session import stage_path

from . import scan
from .shared import Stage, parts_for
from .wire import dealt, gathered, packed, unpacked

SWEEPS, BURN, STRENGTH = 6, 2, 1.0
SENT_BYTES, BLOCK_BYTES, HELD_KEYS = 12 << 20, 8 << 20, 1 << 18
#: Distinct pairs a counting task holds before it sends them.
SENT_KEYS = 1 << 20
#: Most waves of blocks, and bytes of texts from which one more is made: questions and answers of a wave go before the next.
WAVES, WAVE_BYTES = 4, 64 << 20
#: Customers of a dish up to which Stirling numbers come from a table, table counts weighed at first, and cells at a time.
EXACT, NARROW, CELLS = 1024, 64, 1 << 19
END, START, OTHER = np.uint64(0x5E4D0F7E47), np.uint64(0x57A127), np.uint64(0x07BE2)
_SENT = "bucket int, n int, data binary"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tokens(NamedTuple):
    """Tokens of a run: word hash, context hash, hash of both, and ``rows[i]:rows[i + 1]`` as the tokens of row i."""

    word: np.ndarray
    context: np.ndarray
    pair: np.ndarray
    rows: np.ndarray


def pair_hash(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return scan.mix(word + scan.mix(context) * np.uint64(0x9E3779B97F4A7C15))


def sequence(run: scan.Run) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words and one end per row, and the bounds of the rows."""
    w = scan.words(run)
    n_rows = len(w.rows) - 1
    rows = w.rows + np.arange(n_rows + 1)
    word = np.full(rows[-1], END, np.uint64)
    word[np.arange(len(w.value)) + np.repeat(np.arange(n_rows), np.diff(w.rows))] = w.value
    return word, rows


def tokens(run: scan.Run, frequent: np.ndarray | None) -> Tokens:
    """Lower-case words and one end per row; with ``frequent`` (sorted hashes) other words are one context."""
    word, rows = sequence(run)
    context = np.empty_like(word)
    context[1:] = word[:-1] if frequent is None else np.where(np.isin(word[:-1], frequent), word[:-1], OTHER)
    context[rows[:-1]] = START
    return Tokens(word, context, pair_hash(word, context), rows)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys, the order of all, and where in it each begins."""
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(fresh)
    return key[starts], order, starts


def _sums(count: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(count[order], starts) if len(starts) else count[:0]


def _summed(key: np.ndarray, count: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Distinct sorted keys, the sum of their counts, and each other column, which equal keys have alike."""
    key, order, starts = _distinct(key)
    return [key, _sums(count, order, starts), *[m[order[starts]] for m in more]]


def _bucket(word: np.ndarray, n: int) -> np.ndarray:
    return (scan.mix(word) % np.uint64(n)).astype(np.int32)


def _rows(bucket, n, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n), pa.array(data, pa.binary())], ["bucket", "n", "data"])


class _Held:
    """Counts of a task, summed up whenever many have come together."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, part: list[np.ndarray]) -> None:
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > HELD_KEYS and len(self.parts) > 1:
            whole = self.sum()
            self.parts, self.size = ([whole], 0) if len(whole[0]) < HELD_KEYS else ([whole], -len(whole[0]))

    def keys(self) -> int:
        return sum(len(part[0]) for part in self.parts)

    def sum(self) -> list[np.ndarray]:
        """The sums, column by column: the parts of one go as soon as they are joined."""
        columns, self.parts, self.size = list(zip(*self.parts)), [], 0
        if not columns:
            return []
        key, order, starts = _distinct(np.concatenate(columns.pop(0)))
        sums, order = _sums(np.concatenate(columns.pop(0)), order, starts), order[starts]
        return [key, sums, *[np.concatenate(columns.pop(0))[order] for _ in range(len(columns))]]


def _count_words(n_buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for r in scan.runs(batch.column("text")):
                word = tokens(r, None).word
                held.add(_summed(word, np.ones(len(word), np.int64)))
        if held.parts:
            word, count = held.sum()
            yield _rows(*dealt(_bucket(word, n_buckets), [word, count], n_buckets))

    return run


def _frequent_words(most: int) -> Callable:
    """Per bucket: its most frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches, ["<u8", "<i8"])
        if not got:
            return
        word, count = _summed(*got)
        top = np.lexsort((word, -count))[:most]
        top = top[word[top] != END]
        yield pa.RecordBatch.from_arrays([pa.array(word[top].view(np.int64)), pa.array(count[top])], ["word", "tokens"])

    return run


def _count_pairs(n_buckets: int, frequent) -> Callable:
    """Pairs of the texts, those of equal words in a row; a task sends what it holds whenever that is many."""

    def sent(held: _Held) -> pa.RecordBatch:
        count, word, context = held.sum()[1:]
        order = np.argsort(word)  # equal words in a row compress well
        columns = [c[order] for c in (word, context, count)]
        del order, word, context, count
        return _rows(*dealt(_bucket(columns[0], n_buckets), columns, n_buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for r in scan.runs(batch.column("text")):
                t = tokens(r, frequent.value)
                held.add(_summed(t.pair, np.ones(len(t.pair), np.int64), t.word, t.context))
                if held.keys() >= SENT_KEYS:
                    yield sent(held)
        if held.parts:
            yield sent(held)

    return run


class Totals(NamedTuple):
    """Customers and tables of the parent, discounts, and the numbers of known words and of training tokens."""

    parent_customers: float
    parent_tables: float
    discount: float
    parent_discount: float
    words: int
    tokens: int = 0

    def base(self) -> float:
        return 1 / (self.words + 1)

    def back_off(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (STRENGTH + self.discount * tables) / (STRENGTH + customers)

    def unknown(self) -> float:
        return (STRENGTH + self.parent_discount * self.parent_tables) * self.base() / (STRENGTH + self.parent_customers)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        rest = (STRENGTH + self.parent_discount * self.parent_tables) * self.base()
        return (customers - self.parent_discount * tables + rest) / (STRENGTH + self.parent_customers)


class State(NamedTuple):
    """Seating of a bucket.  Pairs are sorted by word and context, ``of`` and ``by`` are their places in ``names`` and
    ``contexts``; ``contexts`` is sorted by its bucket.  ``chance`` is a sum over samples."""

    of: np.ndarray
    by: np.ndarray
    count: np.ndarray
    tables: np.ndarray
    chance: np.ndarray
    names: np.ndarray
    own_tables: np.ndarray
    samples: np.ndarray  # a row per sample of the parent's probabilities
    contexts: np.ndarray
    held: np.ndarray  # the contexts of this bucket
    back_off: np.ndarray  # a row per sample of their weights of the parent

    def parent_customers(self) -> np.ndarray:
        return np.bincount(self.of, self.tables, len(self.names))


_PAIRS, _WORDS = ["<u4", "<u4", "<i8", "<i8", "<f4"], ["<u8", "<i8"]
#: Rows of a bucket of words or contexts: what they are, who sent them, the lengths and the columns.
_ROW = "bucket int, kind int, sender int, shape array<int>, data array<binary>, totals array<double>"
_STATE, _TABLES, _PLACES, _HELD, _OWN, _ASKED = range(6)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.float64())]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["bucket", "kind", "sender", "shape", "data", "totals"])


class _Box(NamedTuple):
    sender: int
    shape: list[int]
    data: pa.Array


def _boxes(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[int, list[_Box]]]:
    """Rows of a task by bucket and kind, their binaries still compressed."""
    out: dict[int, dict[int, list[_Box]]] = {}
    for b in batches:
        data = b.column("data")
        for i, (bucket, kind, sender, shape) in enumerate(zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "sender", "shape")))):
            out.setdefault(bucket, {}).setdefault(kind, []).append(_Box(sender, shape, data[i].values))
    for kinds in out.values():
        for rows in kinds.values():
            rows.sort(key=lambda r: r.sender)
    return out


def _stored(bucket: int, s: State) -> pa.RecordBatch:
    c0 = s.parent_customers()
    totals = [c0.sum(), s.own_tables.sum(), (s.count == 1).sum(), (s.count == 2).sum(), (c0 == 1).sum(), (c0 == 2).sum(), len(s.names), s.count.sum()]
    samples, back_off = (np.asarray(x, np.float32) for x in (s.samples, s.back_off))  # answers are not finer
    data = [packed([s.of, s.by, s.count, s.tables, s.chance]), packed([s.names, s.own_tables, *samples]), packed([s.contexts]), packed([s.held, *back_off])]
    shape = [len(s.of), len(s.names), len(s.contexts), len(s.held), len(s.samples)]
    return _batch([(bucket, _STATE, bucket, shape, data, [float(x) for x in totals])])


def _loaded(rows: list[_Box]) -> State:
    if not rows:  # a bucket of contexts without words
        none, no = np.zeros((0, 0)), lambda kind: np.zeros(0, kind)
        return State(no(np.uint32), no(np.uint32), no(np.int64), no(np.int64), no(np.float32), no(np.uint64), no(np.int64), none, no(np.uint64), no(np.uint64), none)
    (n, m, u, v, k), data = rows[0].shape, rows[0].data
    names, own, *samples = unpacked(data[1], m, _WORDS + ["<f4"] * k)
    held, *back_off = unpacked(data[3], v, ["<u8"] + ["<f4"] * k)
    table = lambda x, size: np.array(x, np.float64).reshape(k, size)
    return State(*unpacked(data[0], n, _PAIRS), names, own, table(samples, m), *unpacked(data[2], u, ["<u8"]), held, table(back_off, v))


def _first_state(n_buckets: int) -> Callable:
    """Every dish at one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, _Held] = {}
        for b in batches:
            for bucket, n, data in zip(b.column("bucket").to_pylist(), b.column("n").to_pylist(), b.column("data")):
                word, context, count = unpacked(data, n, ["<u8", "<u8", "<i8"])
                kept.setdefault(bucket, _Held()).add([pair_hash(word, context), count, word, context])
        for bucket, held in kept.items():
            _, count, word, context = held.sum()
            names, of = np.unique(word, return_inverse=True)
            contexts, by = np.unique(context, return_inverse=True)
            order = np.argsort(of * len(contexts) + by)
            of, by = of[order], by[order]
            dealt_by = np.argsort(_bucket(contexts, n_buckets), kind="stable")
            place = np.empty(len(contexts), np.uint32)
            place[dealt_by] = np.arange(len(contexts), dtype=np.uint32)
            ones = np.ones(len(of), np.int64)
            yield _stored(bucket, _loaded([])._replace(
                of=of.astype(np.uint32), by=place[by], count=count[order], tables=ones, chance=np.zeros(len(of), np.float32), names=names,
                own_tables=np.ones(len(names), np.int64), samples=np.zeros((0, len(names))), contexts=contexts[dealt_by],
            ))

    return run


def _sent_tables(n_buckets: int, first: bool) -> Callable:
    """Per bucket of contexts: the tables of its contexts in this bucket of words; ``first``: contexts and customers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, kinds in _boxes(batches).items():
            s = _loaded(kinds[_STATE])
            sums = np.bincount(s.by, s.count if first else s.tables, len(s.contexts)).astype(np.int64)
            columns = [s.contexts, sums] if first else [sums]
            yield _batch([(b, _TABLES, bucket, [n], [d], None) for b, n, d in zip(*(x if isinstance(x, list) else x.tolist() for x in dealt(_bucket(s.contexts, n_buckets), columns, n_buckets)))])

    return run


def _first_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of a bucket and their customers, and the places in them of what each bucket of words has."""
    for bucket, kinds in _boxes(batches).items():
        sent = [unpacked(r.data[0], r.shape[0], ["<u8", "<i8"]) for r in kinds[_TABLES]]
        contexts, at = np.unique(np.concatenate([c for c, _ in sent]), return_inverse=True)
        customers = np.bincount(at, np.concatenate([n for _, n in sent])).astype(np.int64)
        places = np.split(at.astype(np.uint32), np.cumsum([len(c) for c, _ in sent])[:-1])
        rows = [(bucket, _PLACES, r.sender, r.shape, [packed([p])], None) for r, p in zip(kinds[_TABLES], places)]
        yield _batch([*rows, (bucket, _HELD, bucket, [len(contexts)], [packed([contexts, customers])], None)])


def _summed_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Customers and tables of the contexts, to every bucket of words in its order, and to their own bucket."""
    for bucket, kinds in _boxes(batches).items():
        contexts, customers = unpacked(kinds[_HELD][0].data[0], kinds[_HELD][0].shape[0], ["<u8", "<i8"])
        places = [unpacked(r.data[0], r.shape[0], ["<u4"])[0] for r in kinds[_PLACES]]
        tables = np.zeros(len(contexts), np.int64)
        for at, r in zip(places, kinds[_TABLES]):
            tables[at] += unpacked(r.data[0], r.shape[0], ["<i8"])[0]  # a sender has a context once
        rows = [(r.sender, _TABLES, bucket, r.shape, [packed([customers[at].astype("<f8"), tables[at].astype("<f8")])], None) for at, r in zip(places, kinds[_PLACES])]
        yield _batch([*rows, (bucket, _OWN, bucket, [len(contexts)], [packed([contexts, customers, tables])], None)])


def log_stirling(n: int, discount: float) -> np.ndarray:
    """``out[c, t]``: log of the generalised Stirling number of c customers at t tables, for both up to ``n``."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, n):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - discount * t)
        out[c + 1, 2 : c + 2] = np.logaddexp(out[c + 1, 2 : c + 2], out[c, 1 : c + 1])
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for positive numbers, Stirling's series from 10 on."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift = np.where(low, shift - np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series


def log_stirling_large(c: int, t: np.ndarray, discount: float) -> np.ndarray:
    """The same for one large number of customers and a row of table counts.

    ``S(c, t) = 1 / (d^t t!) * sum over j of (-1)^j C(t, j) Gamma(c - j d) / Gamma(-j d)`` while that sum loses fewer than
    about 12 powers of e; beyond, S is c! / (d^t t!) times the coefficient of x^c in ``(1 - (1 - x)^d)^t``, by its saddle point.
    """
    d, t = discount, np.asarray(t, np.float64)
    out = np.empty(len(t))
    lost = (1 - d) * (t * float(c) ** -d) ** (1 / (1 - d))
    plain = lost <= 12
    factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(t.max()) + 1)))])
    whole = factorial[t.astype(np.int64)] + t * math.log(d)
    if plain.any():
        u = t[plain]
        j = np.arange(1, int(min(u.max(), 60 + 6 * lost[plain].max() / (1 - d))) + 1, dtype=np.float64)[:, None]
        of, k = u.astype(np.int64), j.astype(np.int64)
        size = factorial[of] - factorial[np.maximum(of - k, 0)] + (_log_gamma(1 + j * d) + _log_gamma(c - j * d) - factorial[k])
        size = np.where(j <= u, size, -np.inf)
        top = size.max(axis=0)
        sign = np.where(j % 2 == 1, 1.0, -1.0) * np.sin(math.pi * d * j) / math.pi
        total = (sign * np.exp(size - top)).sum(axis=0)
        out[plain] = np.log(np.maximum(total, 1e-300)) + top - whole[plain]
    if not plain.all():
        u = t[~plain]
        low, high = np.full(len(u), 1e-300), np.ones(len(u))  # y = 1 - x; x f'(x) / f(x) falls in y from beyond c / t to 1
        for _ in range(200):
            y = np.sqrt(low * high)
            slope = u * d * (1 - y) * y ** (d - 1) / (1 - y**d)
            low, high = np.where(slope > c, y, low), np.where(slope > c, high, y)
        y = np.sqrt(low * high)
        x, f = 1 - y, 1 - y**d
        f1, f2 = d * y ** (d - 1), d * (1 - d) * y ** (d - 2)
        spread = u * (x * f1 / f + x * x * f2 / f - (x * f1 / f) ** 2)
        coefficient = u * np.log(f) - c * np.log1p(-y) - 0.5 * np.log(2 * math.pi * np.maximum(spread, 1e-300))
        out[~plain] = coefficient + float(_log_gamma(np.float64(c + 1))) - whole[~plain]
    return out


_STIRLING: dict[float, np.ndarray] = {}


def _stirling(discount: float) -> np.ndarray:
    if discount not in _STIRLING:
        if len(_STIRLING) > 3:
            _STIRLING.clear()
        _STIRLING[discount] = log_stirling(EXACT, discount)
    return _STIRLING[discount]


def _drawn(log_weight: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One plus the place drawn in each row."""
    weight = np.exp(log_weight - log_weight.max(axis=1, keepdims=True)).cumsum(axis=1)
    return 1 + (weight < (u * weight[:, -1])[:, None]).sum(axis=1)


def _large(c: int, strength: np.ndarray, chance: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """The same for dishes of one number of customers above ``EXACT``: all table counts up to where the weights are negligible."""
    out, left, most = np.ones(len(u), np.int64), np.arange(len(u)), NARROW
    while len(left):
        t = np.arange(1, min(most, c) + 1)
        ways, again = log_stirling_large(c, t, discount), []
        for i in left.tolist():
            log = ways + t * math.log(chance[i]) + np.cumsum(np.log(strength[i] + discount * (t - 1.0)))
            if len(t) == c or log[-1] < log.max() - 45:
                out[i] = _drawn(log[None, :], u[i : i + 1])[0]
            else:
                again.append(i)
        left, most = np.array(again, np.int64), most * 4
    return out


def reseat(customers: np.ndarray, strength: np.ndarray, discount: float, chance: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Tables of each dish drawn anew; ``strength`` counts the tables of the other dishes, ``chance`` is the parent's."""
    out, u = np.ones(len(customers), np.int64), draw.random(len(customers))
    order = np.argsort(customers, kind="stable")
    sizes, starts = np.unique(customers[order], return_index=True)
    for c, start, end in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
        if c <= 1:
            continue
        rows = order[start:end]
        if c > EXACT:
            out[rows] = _large(c, strength[rows], chance[rows], discount, u[rows])
            continue
        ways = _stirling(discount)[c]
        for width in (min(c, NARROW), c):  # all table counts, or up to where the weights are negligible
            t, again = np.arange(1, width + 1), []
            for part in np.array_split(rows, -(-len(rows) * width // CELLS)):
                log = np.cumsum(np.log(strength[part, None] + discount * (t - 1)), axis=1) + np.log(chance[part])[:, None] * t + ways[1 : width + 1]
                out[part] = _drawn(log, u[part])
                if width < c:
                    again.append(part[log[:, -1] > log.max(axis=1) - 45])
            rows = np.concatenate(again) if again else rows[:0]
            if not len(rows):
                break
    return out


def _sweep(totals, number: int, record: bool, last: bool) -> Callable:
    """The state is recorded, and unless it is the ``last`` seated anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Totals(*totals.value)  # sent as plain numbers: an executor need not know the class
        for bucket, kinds in _boxes(batches).items():
            s = _loaded(kinds.get(_STATE, []))
            sums = [unpacked(r.data[0], r.shape[0], ["<f8", "<f8"]) for r in kinds.get(_TABLES, [])]  # by bucket, as contexts
            seats, laid = (np.concatenate(c)[s.by] for c in zip(*sums)) if sums else (np.zeros(0), np.zeros(0))
            parent = t.parent(s.parent_customers(), s.own_tables)
            if record:
                own = (s.count - t.discount * s.tables) / (STRENGTH + seats)
                chance = s.chance + own + t.back_off(seats, laid) * parent[s.of]
                held, c, tables = s.held, np.zeros(0), np.zeros(0)  # a bucket without contexts
                if kinds.get(_OWN):
                    held, c, tables = unpacked(kinds[_OWN][0].data[0], kinds[_OWN][0].shape[0], ["<u8", "<i8", "<i8"])
                before = s.back_off if len(s.samples) else np.zeros((0, len(held)))
                s = s._replace(
                    chance=chance.astype(np.float32), samples=np.vstack([s.samples, parent]),
                    held=held, back_off=np.vstack([before, t.back_off(c, tables)]),
                )
            if not last:
                draw = np.random.default_rng([17, number, bucket])
                others = STRENGTH + t.discount * (laid - s.tables)
                s = s._replace(tables=reseat(s.count, others, t.discount, parent[s.of], draw))
                others = STRENGTH + t.parent_discount * (t.parent_tables - s.own_tables)
                c0 = s.parent_customers().astype(np.int64)
                s = s._replace(own_tables=reseat(c0, others, t.parent_discount, np.full(len(c0), t.base()), draw))
            yield _stored(bucket, s)

    return run


def _sum_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch.column("totals"):
            value = row.values.to_numpy(zero_copy_only=False)
            total = value if total is None else total + value
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["totals"])


def _totals(state: DataFrame, before: Totals | None) -> Totals:
    by_task = state.select("totals").mapInArrow(_sum_vectors, "totals array<double>")  # a row per task
    whole = by_task.repartition(1).mapInArrow(_sum_vectors, "totals array<double>").first()
    x = np.array(whole.totals if whole else np.zeros(8))
    share = lambda one, two: float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95))
    d, d0 = (share(x[2], x[3]), share(x[4], x[5])) if before is None else (before.discount, before.parent_discount)
    return Totals(x[0], x[1], d, d0, int(x[6]), int(x[7]))


class _Block(NamedTuple):
    """Tokens of a block: its words and contexts in the order of buckets, and for each token
    ``place of the word * len(names) + place of the context``."""

    names: np.ndarray
    code: np.ndarray
    rows: np.ndarray  # ``rows[i]:rows[i + 1]`` are the tokens of row i


def _block(texts: pa.ChunkedArray, n_buckets: int, frequent: np.ndarray | None) -> _Block:
    words, sizes = zip(*[(word, np.diff(rows)) for word, rows in map(sequence, scan.runs(texts))])
    rows = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    more = np.array([START] if frequent is None else [START, OTHER], np.uint64)
    names, at = np.unique(np.concatenate([more, *words]), return_inverse=True)
    del words
    order = np.argsort(_bucket(names, n_buckets), kind="stable")
    names, place = names[order], np.empty(len(names), np.uint32)
    place[order] = np.arange(len(names), dtype=np.uint32)
    at = place[at]
    more, word = at[: len(more)], at[len(more) :]
    by = np.empty(len(word), np.int64)
    by[1:] = word[:-1] if frequent is None else np.where(np.isin(names, frequent), np.arange(len(names)), more[-1])[word[:-1]]
    by[rows[:-1]] = more[0]
    by += word.astype(np.int64) * len(names)
    return _Block(names, by, rows)


def _ask(n_buckets: int, frequent) -> Callable:
    def run(block: pa.Table) -> pa.Table:
        names, code, _ = _block(block.column("text"), n_buckets, frequent.value)
        number, held_out = (block.column(c)[0].as_py() for c in ("block", "held_out"))
        code.sort()
        of, by = np.divmod(code[np.append(True, code[1:] != code[:-1])], len(names))
        cuts = [np.searchsorted(_bucket(names, n_buckets), np.arange(n_buckets + 1))]
        cuts.append(np.searchsorted(of, cuts[0]))
        rows = []
        for b in range(n_buckets):
            words, pairs = (slice(c[b], c[b + 1]) for c in cuts)
            if words.start < words.stop:
                at = (of[pairs] - words.start).astype(np.uint32)
                shape = [words.stop - words.start, pairs.stop - pairs.start, held_out]
                rows.append((b, _ASKED, number, [int(x) for x in shape], [packed([names[words]]), packed([at, names[by[pairs]]])], None))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys, and which of them are there."""
    if len(sorted_keys) == 0:
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _answer(history) -> Callable:
    """For words and contexts training counts and, to a held-out block, per sample the parent's probability and its weight;
    for pairs of the training rows their probability, else 0: in the order asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = [Totals(*t) for t in history.value]
        unknown = np.array([t.unknown() for t in past])
        for bucket, kinds in _boxes(batches).items():
            if not kinds.get(_ASKED):
                continue
            s = _loaded(kinds.get(_STATE, []))
            if not kinds.get(_STATE):  # no word or context of it is known
                s = s._replace(samples=np.zeros((len(past), 0)), back_off=np.zeros((len(past), 0)))
            keys = pair_hash(s.names[s.of], s.contexts[s.by])
            order = np.argsort(keys)
            keys, chance = keys[order], s.chance[order] / len(past)
            counts = np.bincount(s.of, s.count, len(s.names)).astype(np.int64)
            for r in kinds[_ASKED]:
                names = unpacked(r.data[0], r.shape[0], ["<u8"])[0]
                word, context = unpacked(r.data[1], r.shape[1], ["<u4", "<u8"])
                count, of_names = np.zeros(len(names), np.int64), []
                at, known = _found(s.names, names)
                count[known] = counts[at[known]]
                if r.shape[2]:
                    parent, weight = np.repeat(unknown[:, None], len(names), axis=1), np.ones((len(past), len(names)))
                    parent[:, known] = s.samples[:, at[known]]
                    at, known = _found(s.held, names)
                    weight[:, known] = s.back_off[:, at[known]]
                    of_names = [*parent.astype(np.float32), *weight.astype(np.float32)]
                at, seen = _found(keys, pair_hash(names[word], context))
                own = np.zeros(len(word), np.float32)
                own[seen] = chance[at[seen]]
                yield _batch([(r.sender, _ASKED, bucket, r.shape, [packed([count, *of_names]), packed([own])], None)])

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(n_buckets: int, frequent, samples: int, n_tokens: int, n_words: int) -> Callable:
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        names, code, bounds = _block(block.column("text"), n_buckets, frequent.value)
        pairs, order, starts = _distinct(code)
        fresh = np.zeros(len(code), np.uint32)
        fresh[starts[1:]] = 1
        at = np.empty(len(code), np.uint32)
        at[order] = np.cumsum(fresh, dtype=np.uint32)  # places of the tokens in the pairs
        del code, order, fresh
        of, by = np.divmod(pairs, len(names))
        answers = answers.rename_columns(["bucket" if c == "block" else c for c in answers.column_names])
        rows = next(iter(_boxes(answers.to_batches()).values()))[_ASKED]  # by bucket, as asked
        of_names = [unpacked(r.data[0], r.shape[0], ["<i8"] + ["<f4"] * 2 * samples * r.shape[2]) for r in rows]
        count, *by_sample = (np.concatenate(c) for c in zip(*of_names))
        own = np.concatenate([unpacked(r.data[1], r.shape[1], ["<f4"])[0] for r in rows]).astype(np.float64)
        new = np.flatnonzero(own == 0)
        if len(new):
            backed = sum(by_sample[k][of[new]].astype(np.float64) * by_sample[samples + k][by[new]] for k in range(samples))
            own[new] = backed / samples
        base = np.log10((count + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
        n = np.diff(bounds)
        known, base_score, score = (np.add.reduceat(x[at], bounds[:-1]) for x in ((count > 0).astype(np.int64)[of], base[of], np.log10(own)))
        return pa.table(
            [block.column("doc_id"), block.column("held_out"), pa.array(n), pa.array(known), pa.array(np.full(len(n), n_tokens)), pa.array(base_score), pa.array(score)],
            [c.split()[0] for c in _SCORES.split(", ")],
        )

    return run


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffles go as soon as the table written from them is there: nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Seating:
    """State as a table in the shared folder, bucketed so that what is dealt by ``bucket`` meets it where it lies."""

    def __init__(self, df: DataFrame, n_buckets: int) -> None:
        self.spark, self.name = df.sparkSession, f"seating_{uuid.uuid4().hex[:12]}"
        self.path = stage_path(self.spark, "seating")
        with _shuffles_dropped(self.spark):
            df.write.format("parquet").option("path", self.path).bucketBy(n_buckets, "bucket").saveAsTable(self.name)

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _together(run: Callable) -> Callable:
    """``run`` over the rows of a bucket from both sides."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        batches = list(run(iter([*left.to_batches(), *right.to_batches()])))
        return pa.Table.from_batches(batches or [_batch([])])

    return both


def _at(seating: Seating, sent: DataFrame, run: Callable) -> DataFrame:
    """``run`` where the state lies; only ``sent`` is shuffled."""
    return seating.df.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(_together(run), _ROW)


def score_texts(docs: DataFrame, contexts: int | None = None, sweeps: int = SWEEPS, burn: int = BURN) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Needs ``doc_id, text``; other columns are ignored.  Rows with ``crc32(doc_id as text) mod 5 = 1`` are held out, all others
    train; a row with a null doc_id trains.  A null or empty text is its end token alone.  Repeated rows count and are scored
    each.  Scores are log10 probabilities: ``base_score`` of smoothed word counts, ``score`` of the model.  Without training
    rows there are no known words and every token has the probability of the base.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets, n_blocks = parts_for(spark, total, SENT_BYTES), parts_for(spark, total, BLOCK_BYTES)
    n_held = -(-n_blocks // 5)  # blocks of held-out rows, numbered before those of training rows
    train = docs.filter(~F.col("held_out")).select("text")
    meet = lambda *frames: reduce(DataFrame.unionByName, frames).repartitionById(n_buckets, F.col("bucket"))

    top = None
    if contexts is not None:
        words = train.mapInArrow(_count_words(n_buckets), _SENT).repartitionById(n_buckets, F.col("bucket"))
        rows = words.mapInArrow(_frequent_words(contexts), "word long, tokens long").orderBy(F.desc("tokens"), "word").limit(contexts).collect()
        top = np.array([r.word for r in rows], np.int64).view(np.uint64)
    frequent = send(top)

    pairs = train.mapInArrow(_count_pairs(n_buckets, frequent), _SENT).repartitionById(n_buckets, F.col("bucket"))
    state = Seating(pairs.mapInArrow(_first_state(n_buckets), _ROW), n_buckets)
    held = Seating(meet(state.df.mapInArrow(_sent_tables(n_buckets, True), _ROW)).mapInArrow(_first_contexts, _ROW), n_buckets)
    totals, history = _totals(state.df, None), []
    for k in range(sweeps + 1):
        record = k > burn or k == sweeps
        history += [totals] if record else []
        laid = _at(held, state.df.mapInArrow(_sent_tables(n_buckets, False), _ROW), _summed_tables)
        after = Seating(_at(state, laid, _sweep(send(tuple(totals)), k, record, k == sweeps)), n_buckets)
        state.drop()
        state, totals = after, _totals(after.df, totals) if k < sweeps else totals
    held.drop()

    mixed = F.xxhash64("doc_id", "text")
    block = F.when(F.col("held_out"), F.pmod(mixed, F.lit(n_held))).otherwise(F.pmod(mixed, F.lit(n_blocks)) + n_held).cast("int")
    docs, waves, scores = docs.withColumn("block", block), int(min(WAVES, 1 + total // WAVE_BYTES)), []
    for wave in range(waves):  # all blocks at once would have all texts, questions and answers on the disks together
        blocks = docs.filter(F.col("block") % waves == wave).repartition(int(-(-(n_held + n_blocks) // waves)), "block")
        asked = blocks.groupBy("block").applyInArrow(_ask(n_buckets, frequent), _ROW)
        answered = _at(state, asked, _answer(send([tuple(t) for t in history]))).withColumnRenamed("bucket", "block")
        scored = blocks.groupBy("block").cogroup(answered.groupBy("block"))
        with _shuffles_dropped(spark):
            scores.append(Stage(scored.applyInArrow(_score(n_buckets, frequent, len(history), totals.tokens, totals.words), _SCORES), "scores"))
    state.drop()
    return reduce(DataFrame.unionByName, [s.df for s in scores])
