"""Chat formatting by columnar byte assembly, and the way back.

A turn is ``<s>role\\n`` + body + ``</s>``; the body of an assistant's turn is its text, any other is
``[INST] text [/INST]``.  Control strings inside texts and roles get a backslash after their first character, backslashes
are doubled, and a line break inside a role gets one before it, so removing a backslash before any character restores the
input and no text can pass for a control string.

Rows arrive sorted by conversation and turn.  For a batch of them the lengths of all segments give cumulative offsets,
the offsets give scatter indices, and headers and contents are copied into one preallocated buffer, which is the Arrow
column that leaves.  A conversation is one row; one beyond ``PART_BYTES`` goes on in rows of ascending ``part``, so that
memory does not depend on the longest conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .shared import take_ranges

OPEN, ASK, ASKED, CLOSE = b"<s>", b"[INST] ", b" [/INST]", b"</s>"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
TAUGHT = "assistant"
PART_BYTES = 16 << 20

FORMATTED = "conv_id long, part int, n_turns long, formatted string, loss_spans array<struct<start:int,end:int>>"


def _escaped(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(pc.fill_null(texts, ""), "\\", "\\\\")
    for control in CONTROL:
        texts = pc.replace_substring(texts, control, control[0] + "\\" + control[1:])
    return texts


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    _, at, data = texts.buffers()
    bounds = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def assemble(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns in one buffer: it, the start of each turn, and the start and end of each text in it."""
    roles = pc.fill_null(rows.column("role").combine_chunks(), "")
    taught = pc.equal(roles, TAUGHT).to_numpy(zero_copy_only=False)
    role, role_at = _bytes_of(pc.replace_substring(_escaped(roles), "\n", "\\\n"))
    text, text_at = _bytes_of(_escaped(rows.column("text").combine_chunks()))
    n, zero = len(taught), np.zeros(len(taught), np.int64)
    asked = ~taught
    lengths = np.stack(
        [zero + len(OPEN), np.diff(role_at), zero + 1, asked * len(ASK), np.diff(text_at), asked * len(ASKED), zero + len(CLOSE)], axis=1
    )
    ends = np.cumsum(lengths).reshape(n, -1) if n else lengths
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, (header, where) in enumerate([(OPEN, None), (None, None), (b"\n", None), (ASK, asked), (None, None), (ASKED, asked), (CLOSE, None)]):
        if header:
            at = starts[:, k] if where is None else starts[where, k]
            out[at[:, None] + np.arange(len(header))] = np.frombuffer(header, np.uint8)
    for k, data, bounds in ((1, role, role_at), (4, text, text_at)):
        out[take_ranges(starts[:, k], lengths[:, k])] = data[bounds[0] : bounds[-1]]
    return out, starts[:, 0], starts[:, 4], ends[:, 4]


def _formatter(part_bytes: int) -> Callable:
    def made(rows: pa.Table, ids: np.ndarray, part: int) -> pa.RecordBatch:
        """All conversations of ``rows``; ``ids`` numbers them, the first continues as ``part``."""
        out, turn_at, text_at, text_end = assemble(rows)
        first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        cuts = np.append(turn_at[first], len(out))
        formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(out)])
        upto = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
        taught = np.flatnonzero(pc.fill_null(pc.equal(rows.column("role").combine_chunks(), TAUGHT), False).to_numpy(zero_copy_only=False))
        of = np.searchsorted(first, taught, "right") - 1
        base = upto[cuts[of]]
        spans = pa.StructArray.from_arrays(
            [pa.array((upto[text_at[taught]] - base).astype(np.int32)), pa.array((upto[text_end[taught]] - base).astype(np.int32))], ["start", "end"]
        )
        at = pa.array(np.searchsorted(of, np.arange(len(first) + 1)).astype(np.int32))
        parts = np.zeros(len(first), np.int32)
        parts[0] = part
        turns = np.diff(np.append(first, len(ids)))
        return pa.RecordBatch.from_arrays(
            [rows.column("conv_id").combine_chunks().take(pa.array(first)), pa.array(parts), pa.array(turns), formatted.cast(pa.string()), pa.ListArray.from_arrays(at, spans)],
            ["conv_id", "part", "n_turns", "formatted", "loss_spans"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, going = None, 0, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            if not rows.num_rows:
                continue
            if part and rows.column("conv_id")[0].as_py() != going:
                part = 0  # what was sent in parts ended with its batch
            ids = _numbered(rows.column("conv_id"))
            last = int(np.searchsorted(ids, ids[-1]))  # the last conversation may go on in the next batch
            if last:
                yield made(rows.slice(0, last).combine_chunks(), ids[:last], part)
                part = 0
            held = rows.slice(last).combine_chunks()
            if held.nbytes > part_bytes:
                yield made(held, ids[last:], part)
                going = held.column("conv_id")[0].as_py()
                held, part = None, part + 1
        if held is not None and held.num_rows:
            yield made(held, _numbered(held.column("conv_id")), part)

    return run


def _numbered(ids: pa.ChunkedArray) -> np.ndarray:
    """0, 1, ... for the runs of equal values, a null being one more value."""
    values = pc.fill_null(ids, 0).to_numpy()
    missing = pc.is_null(ids).to_numpy()
    fresh = np.zeros(len(values), np.int64)
    fresh[1:] = (values[1:] != values[:-1]) | (missing[1:] != missing[:-1])
    return np.cumsum(fresh)


def format_chat(conversations: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``conv_id, part, n_turns, formatted, loss_spans``: conversations in the template, and the code points of
    ``formatted`` that a loss should count, one span per assistant's text.

    Needs ``conv_id, turn, role, text``; other columns are ignored.  Turns are ordered by turn (null first); ties and
    repeated rows by role, then text.  A null role or text counts as empty; rows with a null conv_id are one conversation.
    An empty table gives no rows.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_formatter(part_bytes), FORMATTED)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of whole turns."""
    turns = []
    for turn in formatted.split(CLOSE.decode())[:-1]:
        role, body = re.fullmatch(r"<s>((?:[^\\\n]|\\.)*)\n(.*)", turn, re.DOTALL).groups()
        if body.startswith(ASK.decode()):
            body = body[len(ASK) : -len(ASKED)]
        turns.append((unescaped(role), unescaped(body)))
    return turns


def _reader() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["part"] == 0:
                    if now:
                        done.append(now)
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parsed(row["formatted"]):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for span in row["loss_spans"]:
                    text = unescaped(row["formatted"][span["start"] : span["end"]])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(row["formatted"])
            yield _digests(done)
        if now:
            yield _digests([now])

    return run


def _digests(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*[(i, n, t.hexdigest(), c, m.hexdigest(), f) for i, n, t, c, m, f in rows])) or [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in DIGESTS.split(", ")])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from ``format_chat``'s rows as they come (its partitions and order)."""
    return formatted.mapInArrow(_reader(), DIGESTS)
