r"""Operator 9: chat formatting by columnar byte assembly.

A conversation becomes ``<s>`` and, for each turn, ``[INST]role[/INST]text</s>``.
Every batch is laid out at once: segment lengths give cumulative offsets, the
offsets give scatter indices, and headers and contents are copied into one
preallocated buffer that becomes the Arrow column.  Control strings inside roles
and texts get a backslash behind their first character, and those that have
backslashes there already get one more, so unescaping takes away exactly one.

A conversation is one row (``part`` 0) as long as it has at most ``PART`` bytes;
longer ones continue in rows with higher ``part``, cut between turns, so no
conversation has to fit into memory.

Defined results: null text and null role count as empty; turns are in order of
turn (null first), then role, then text; repeated rows are repeated turns; rows
with null conv_id form one conversation; extra columns are not looked at; an
empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

BEGIN, ROLE, TEXT, END = b"<s>", b"[INST]", b"[/INST]", b"</s>"
CONTROL = re.compile(rb"<\\*/?s>|\[\\*/?INST\]")
UNESCAPE = re.compile(r"<\\(?=\\*/?s>)|\[\\(?=\\*/?INST\])")
TURN = re.compile(r"(?:<s>)?\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
#: Bytes of escaped text at which a conversation goes on in another row.
PART = 8 << 20
FORMATTED = "conv_id long, part int, n_turns long, formatted string, loss array<struct<start: long, length: long>>"


def escape(text: bytes) -> bytes:
    return CONTROL.sub(lambda m: m[0][:1] + b"\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: m[0][0], text)


def _escaped(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, off = text_bytes(col)
    if not CONTROL.search(raw.tobytes()):
        return raw, off
    done = [escape(raw[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
    return np.frombuffer(b"".join(done), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in done])]).astype(np.int64)


def _scatter(out: np.ndarray, begins: np.ndarray, raw: np.ndarray, off: np.ndarray) -> None:
    """Copy contents raw[off[k]:off[k+1]] to begins[k]."""
    out[np.repeat(begins - off[:-1], np.diff(off)) + np.arange(len(raw))] = raw


def assemble(b: pa.RecordBatch, first: np.ndarray, parts: list[int]) -> pa.RecordBatch:
    """Format rows (conv_id, turn, role, text) in order.  first: whether a row begins an output row; parts: the output rows' part numbers."""
    n = b.num_rows
    role, role_off = _escaped(b.column(2))
    text, text_off = _escaped(b.column(3))
    lengths = np.empty((n, 6), dtype=np.int64)
    heads = np.flatnonzero(first)
    opens = np.zeros(n, dtype=bool)
    opens[heads] = np.array(parts) == 0
    lengths[:, 0] = len(BEGIN) * opens
    lengths[:, 1] = len(ROLE)
    lengths[:, 2] = np.diff(role_off)
    lengths[:, 3] = len(TEXT)
    lengths[:, 4] = np.diff(text_off)
    lengths[:, 5] = len(END)
    ends = np.cumsum(lengths.ravel())
    begins = (ends - lengths.ravel()).reshape(n, 6)
    out = np.empty(int(ends[-1]), dtype=np.uint8)
    for k, mark in ((0, BEGIN), (1, ROLE), (3, TEXT), (5, END)):
        at = begins[opens, 0] if k == 0 else begins[:, k]
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, dtype=np.uint8)
    _scatter(out, begins[:, 2], role, role_off)
    _scatter(out, begins[:, 4], text, text_off)

    off = np.append(begins[heads, 0], len(out))
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    assistant = np.flatnonzero(np.array([r == "assistant" for r in b.column(2).to_pylist()], dtype=bool))
    owner = np.cumsum(first) - 1
    start = points[begins[assistant, 4]] - points[off[owner[assistant]]]
    length = points[begins[assistant, 5]] - points[begins[assistant, 4]]
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64())], ["start", "length"])
    span_off = np.searchsorted(owner[assistant], np.arange(len(heads) + 1)).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(heads), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(out))
    n_turns = np.diff(np.append(heads, n))
    return pa.RecordBatch.from_arrays(
        [b.column(0).take(pa.array(heads)), pa.array(parts, pa.int32()), pa.array(n_turns, pa.int64()), formatted, pa.ListArray.from_arrays(pa.array(span_off), spans)],
        ["conv_id", "part", "n_turns", "formatted", "loss"],
    )


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []  # rows of the conversation that may go on
    held_bytes = 0
    last: tuple[object, int] = ((), 0)  # id and part of the last conversation that was written

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal last
        b = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        null = np.array(b.column(0).is_null())
        ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        first = np.ones(b.num_rows, dtype=bool)
        first[1:] = (null[1:] != null[:-1]) | (ids[1:] != ids[:-1])
        parts = [0] * int(first.sum())
        if b.column(0)[0].as_py() == last[0]:
            parts[0] = last[1] + 1
        last = (b.column(0)[-1].as_py(), parts[-1])
        return assemble(b, first, parts)

    for b in slices(batches, 3):
        ids = b.column(0).to_pylist()
        cut = b.num_rows  # rows from cut on belong to the last conversation
        while cut and ids[cut - 1] == ids[-1]:
            cut -= 1
        if cut or (held and held[-1].column(0)[-1].as_py() != ids[0]):
            done = [*held, b.slice(0, cut)] if cut else held
            yield flush(done)
            held, held_bytes = [], 0
        held.append(b.slice(cut))
        held_bytes += int(text_bytes(held[-1].column(3))[1][-1])
        if held_bytes >= PART:
            yield flush(held)
            held, held_bytes = [], 0
    if held:
        yield flush(held)


def format_conversations(df: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss): loss spans are code points of ``formatted``, assistant texts only."""
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_formatted, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(n, pa.string() if "sha256" in n else pa.int64()) for n in names])
    current: list | None = None

    def close(c: list) -> tuple:
        return (c[0], c[1], c[2].hexdigest(), c[3], c[4].hexdigest(), c[5])

    for b in batches:
        done = []
        for conv, part, formatted, loss in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
            if part == 0:
                if current is not None:
                    done.append(close(current))
                current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for m in TURN.finditer(formatted):
                current[1] += 1
                current[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            for span in loss:
                text = unescape(formatted[span["start"] : span["start"] + span["length"]])
                current[3] += len(text)
                current[4].update(text.encode())
            current[5] += len(formatted)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema)
    if current is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, close(current), strict=True))], schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse what ``format_conversations`` gave (in its order and partitions): turns and loss text of each conversation, as digests."""
    return formatted.mapInArrow(_read_back, DIGEST)
