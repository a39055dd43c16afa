"""Operator 5: removing long repeated byte strings, with bucket-pointer refinement.

A string of ``LENGTH`` bytes that occurs twice begins with the same ``probe`` bytes, and
these have the same winnowing anchor (the smallest of their q-grams by hash, leftmost on
ties) at the same place in both.  So the suffixes of a text are cut into runs of starts
with one anchor, and only runs whose anchor occurs again need sorting.  Blocks of
documents send their distinct anchors, in order of which repeated ones are neighbours.
Runs that agree in all their bytes (by a 128-bit BLAKE2b digest) and in the place of the anchor
are repeated as a whole; one of each such group and all other runs go on.

Those are sorted by bucket-pointer refinement.  A task's buckets of one anchor are narrowed first by longer grams at fixed
distances from it, so that only suffixes that may be repeated are sorted.  These start in
buckets of their first 8 bytes.  A bucket is refined by sorting its suffixes on the
bucket identifiers at a later offset (8, 16, ... 128, and at last ``LENGTH - probe``), so every
pass reuses what the passes before have updated and doubles the order; suffixes alone in
their bucket, or next to such a one, leave the sort.  Buckets of ``LENGTH`` bytes with
more than one suffix are the repeated strings, which go; buckets of ``probe`` bytes are reported.

Anchors in over ``HOT`` different runs (the edges of a passage that a large part of all documents
shares) aren't gathered in a task: their buckets are refined first.  Runs are cut where the distance from
start to anchor passes multiples of a width, which is halved again and again; a
part's bucket is named by the bytes that all its strings have in common, so buckets shrink, and parts
alone in theirs are done, until no bucket is too large for a task or parts are single strings.

Defined results: null text counts as empty; texts shorter than ``LENGTH`` lose nothing;
matches never cross rows; repeated rows repeat each other, and so lose all strings of that length;
rows with null doc_id take part like others; extra columns are not
looked at; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_BASE, BYTE_BASE_INV, U64, digests, in_sorted, mix, powers, slices, text_bytes, texts_of, written

LENGTH = 400
#: Text of a block; bytes of runs in a sorting task; different runs with one anchor in a sorting task; text whose anchors are found at once.
BLOCK_BYTES, SORT_BYTES, HOT, SLICE_BYTES = 4 << 20, 2 << 20, 4096, 1 << 20
GRAMS = "gram long, block int, several boolean"
RUNS = "gram long, k0 long, k1 long, block int, row long, first int, last int, lead int"
DECIDED = "what byte, gram long, block int, row long, first int, last int, lead int, alone boolean"
PIECES = "block int, row long, gram long, first int, last int, lead int, alone boolean, bytes binary"
SPANS = "block int, row long, first int, last int, level byte"
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, kept binary"
#: Runs that are equal to another one; one of each kind; the same for anchors with too many kinds.
EQUAL, KIND, CROWDED = 0, 1, 2
#: Widths of the parts that buckets are narrowed by before their suffixes are sorted.
NARROW = (32, 8)
#: Spans of starts whose strings are repeated: ``LENGTH`` bytes where there are so many, and ``probe``; only the former; only the latter.
BOTH, LONG, SHORT = 0, 1, 2


def probe_of(length: int) -> int:
    """Bytes of the strings that anchors are found for: 256 of 400, at least half."""
    return max(1, length * 16 // 25, -(-length // 2))


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` bytes: which of them are equal is decided by bytes, later."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + U64(1)) * powers(BYTE_BASE, len(raw)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * powers(BYTE_BASE_INV, len(raw) + 1)[: len(sums) - size])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, from running minima within blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(raw: np.ndarray, off: np.ndarray, probe: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: text, first and last start, anchor (places in ``raw``), hash of the anchor's q-gram."""
    q = max(1, probe // 4)
    none = np.zeros(0, np.int64)
    if len(raw) < probe:
        return none, none, none, none, none.view(np.uint64)
    grams = gram_hashes(raw, q)
    place = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(place, probe - q + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    starts = np.flatnonzero(owner[: len(anchor)] == owner[probe - 1 :])
    if not len(starts):
        return none, none, none, none, none.view(np.uint64)
    of = anchor[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    first, last = starts[heads], starts[np.append(heads[1:], len(starts)) - 1]
    at = of[heads]
    return owner[first], first, last, at, grams[at]


def runs_of(raw: np.ndarray, off: np.ndarray, probe: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchor_runs`` of a block, about ``SLICE_BYTES`` at a time: sums and hashes take eight times as much, several times.

    Longer texts are cut (into runs that end there); what is cut overlaps by all bytes of a string but one.
    """
    k = 0
    while k < len(off) - 1:
        z = max(k + 1, int(np.searchsorted(off, off[k] + SLICE_BYTES, side="right")) - 1)
        for x in range(int(off[k]), int(off[z]), SLICE_BYTES) if z == k + 1 else [int(off[k])]:
            y = min(int(off[z]), x + SLICE_BYTES + probe - 1) if z == k + 1 else int(off[z])
            cut = off[k : z + 1] - x if z > k + 1 else np.array([0, y - x])
            text, first, last, at, gram = anchor_runs(raw[x:y], cut, probe)
            yield text + k, first + x, last + x, at + x, gram
        k = z


def blocked_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, doc_id, text) partitioned by block."""
    docs = texts_of(df, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    docs = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"), "doc_id", "text")
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(max(1, min(n_blocks, max(default, n_blocks // 8))), "block")


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return _column(table, name).to_numpy(zero_copy_only=False)


def _table(columns: list[np.ndarray], schema: str) -> pa.Table:
    """Columns named and typed as in a schema of Spark."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "byte": pa.int8(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


class Block:
    """The texts of a block; equal texts have one number."""

    def __init__(self, table: pa.Table) -> None:
        texts = _column(table, "text")
        self.raw, self.off = text_bytes(texts)
        data = memoryview(self.raw)
        self.number = digests(data[x:y] for x, y in zip(self.off[:-1].tolist(), self.off[1:].tolist(), strict=True))[:, 0].view(np.int64)
        self.block = table.column("block")[0].as_py() if table.num_rows else 0
        self.order = np.argsort(self.number, kind="stable")
        self.sorted = self.number[self.order]

    def first_of(self, number: np.ndarray) -> np.ndarray:
        """A text with each number."""
        return self.order[np.searchsorted(self.sorted, number)]


def _grams(table: pa.Table, probe: int) -> pa.Table:
    raw, off = text_bytes(_column(table, "text"))
    found = [gram for *_, gram in runs_of(raw, off, probe)]
    gram, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return _table([gram, np.full(len(gram), table.column("block")[0].as_py()), n > 1], GRAMS)


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram) of the grams, in order, that a neighbour has too or that their block has several times."""
    held: list[np.ndarray] = []
    for b in chain(batches, [None]):
        fresh = [c.to_numpy(zero_copy_only=False) for c in b.columns] if b is not None else []
        if fresh and not len(fresh[0]):
            continue
        gram, block, several = (np.concatenate(x) for x in zip(held, fresh, strict=True)) if held and fresh else fresh or held or [np.zeros(0, np.int64)] * 3
        if not len(gram):
            return
        same, several = gram[1:] == gram[:-1], several.astype(bool)
        several[1:] |= same
        several[:-1] |= same
        stays = 0 if b is None else 1  # the last one waits for the next
        held = [gram[-1:], block[-1:], several[-1:]]
        done = np.flatnonzero(several[: len(gram) - stays])
        yield pa.RecordBatch.from_arrays([pa.array(block[done]), pa.array(gram[done])], ["block", "gram"])


def _gathered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of spans."""
    sizes = ends - starts
    off = np.concatenate([[0], np.cumsum(sizes)])
    where = np.arange(int(off[-1])) + np.repeat(starts - off[:-1], sizes)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(raw[where]))])


def _runs(texts: pa.Table, again: pa.Table, length: int, probe: int) -> pa.Table:
    """The runs of a block whose anchors occur again, with a digest of their bytes and the anchor's place."""
    wanted = np.sort(_numbers(again, "gram").view(np.uint64)) if again.num_rows else np.zeros(0, np.uint64)
    parts = []
    if texts.num_rows and len(wanted):
        b = Block(texts)
        for text, first, last, at, gram in runs_of(b.raw, b.off, probe):
            keep = in_sorted(gram, wanted)
            text, first, last, lead, gram = text[keep], first[keep], last[keep], (at - first)[keep], gram[keep]
            data = memoryview(b.raw)
            ends = np.minimum(last + length, b.off[text + 1])
            k = digests(x.to_bytes(4, "little") + data[y:z] for x, y, z in zip(lead.tolist(), first.tolist(), ends.tolist(), strict=True))
            parts.append(_table([gram, k[:, 0], k[:, 1], np.full(len(gram), b.block), b.number[text], first - b.off[text], last - b.off[text], lead], RUNS))
    return pa.concat_tables([*parts, _table([np.zeros(0, np.int64)] * 8, RUNS)])


def _decide(batches: Iterator[pa.RecordBatch], schema: str = DECIDED) -> Iterator[pa.RecordBatch]:
    """Runs in order of gram and digest: those that are equal to another one, and one of each kind where a gram has several kinds.

    Of a gram's kinds no more than ``HOT`` wait for the others; from there on the gram is crowded.
    """
    held: list[np.ndarray] = []  # the last row, and whether it goes on with the kind of the row before
    inside = False
    wait: list[np.ndarray] = []  # first runs of the kinds of the last gram
    crowded: int | None = None

    def out(rows: list[np.ndarray], what: np.ndarray) -> pa.RecordBatch:
        return _table([what, rows[0], *rows[3:8], rows[-1], *rows[8:-1]], schema).combine_chunks().to_batches()[0]

    for b in chain(batches, [None]):
        fresh = [c.to_numpy(zero_copy_only=False) for c in b.columns] if b is not None else []
        if fresh and not len(fresh[0]):
            continue
        rows = [np.concatenate(x) for x in zip(held, fresh, strict=True)] if held and fresh else fresh or held
        if not rows:
            return
        n = len(rows[0])
        same = np.all([c[1:] == c[:-1] for c in rows[:3]], axis=0) if n > 1 else np.zeros(0, bool)
        goes_on = np.concatenate([[inside], same])
        equal = goes_on.copy()
        equal[:-1] |= same
        done = n if b is None else n - 1
        held, inside = [c[done:] for c in rows], bool(goes_on[-1])
        if equal[:done].any():
            take = np.flatnonzero(equal[:done])
            yield out([*(c[take] for c in rows), np.zeros(len(take), bool)], np.full(len(take), EQUAL))
        take = np.flatnonzero(~goes_on[:done])
        kinds = [*(c[take] for c in rows), ~equal[take]]
        kinds = [np.concatenate(x) for x in zip(wait, kinds, strict=True)] if wait else kinds
        gram = kinds[0]
        if not len(gram):
            continue
        new = np.ones(len(gram), dtype=bool)
        new[1:] = gram[1:] != gram[:-1]
        heads = np.flatnonzero(new)
        size = np.repeat(np.diff(np.append(heads, len(gram))), np.diff(np.append(heads, len(gram))))
        known = gram == crowded if crowded is not None else np.zeros(len(gram), bool)
        many = known | (size > HOT)
        upto = len(gram) if b is None or many[-1] else int(heads[-1])
        crowded = int(gram[-1]) if many[-1] else None
        take = np.flatnonzero((many | (size > 1))[:upto])
        wait = [c[upto:] for c in kinds]
        if len(take):
            yield out([c[take] for c in kinds], np.where(many[take], CROWDED, KIND))


def _cut_out(texts: pa.Table, wanted: pa.Table, length: int) -> pa.Table:
    """The bytes of the wanted runs of a block."""
    names = ["what", "block", "row", "gram", "first", "last", "lead", "alone"]
    if not wanted.num_rows or not texts.num_rows:
        return _table([np.zeros(0, np.int64)] * 7 + [np.zeros(0, bool), np.zeros(0, object)], f"what byte, {PIECES}")
    b = Block(texts)
    text = b.first_of(_numbers(wanted, "row"))
    start = b.off[text] + _numbers(wanted, "first")
    end = np.minimum(b.off[text] + _numbers(wanted, "last") + length, b.off[text + 1])
    return pa.Table.from_arrays([*(_column(wanted, c) for c in names), _gathered(b.raw, start, end).cast(pa.binary())], [*names, "bytes"])


def refine(raw: np.ndarray, end: np.ndarray, start: np.ndarray, length: int, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes share their first ``length`` bytes, and which their first ``probe`` bytes, with another one.

    Runs end at ``end``; only places flagged in ``start`` are suffixes of their own, what follows them is there to be pointed at.

    Suffixes start in buckets of their first 8 bytes (or fewer, for short lengths);
    sorting on the identifiers ``step`` bytes later refines buckets of ``size`` bytes
    to up to twice that.
    """
    n = len(raw)
    size = 8
    while size > probe:
        size //= 2
    key = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for k in range(size):
        key = (key << U64(8)) | raw[k : k + len(key)]
    at = np.flatnonzero(np.arange(len(key)) + size <= end[: len(key)])
    bucket = np.full(n + 1, -1, dtype=np.int64)
    at = _name(bucket, at, key[at])
    short = None
    while size < length:
        if size == probe:
            own = np.flatnonzero(start & (bucket[:n] >= 0))
            short = np.zeros(n, dtype=bool)
            short[own] = np.bincount(bucket[own])[bucket[own]] > 1 if len(own) else False
        step = min(size, (length if size >= probe else probe) - size)
        # sort on the pointers of the suffixes that start ``step`` later
        at = at[at + step < n]
        at = at[(at + step + size <= end[at])]
        at = at[bucket[at + step] >= 0]
        key = (bucket[at].astype(np.uint64) << U64(32)) | bucket[at + step].astype(np.uint64)
        fresh = np.full(n + 1, -1, dtype=np.int64)
        at = _name(fresh, at, key)
        bucket = fresh
        size += step
    long = bucket[:n] >= 0
    return long, long if short is None else short


def _name(bucket: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Number the buckets of equal keys; suffixes alone in theirs are left out."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    number = np.cumsum(new) - 1
    several = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
    bucket[at[order[several]]] = number[several]
    return at[bucket[at] >= 0]


def _narrowed(raw: np.ndarray, off: np.ndarray, gram: np.ndarray, lead: np.ndarray, n: np.ndarray, alone: np.ndarray, length: int, probe: int) -> tuple[np.ndarray, ...]:
    """What of the runs may be repeated: run, first and last start in it.

    Runs are cut where the lead (the distance from a start to the anchor) passes multiples of a width; strings with leads of one part have all but ``width - 1`` of
    their bytes in common, so the part's bucket is named by gram, lead and the hash of these.  Parts alone in their bucket, or
    in one of parts that are repeated as wholes anyway, have no string that is to be found.
    """
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + U64(1)) * powers(BYTE_BASE, len(raw)), out=sums[1:])
    back = powers(BYTE_BASE_INV, len(raw) + 1)
    run, high, low = np.arange(len(n)), lead, lead - n + 1
    for width in NARROW:
        if width > probe // 2:
            continue
        parts = high // width - low // width + 1
        of = np.repeat(np.arange(len(run)), parts)
        k = low[of] // width + np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        run, high, low = run[of], np.minimum(high[of], k * width + width - 1), np.maximum(low[of], k * width)
        at = off[run] + lead[run] - k * width
        h = (sums[at + probe - width + 1] - sums[at]) * back[at]
        _, bucket, count = np.unique(mix(h ^ mix(gram[run] ^ mix(k.astype(np.uint64)))), return_inverse=True, return_counts=True)
        open_ = np.bincount(bucket, weights=alone[run]) > 0
        keep = ((count > 1) & open_)[bucket]
        run, high, low = run[keep], high[keep], low[keep]
    if len(run):  # neighbouring parts together again
        order = np.lexsort((-high, run))
        run, high, low = run[order], high[order], low[order]
        new = np.ones(len(run), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (high[1:] != low[:-1] - 1)
        heads = np.flatnonzero(new)
        run, high, low = run[heads], high[heads], low[np.append(heads[1:], len(run)) - 1]
    return run, lead[run] - high, lead[run] - low


def _sorted_spans(table: pa.Table, length: int, probe: int) -> pa.Table:
    """Repeated starts in the runs of one task, as spans."""
    raw, off = text_bytes(_column(table, "bytes"))
    block, row, first, last, lead, gram, alone = (_numbers(table, c) for c in ("block", "row", "first", "last", "lead", "gram", "alone"))
    run, x, y = _narrowed(raw, off, gram.view(np.uint64), lead.astype(np.int64), (last - first + 1).astype(np.int64), alone.astype(bool), length, probe)
    if not len(run):
        return _table([np.zeros(0, np.int64)] * 5, SPANS)
    begin, end = off[run] + x, np.minimum(off[run] + y + length, off[run + 1])
    shift = first[run] + x
    raw, off = text_bytes(_gathered(raw, begin, end))
    sizes = np.diff(off)
    start = np.arange(len(raw)) - np.repeat(off[:-1], sizes) <= np.repeat(y - x, sizes)
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    parts = []
    for level, flag in zip((LONG, SHORT), refine(raw, np.repeat(off[1:], sizes), start, length, probe), strict=True):
        begin = np.flatnonzero(flag & (edge[:-1] | ~np.concatenate([[False], flag[:-1]])))
        stop = np.flatnonzero(flag & (edge[1:] | ~np.concatenate([flag[1:], [False]])))
        of = np.searchsorted(off, begin, side="right") - 1
        move = shift[of] - off[of]
        parts.append(_table([block[run[of]], row[run[of]], begin + move, stop + move, np.full(len(of), level)], SPANS))
    return pa.concat_tables(parts)


def _split(batches: Iterator[pa.RecordBatch], width: int, length: int, probe: int) -> Iterator[pa.RecordBatch]:
    """Cut runs where the lead passes multiples of ``width``, and name their buckets by the bytes that all strings with such leads have in common."""
    for b in batches:
        out: list[tuple] = []
        for block, row, _, first, last, lead, _, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for k in range((lead - last + first) // width, lead // width + 1):
                high, low = min(lead, k * width + width - 1), max(lead - last + first, k * width)
                x, y = lead - high, lead - low  # starts within the run
                common = data[lead - k * width : lead - (k * width + width - 1) + probe]
                part = data[x : min(len(data), y + length)]
                key, kind = digests([k.to_bytes(4, "little") + common, high.to_bytes(4, "little") + part]).view(np.int64)
                out.append((int(key[0]), int(kind[0]), int(kind[1]), block, row, first + x, first + y, high, part))
        columns = [np.array(c, dtype=object if k == 8 else np.int64) for k, c in enumerate(zip(*out, strict=True))]
        if columns:
            yield from _table(columns, RUNS + ", bytes binary").to_batches()


def _remove(texts: pa.Table, spans: pa.Table, length: int, probe: int) -> pa.Table:
    if not texts.num_rows:
        return _table([np.zeros(0, np.int64)] * 5 + [np.zeros(0, object)], KEPT)
    b = Block(texts)
    raw, off, n = b.raw, b.off, texts.num_rows

    def covered(long: bool) -> np.ndarray:
        cover = np.zeros(len(raw) + 1, dtype=np.int32)
        take = _numbers(spans, "level") != (SHORT if long else LONG)
        row, first, last = (_numbers(spans, c)[take] for c in ("row", "first", "last"))
        # equal texts all lose the same
        lo, hi = np.searchsorted(b.sorted, row), np.searchsorted(b.sorted, row, side="right")
        text = b.order[np.repeat(lo, hi - lo) + np.arange(int((hi - lo).sum())) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        size = length if long else probe
        first, last = off[text] + np.repeat(first, hi - lo), np.minimum(off[text] + np.repeat(last, hi - lo), off[text + 1] - size)
        some = first <= last
        np.add.at(cover, first[some], 1)
        np.add.at(cover, last[some] + size, -1)
        return np.cumsum(cover, dtype=np.int32)[:-1] > 0

    gone = covered(True) if spans.num_rows else np.zeros(len(raw), dtype=bool)
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    begins = gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]]))
    count = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[off])
    lost, n_spans = count(gone), count(begins)
    repeated = count(covered(False)) if spans.num_rows else lost
    kept_off = np.concatenate([[0], np.cumsum(np.diff(off) - lost)]).astype(np.int64)
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(kept_off), pa.py_buffer(np.ascontiguousarray(raw[~gone]))]).cast(pa.binary())
    return pa.Table.from_arrays([_column(texts, "doc_id"), *(pa.array(x) for x in (np.diff(off), lost, n_spans, repeated)), kept], [x.split()[0] for x in KEPT.split(", ")])


def remove_repeated_bytes(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_repeated, kept) of every row; kept: the bytes that stay.

    ``n_repeated`` counts the bytes that strings of ``probe_of(length)`` bytes cover which also start anywhere else: what is repeated but may be too short to go.
    """
    probe = probe_of(length)
    docs = blocked_rows(df, id_col, text_col)
    by_block = docs.groupBy("block")
    grams = by_block.applyInArrow(lambda t: _grams(t, probe), GRAMS)
    again = grams.repartition("gram").sortWithinPartitions("gram").mapInArrow(_again, "block int, gram long")
    runs = by_block.cogroup(again.groupBy("block")).applyInArrow(lambda t, a: _runs(t, a, length, probe), RUNS)
    order = ["gram", "k0", "k1"]
    decided = written(runs.repartition("gram").sortWithinPartitions(*order).mapInArrow(_decide, DECIDED), "decided")
    place = ["block", "row", "first", "last"]

    def marked(rows: DataFrame, level: int) -> DataFrame:
        return rows.select(*place, F.lit(level).cast("byte").alias("level"))

    def sorted_in_tasks(pieces: DataFrame, size: int) -> DataFrame:
        tasks = max(1, -(-size // SORT_BYTES))
        return pieces.groupBy(F.pmod("gram", F.lit(tasks)).alias("task")).applyInArrow(lambda t: _sorted_spans(t, length, probe), SPANS)

    run_bytes = F.sum(F.col("last") - F.col("first") + F.lit(length).cast("long"))
    sizes = {r["what"]: r["size"] for r in decided.groupBy("what").agg(run_bytes.alias("size")).collect()}
    wanted = decided.where(F.col("what") != EQUAL).select("what", "block", "row", "gram", "first", "last", "lead", "alone")
    pieces = written(by_block.cogroup(wanted.groupBy("block")).applyInArrow(lambda t, w: _cut_out(t, w, length), f"what byte, {PIECES}"), "pieces")
    names = [x.split()[0] for x in PIECES.split(", ")]
    spans = marked(decided.where(F.col("what") == EQUAL), BOTH)
    spans = spans.unionByName(sorted_in_tasks(pieces.where(F.col("what") == KIND).select(*names), sizes.get(KIND, 0)))
    crowd = pieces.where(F.col("what") == CROWDED).select(*names) if CROWDED in sizes else None
    width = probe - max(1, probe // 4) + 1
    while crowd is not None:
        width = -(-width // 2)
        parts = crowd.mapInArrow(lambda it, w=width: _split(it, w, length, probe), RUNS + ", bytes binary")
        judged = written(parts.repartition("gram").sortWithinPartitions(*order).mapInArrow(lambda it: _decide(it, DECIDED + ", bytes binary"), DECIDED + ", bytes binary"), "parts")
        spans = spans.unionByName(marked(judged.where(F.col("what") == EQUAL), BOTH))
        rest = judged.select("what", *names)
        if width == 1:  # single strings of ``probe`` bytes, of which there are several; those of ``length`` bytes that are repeated are known
            spans = spans.unionByName(marked(rest.where(F.col("what") != EQUAL), SHORT))
            break
        size = rest.where(F.col("what") == KIND).agg(run_bytes).first()[0]
        if size:
            spans = spans.unionByName(sorted_in_tasks(rest.where(F.col("what") == KIND).drop("what"), size))
        crowd = rest.where(F.col("what") == CROWDED).drop("what")
        if not crowd.limit(1).count():
            break
    return by_block.cogroup(spans.groupBy("block")).applyInArrow(lambda t, s: _remove(t, s, length, probe), KEPT)
