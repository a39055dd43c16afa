"""Operator 2: removing repeated word windows, with a count-min prefilter.

Every block of documents sketches its windows into count-min counters with
two rows.  The counters are cut into shards; a block sends its occupied cells per
shard and row as compressed gaps, and the blocks' sketches are merged shard by shard
(counters stop at 2, which is all that is asked).  A shard tells every block which
of its own cells reached 2.  A merged counter can only be too high, so windows
that are below 2 in either row are unique for certain, and no repeated one is lost.

In the second pass a block sends, for each distinct window that may be repeated,
its 96-bit hash (of 128-bit BLAKE2b digests of the words) and the smallest doc_id that has it.  Groups by exact hash find
the corpus-wide minimum, and the block learns in which windows it isn't the
first.  A window shared by any number of documents is one entry per block, so
no group grows with the copies, and no sketch is ever held whole: memory is
bounded by the size of a block and of a shard, both constant.

Defined results: null and empty texts have no words; texts shorter than a
window lose nothing; documents with equal ids don't remove words from each other;
repeated rows get repeated results; rows with null doc_id lose nothing and take
nothing from others; extra columns are not looked at; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import U64, blocked, carried, expand, in_sorted, mix, squeeze, text_bytes, texts_of, window_hashes, word_digests, word_spans

WINDOW = 13
#: Text of a block; windows of a shard, about; counters in a row of a shard (a power of two).
BLOCK_BYTES, SHARD_WINDOWS, WIDTH = 4 << 20, 4 << 20, 1 << 25
CELLS = "block long, shard int, line int, once binary, more binary"
KEPT = "doc_id long, n_words long, n_removed long, text string"


class Words:
    """Words and windows of one block's texts."""

    def __init__(self, ids: pa.Array, texts: pa.Array, size: int) -> None:
        self.raw, self.off = text_bytes(texts)
        self.starts, self.ends, self.first = word_spans(self.raw, self.off)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))  # text of each word
        words = word_digests(self.raw, self.starts, self.ends)
        every = window_hashes(words[:, 0], size)
        usable = np.array(ids.is_valid())
        inside = self.owner[: len(every)] == self.owner[size - 1 :] if len(every) else np.zeros(0, bool)
        self.at = np.flatnonzero(inside & usable[self.owner[: len(every)]])
        self.hashes = every[self.at]
        self.second = window_hashes(words[:, 1], size, 0xA0761D6478BD642F)[self.at].astype(np.uint32)
        self.doc_ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.window_doc = self.doc_ids[self.owner[self.at]]


def by_hash(h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal hashes are neighbours, and where each group of them begins."""
    order = np.argsort(h)
    hs, seconds = h[order], h2[order]
    same = hs[1:] == hs[:-1]
    if (same & (seconds[1:] != seconds[:-1])).any():  # two windows with one 64-bit hash: the second one parts them
        order = np.lexsort((h2, h))
        hs, seconds = h[order], h2[order]
        same = (hs[1:] == hs[:-1]) & (seconds[1:] == seconds[:-1])
    return order, np.append(len(h[:1]) > 0, ~same)[: len(h)]


def group_least(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least value of each group of neighbours, once for every member."""
    if not len(values):
        return values
    return np.minimum.reduceat(values, np.flatnonzero(first))[np.cumsum(first) - 1]


def _merged(*tables: pa.Table) -> list[pa.Array]:
    return [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for t in tables for c in t.columns]


def shard_and_cells(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The shard of each hash and its cell in either row."""
    other = mix(hashes ^ U64(0x5851F42D4C957F2D))
    return (other >> U64(40)) % U64(shards), [hashes & U64(WIDTH - 1), other & U64(WIDTH - 1)]


def _sketch(table: pa.Table, size: int, shards: int) -> pa.Table:
    block, ids, texts = _merged(table.select(["block", "doc_id", "text"]))
    w = Words(ids, texts, size)
    shard, cells = shard_and_cells(w.hashes, shards)
    out = []
    for line in (0, 1):
        keys = np.sort((shard << U64(32)) | cells[line])
        first = np.ones(len(keys), dtype=bool)
        first[1:] = keys[1:] != keys[:-1]
        once, more = keys[first], np.unique(keys[~first])
        bounds = np.arange(shards + 1, dtype=np.uint64) << U64(32)
        cut, cut_more = np.searchsorted(once, bounds), np.searchsorted(more, bounds)
        # only shards that the block has windows in: their number is bounded by the windows
        for s in np.flatnonzero(np.diff(cut)).tolist():
            blobs = [squeeze(x[c[s] : c[s + 1]].astype(np.uint32)) for x, c in ((once, cut), (more, cut_more))]
            out.append((block[0].as_py(), s, line, *blobs))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], ["block", "shard", "line", "once", "more"])


def _merge_cells(table: pa.Table) -> pa.Table:
    """One shard and row: add up the blocks' counters, and tell each block its cells with 2 or more."""
    blocks, shard, line, once, more = _merged(table)
    counts = np.zeros(WIDTH, dtype=np.uint8)
    for blobs in (once, more):
        for blob in blobs:
            at = expand(blob.as_py(), "u4")
            counts[at] = np.minimum(counts[at] + 1, 2)
    found = []
    for blob in once:
        at = expand(blob.as_py(), "u4")
        found.append(squeeze(at[counts[at] > 1]))
    return pa.Table.from_arrays([blocks, shard, line, pa.array(found, pa.binary())], ["block", "shard", "line", "cells"])


def _suspects(texts: pa.Table, replies: pa.Table, size: int, shards: int) -> pa.Table:
    """The windows of a block that are estimated repeated, by shard: hash, second hash and smallest doc_id of each distinct one."""
    block, ids, text = _merged(texts.select(["block", "doc_id", "text"]))
    w = Words(ids, text, size)
    shard, cells = shard_and_cells(w.hashes, shards)
    alive = np.arange(len(w.hashes))
    if replies.num_rows:
        _, of, line, blobs = (c.to_pylist() for c in replies.columns)
        for row in (0, 1):
            mine = sorted((s, b) for s, x, b in zip(of, line, blobs, strict=True) if x == row)
            high = np.concatenate([expand(b, "u4").astype(np.uint64) | (U64(s) << U64(32)) for s, b in mine]) if mine else np.zeros(0, np.uint64)
            alive = alive[in_sorted((shard[alive] << U64(32)) | cells[row][alive], high)]
    else:
        alive = alive[:0]
    order, first = by_hash(w.hashes[alive], w.second[alive])
    order = alive[order]
    doc = group_least(w.window_doc[order], first)[first]
    h, h2 = w.hashes[order][first], w.second[order][first]
    of = shard_and_cells(h, shards)[0].astype(np.int64)
    rows = []
    for s in range(shards):
        at = np.flatnonzero(of == s)
        if len(at):
            rows.append({"block": block[0].as_py(), "shard": s, "hashes": squeeze(h[at]), "second": squeeze(h2[at]), "docs": squeeze(doc[at].astype("<i8").view(np.uint64))})
    return pa.Table.from_pylist(rows, pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("hashes", pa.binary()), ("second", pa.binary()), ("docs", pa.binary())]))


def _merge_windows(table: pa.Table) -> pa.Table:
    """One shard: the smallest doc_id of each window, and for each block the windows that start in a smaller document elsewhere."""
    blocks, _, *blobs = _merged(table)
    parts = [[expand(x.as_py(), kind) for x in column] for column, kind in zip(blobs, ("u8", "u4", "u8"), strict=True)]
    h, h2 = np.concatenate(parts[0]), np.concatenate(parts[1])
    doc = np.concatenate(parts[2]).view(np.int64)
    source = np.repeat(np.arange(len(blocks)), [len(x) for x in parts[0]])
    order, first = by_hash(h, h2)
    later = order[doc[order] > group_least(doc[order], first)]
    later = later[np.lexsort((h[later], source[later]))]
    cut = np.searchsorted(source[later], np.arange(len(blocks) + 1))
    found = [squeeze(h[later[cut[k] : cut[k + 1]]]) for k in range(len(blocks))]
    keep = [k for k, x in enumerate(found) if x]
    return pa.Table.from_arrays([blocks.take(pa.array(keep, pa.int64())), pa.array([found[k] for k in keep], pa.binary())], ["block", "hashes"])


def joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n_texts: int) -> pa.Array:
    """The given words of each text, joined by one space."""
    sizes = ends - starts
    first = np.ones(len(starts), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    dest = np.cumsum(sizes + ~first) - sizes
    total = int(dest[-1] + sizes[-1]) if len(sizes) else 0
    out = np.full(total, 0x20, dtype=np.uint8)
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(dest, sizes) + step] = raw[np.repeat(starts, sizes) + step]
    bounds = np.append(dest[first], total)
    lengths = np.zeros(n_texts, dtype=np.int64)
    lengths[owner[first]] = np.diff(bounds)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.LargeStringArray.from_buffers(n_texts, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def _remove(texts: pa.Table, replies: pa.Table, size: int, as_is: bool) -> pa.Table:
    """Words of a block that stay: windows of a smaller document, in the block or (by the replies) elsewhere, go."""
    ids, text = _merged(texts.select(["doc_id", "text"]))
    w = Words(ids, text, size)
    n = len(w.hashes)
    elsewhere = np.sort(np.concatenate([expand(x, "u8") for x in replies.column(1).to_pylist()])) if replies.num_rows else np.zeros(0, np.uint64)
    order, first = by_hash(w.hashes, w.second)
    doc = w.window_doc[order]
    gone = np.zeros(n, dtype=bool)
    gone[order] = (doc > group_least(doc, first)) | in_sorted(w.hashes[order], elsewhere)
    cover = np.zeros(len(w.starts) + 1, dtype=np.int64)
    at = w.at[gone]  # starts are distinct
    cover[at] += 1
    cover[at + size] -= 1
    removed = np.cumsum(cover)[:-1] > 0
    total = np.diff(w.first)
    lost = np.bincount(w.owner[removed], minlength=len(ids)) if len(ids) else total
    keep = np.flatnonzero(~removed)
    kept = joined_words(w.raw, w.starts[keep], w.ends[keep], w.owner[keep], len(ids))
    if as_is:
        kept = pc.if_else(pa.array(lost == 0), text.fill_null(""), kept)
    others = [n for n in texts.column_names if n.startswith("_")]
    cols = [ids, pa.array(total), pa.array(lost.astype(np.int64)), kept, *(texts.column(n) for n in others)]
    return pa.Table.from_arrays(cols, ["doc_id", "n_words", "n_removed", "text", *others])


def _kept(rows: DataFrame, size: int, as_is: bool, more: str = "") -> DataFrame:
    docs, total, _ = blocked(rows, BLOCK_BYTES)
    shards = max(1, -(-total // (6 * SHARD_WINDOWS)))
    sketches = docs.groupBy("block").applyInArrow(lambda t: _sketch(t, size, shards), CELLS)
    high = sketches.groupBy("shard", "line").applyInArrow(_merge_cells, "block long, shard int, line int, cells binary")
    suspects = (
        docs.groupBy("block")
        .cogroup(high.groupBy("block"))
        .applyInArrow(lambda t, r: _suspects(t, r, size, shards), "block long, shard int, hashes binary, second binary, docs binary")
    )
    later = suspects.groupBy("shard").applyInArrow(_merge_windows, "block long, hashes binary")
    return docs.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(lambda t, r: _remove(t, r, size, as_is), KEPT + more)


def remove_repeats(df: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every row; text: the words that stay, joined by one space."""
    return _kept(texts_of(df, id_col, text_col), size, False)


def cleaned(df: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", emptied: bool = False) -> DataFrame:
    """The table with its repeated windows taken out of the texts; texts that lose nothing stay as they are, rows that lose all words go, or stay with an empty text if ``emptied``."""
    rows, restore, more = carried(df, id_col, text_col)
    kept = _kept(rows, size, True, more)
    return (kept if emptied else kept.where("n_removed = 0 OR n_removed < n_words")).select(*restore)
