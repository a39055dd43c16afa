"""Operator 7: packing documents into sequences, shortest pack first over the length histogram.

A document is its token ids and one end id; it is cut into full pieces of
``context`` tokens and a rest.  Only the histogram of piece lengths (at most
``context`` numbers) reaches the driver.  Lengths are placed longest first, a
whole count at a time, into the shortest open packing pattern that they fit, which
splits pattern counts instead of handling documents.  Patterns then become
runs of ranks for each length, and pieces find their sequence by their own rank
among the pieces of their length.  Ranks are numbered within (length, salt) and
shifted by the counts of earlier salts, so a length that a third of all pieces
share is sorted in many tasks.

Defined results: null text counts as empty and gives one piece with the end id;
repeated rows and ids are packed one by one; extra columns are not
looked at; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .common import slices, texts_of, written

#: Pieces of one length and salt, about.
RUN = 200_000
PIECES = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


def _piece_batch(b: pa.RecordBatch, tokenizer: str, context: int, end_id: int, with_ids: bool) -> pa.RecordBatch:
    bpe = byte_bpe(tokenizer)
    own, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
    end = np.array([end_id], dtype="<u4")
    for k, text in enumerate(b.column(1).to_pylist()):
        tokens = np.concatenate([bpe.encode(text or "").astype("<u4", copy=False), end])
        data = tokens.tobytes()
        for at in range(0, len(tokens), context):
            piece = data[4 * at : 4 * (at + context)]
            own.append(k)
            starts.append(at)
            lengths.append(len(piece) // 4)
            crcs.append(zlib.crc32(piece))
            totals.append(len(tokens))
            if with_ids:
                ids.append(np.frombuffer(piece, dtype="<i4"))
    cols = [b.column(0).take(pa.array(own, pa.int64())), b.column(2).take(pa.array(own, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
    names = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"]
    if with_ids:
        cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
    return pa.RecordBatch.from_arrays(cols, names)


def pieces(df: DataFrame, tokenizer: str, context: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every row: doc_id, row (tells rows apart), start, length, ids_crc32, doc_tokens, and ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield _piece_batch(b, tokenizer, context, end_id, with_ids)

    rows = texts_of(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def patterns(histogram: dict[int, int], context: int) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first: (count, lengths) for a histogram of lengths from 1 to ``context``."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    used: list[int] = []  # lengths of the open packs, in order
    done: list[tuple[int, tuple[int, ...]]] = []

    def add(count: int, pack: tuple[int, ...]) -> None:
        total = sum(pack)
        if total == context:
            done.append((count, pack))
            return
        if total not in open_packs:
            open_packs[total] = []
            insort(used, total)
        open_packs[total].append((count, pack))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not used or used[0] + length > context:
                add(left, (length,))
                break
            total = used[0]
            count, pack = open_packs[total].pop()
            if not open_packs[total]:
                del open_packs[total]
                used.pop(0)
            take = min(count, left)
            if count > take:
                add(count - take, pack)
            add(take, (*pack, length))
            left -= take
    return done + [p for total in used for p in open_packs[total]]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) for each place in each pattern."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for count, pack in packs:
        offset = 0
        for length in pack:
            first = rank.get(length, 0)
            out.append((length, first, count, sequence, offset))
            rank[length] = first + count
            offset += length
        sequence += count
    return out


def ranked(cut: DataFrame, counts: DataFrame) -> DataFrame:
    """``cut`` with ``rank``, from 0 among the rows of the same length."""
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "row", "start")
    return cut.withColumn("rn", F.row_number().over(within)).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("rn") - 1).drop("base", "rn", "salt")


def pack(df: DataFrame, tokenizer: str, context: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = written(pieces(df, tokenizer, context, end_id, False, id_col, text_col), "pieces")
    n = cut.count()
    spread = max(1, n // RUN)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(spread)).cast("int"))
    counts = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = slots(patterns(histogram, context))
    table = df.sparkSession.createDataFrame(places or [(0, 0, 0, 0, 0)], "length long, first long, count long, sequence long, offset long")
    # The table's size depends on the context alone (a few places for each length), not on the corpus.
    table = F.broadcast(table) if len(places) <= 64 * context else table
    found = ranked(cut, counts).join(table, "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count")))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
