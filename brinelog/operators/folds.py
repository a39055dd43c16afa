"""Greedy cuts of an ordered log: segments, memtables and blocks.

Where a piece begins depends on where the one before it ended, which no window function
says.  So the ordered log is divided into chunks of about ``CHUNK_ROWS`` rows.  Each chunk is
summed up, in parallel, as a map from what is open before it to what is open after it; one
task follows these maps from chunk to chunk; then each chunk is cut, in parallel, from the
state so found.  No task sorts or holds more than a chunk.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUT = "grp long, piece long, first_at long, last_at long, n long, bytes long"
#: Rows of a chunk, about; chunks are bounded by one row in so many, drawn by hash.
CHUNK_ROWS, SAMPLE_ROWS = 1 << 19, 1 << 13


def _bounds(rows: DataFrame) -> list[tuple[int, object]]:
    """First (grp, at) of each chunk but the first one.  The same rows always give the same ones."""
    drawn = rows.select("grp", "at").where(F.pmod(F.xxhash64("grp", "at"), F.lit(SAMPLE_ROWS)) == 0).where("at IS NOT NULL").collect()
    step = max(1, CHUNK_ROWS // SAMPLE_ROWS)
    return sorted({(r["grp"], r["at"]) for r in sorted(drawn)[step::step]})


def _chunked(rows: DataFrame, bounds: list[tuple[int, object]]) -> DataFrame:
    """Rows (grp, at, ...) in partitions of one chunk each, in order, with ``chunk`` as first column: the number of bounds that aren't after the row."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        grp, at = bounds[(lo + hi) // 2]
        reached = (F.col("grp") > grp) | ((F.col("grp") == grp) & (F.col("at") >= F.lit(at)))
        return F.when(reached, between((lo + hi) // 2 + 1, hi)).otherwise(between(lo, (lo + hi) // 2))

    placed = rows.select(between(0, len(bounds)).alias("chunk"), *rows.columns)
    return placed.repartitionById(len(bounds) + 1, F.col("chunk")).sortWithinPartitions("chunk", "grp", "at", "bytes")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each chunk with its other columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        ids = b.column(0).to_numpy()
        for lo, hi in _segments(ids):
            if held and held[0].column(0)[0].as_py() != ids[lo]:
                yield _joined(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[int, pa.RecordBatch]:
    whole = pa.Table.from_batches(held).combine_chunks()
    return whole.column(0)[0].as_py(), pa.RecordBatch.from_arrays([c.chunk(0) for c in whole.columns[1:]], whole.column_names[1:])


def _segments(grp: np.ndarray) -> list[tuple[int, int]]:
    """(first, after last) of each run of equal values."""
    ends = [*(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)] if len(grp) else []
    return list(zip([0, *ends], ends, strict=False))


def _states(chunks: DataFrame, summary: Callable[[pa.RecordBatch], object], follow: Callable[[Iterator[tuple[int, object]]], Iterator[tuple[int, object]]]) -> list[tuple[int, object]]:
    """What ``follow`` finds from the summaries of all chunks, in their order."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, b in _whole(batches):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "data": [pickle.dumps(summary(b))]})

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ((c, pickle.loads(d)) for b in batches for c, d in zip(b.column(0).to_pylist(), b.column(1), strict=True) for d in [d.as_py()])
        for chunk, state in follow(read):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "data": [pickle.dumps(state)]})

    kind = "chunk int, data binary"
    one = chunks.mapInArrow(summed, kind).repartition(1).sortWithinPartitions("chunk").mapInArrow(followed, kind)
    return [(r["chunk"], pickle.loads(r["data"])) for r in one.collect()]


def _ends(jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the jumps from each place end, and their number; a place that jumps to itself is an end."""
    count = (jump != np.arange(len(jump))).astype(np.int64)
    while True:
        ahead = jump[jump]
        if np.array_equal(ahead, jump):
            return jump, count
        count, jump = count + count[jump], ahead


def _cuts(batches: Iterator[pa.RecordBatch], limit: int, header: int, before: bool, piece: list[int] | None = None, rest: bool = True) -> Iterator[pa.RecordBatch]:
    """Pieces of (grp, at, bytes) rows.  before: a piece ends before the row that would pass the limit, else after the row that reaches it.

    piece: what is open before the first row.  rest: whether what is open after the last row is a piece.
    """
    names = ["grp", "piece", "first_at", "last_at", "n", "bytes"]

    for b in batches:
        done: list[list[int]] = []
        grp, at, size = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        sums = np.concatenate([[0], np.cumsum(size)])
        lo = 0
        for hi in [*(np.flatnonzero(np.diff(grp)) + 1), len(grp)] if len(grp) else []:
            if piece is None or piece[0] != grp[lo]:
                if piece is not None:
                    done.append(piece)
                piece = [int(grp[lo]), 0, 0, 0, 0, header]
            while lo < hi:
                goal = sums[lo] + limit - piece[5]
                if before:
                    take = int(np.searchsorted(sums, goal, side="right")) - 1 - lo
                    if take < 1 and piece[4]:
                        done.append(piece)
                        piece = [piece[0], piece[1] + 1, 0, 0, 0, header]
                        continue
                else:
                    take = int(np.searchsorted(sums, goal, side="left")) - lo
                take = min(max(take, 1), hi - lo)
                if not piece[4]:
                    piece[2] = int(at[lo])
                piece[3] = int(at[lo + take - 1])
                piece[4] += take
                piece[5] += int(sums[lo + take] - sums[lo])
                lo += take
                if not before and piece[5] >= limit:
                    done.append(piece)
                    piece = [piece[0], piece[1] + 1, 0, 0, 0, header]
        done = [d for d in done if d[4]]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*done, strict=True)], names)
    if rest and piece is not None and piece[4]:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in piece], names)


def _numbered(batches: Iterator[pa.RecordBatch], last: int | None = None, count: int = 0) -> Iterator[pa.RecordBatch]:
    """(grp, at, bytes) with the place within its group, from 1, instead of ``at``.  count: rows of group ``last`` before."""
    for b in batches:
        if b.num_rows:
            grp = b.column(0).to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
            place = np.arange(1, len(grp) + 1) - np.repeat(heads, np.diff(np.append(heads, len(grp))))
            if grp[0] == last:
                place[: heads[1] if len(heads) > 1 else None] += count
            last, count = grp[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place), b.column(2)], ["grp", "at", "bytes"])


def _outcomes(at: np.ndarray, size: np.ndarray, limit: int, header: int, before: bool) -> dict[str, object]:
    """What rows of one group do to any piece that is open before them.

    ``to``: by bytes that fit into that piece, the next cuts: how many, and what is open after the last one.
    ``fresh``: the same for a piece that begins with these rows.
    """
    n, sums = len(size), np.concatenate([[0], np.cumsum(size)])
    here = np.arange(n)
    if before:
        ends = np.maximum(np.searchsorted(sums, sums[:-1] + limit - header, side="right") - 1, here + 1)
        jump = np.append(np.where(ends < n, ends, here), n)
        most = int(np.searchsorted(sums, limit - header, side="right")) - 1
        starts = np.arange(0, min(max(most, 0), n - 1) + 1)
    else:
        ends = np.maximum(np.searchsorted(sums, sums[:-1] + limit - header, side="left"), here + 1)
        jump = np.append(np.where(ends <= n, ends, here), n)
        starts = np.arange(1, min(max(int(np.searchsorted(sums, limit - header, side="left")), 1), n) + 1)
    end, cuts = _ends(jump)
    opened = lambda q: np.stack([np.append(at, 0)[q], n - q, sums[-1] - sums[q]])
    differs = (end[starts[1:]] != end[starts[:-1]]) | (cuts[starts[1:]] != cuts[starts[:-1]])
    kept = starts[np.append(True, differs)] if before else starts[np.append(differs, True)]
    return {"n": n, "bytes": int(sums[-1]), "last_at": int(at[-1]), "fits": sums[kept], "cuts": cuts[kept], "to": opened(end[kept]), "fresh": (int(cuts[0]), opened(end[:1]))}


def _after(piece: list[int] | None, grp: int, rows: dict, header: int, before: bool, limit: int, shift: int) -> list[int]:
    """The piece that is open after these rows of a group.  shift: what their ``at`` lacks."""
    if piece is not None and piece[0] == grp and piece[4]:
        fit = limit - piece[5]
        if rows["bytes"] <= fit if before else rows["bytes"] < fit:
            return [grp, piece[1], piece[2], rows["last_at"] + shift, piece[4] + rows["n"], piece[5] + rows["bytes"]]
        i = max(int(np.searchsorted(rows["fits"], fit, side="right")) - 1, 0) if before else int(np.searchsorted(rows["fits"], fit, side="left"))
        number, (first_at, n, size) = piece[1] + 1 + int(rows["cuts"][i]), rows["to"][:, i].tolist()
    else:
        number, (first_at, n, size) = (piece[1] if piece is not None and piece[0] == grp else 0) + rows["fresh"][0], rows["fresh"][1][:, 0].tolist()
    return [grp, number, first_at + shift if n else 0, rows["last_at"] + shift if n else 0, n, header + size]


def _fold(rows: DataFrame, grp: Column, at: str, size: Column, limit: int, header: int, before: bool, places: bool = False) -> DataFrame:
    narrow = rows.select(grp.cast("long").alias("grp"), F.col(at).alias("at") if places else F.col(at).cast("long").alias("at"), size.cast("long").alias("bytes"))
    bounds = _bounds(narrow)
    if not bounds:
        ordered = narrow.repartition("grp").sortWithinPartitions("grp", "at", "bytes")
        return ordered.mapInArrow(lambda it: _cuts(_numbered(it) if places else it, limit, header, before), CUT)
    chunks = _chunked(narrow, bounds)

    def summary(b: pa.RecordBatch) -> list[tuple[int, dict]]:
        grp, at, size = next(_numbered(iter([b]))).columns if places else b.columns
        grp, at, size = grp.to_numpy(), at.to_numpy(), size.to_numpy()
        spans = _segments(grp)
        return [(int(grp[lo]), _outcomes(at[lo:hi], size[lo:hi], limit, header, before)) for lo, hi in (spans if len(spans) < 2 else [spans[0], spans[-1]])]

    def follow(summaries: Iterator[tuple[int, list[tuple[int, dict]]]]) -> Iterator[tuple[int, object]]:
        piece, count = None, 0
        for chunk, parts in summaries:
            yield chunk, (piece, count)
            for grp, part in parts:
                count = count if piece is not None and piece[0] == grp else 0
                piece = _after(piece, grp, part, header, before, limit, count if places else 0)
                count += part["n"]

    states = _states(chunks, summary, follow)
    state, final = dict(states), max((c for c, _ in states), default=0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, b in _whole(batches):
            piece, count = state[chunk]
            numbered = _numbered(iter([b]), piece and piece[0], count) if places else iter([b])
            yield from _cuts(numbered, limit, header, before, piece and list(piece), chunk == final)

    return chunks.mapInArrow(cut, CUT)


def wal_segments(log: DataFrame, record_size: Column, roll_bytes: int, header: int = 8) -> DataFrame:
    """Segments of a log that rolls before a record would pass ``roll_bytes``: segment, first_seqno, last_seqno, records, bytes."""
    cut = _fold(log, F.lit(0), "seqno", record_size, roll_bytes, header, True)
    return cut.select((F.col("piece") + 1).alias("segment"), F.col("first_at").alias("first_seqno"), F.col("last_at").alias("last_seqno"), F.col("n").alias("records"), "bytes")


def memtable_rotations(log: DataFrame, slot_size: Column, max_bytes: int) -> DataFrame:
    """Memtables of a log of distinct keys: one is frozen once it holds ``max_bytes``."""
    cut = _fold(log, F.lit(0), "seqno", slot_size, max_bytes, 0, False)
    return cut.select((F.col("piece") + 1).alias("memtable"), F.col("first_at").alias("first_seqno"), F.col("last_at").alias("last_seqno"), F.col("n").alias("entries"), "bytes")


def _overwritten(batches: Iterator[pa.RecordBatch], max_bytes: int, number: int = 1, rest: bool = True) -> Iterator[pa.RecordBatch]:
    """Memtables of (grp, at, key, bytes) rows.  rest: whether what is open after the last row is one."""
    held: dict[str | None, int] = {}
    total, first, last, n = 0, 0, 0, 0
    names = ["memtable", "first_seqno", "last_seqno", "writes", "entries", "bytes"]
    for b in batches:
        done = []
        for seqno, key, size in zip(*(c.to_pylist() for c in b.columns[-3:]), strict=True):
            if not n:
                first = seqno
            n += 1
            last = seqno
            total += size - held.get(key, 0)
            held[key] = size
            if total >= max_bytes:
                done.append((number, first, last, n, len(held), total))
                held, total, n, number = {}, 0, 0, number + 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*done, strict=True)], names)
    if rest and n:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (number, first, last, n, len(held), total)], names)


def _overwriting_outcomes(b: pa.RecordBatch, max_bytes: int) -> dict[str, object]:
    """What rows (grp, at, key, bytes) do to any memtable that is open before them.

    ``events``: (row, whether its key is new here, key, bytes of these rows up to there) of each row that may end it: after others the bytes are no
    more than before, whatever was held.  ``cuts`` and ``opens``: what follows if it ends before the first row or after that of each event - the
    memtables that end here too, and the row with which the open one begins.  ``tail``: (row, key, bytes) of the newest versions that these hold.
    The number of keys in all this is bounded by ``max_bytes``.
    """
    encoded = b.column("key").dictionary_encode(null_encoding="encode")
    keys, code, size = encoded.dictionary.to_pylist(), encoded.indices.to_numpy(), b.column("bytes").to_pylist()
    n = len(size)
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    after, prior = np.full(n, n), np.full(n, -1)
    after[order[:-1][same]], prior[order[1:][same]] = order[1:][same], order[:-1][same]
    following, before, codes = after.tolist(), prior.tolist(), code.tolist()

    # fewer rows hold no more, so the end of the memtable that begins at ``at`` never moves back as ``at`` grows
    jump, end, total = list(range(n + 1)), 0, 0
    for at in range(n):
        while end < n and (end == at or total < max_bytes):
            total += size[end] - (size[before[end]] if before[end] >= at else 0)
            end += 1
        if total < max_bytes:
            break
        jump[at] = end
        if following[at] >= end:
            total -= size[at]

    events, total, most = [], 0, -1
    for i in range(n):
        total += size[i] - (size[before[i]] if before[i] >= 0 else 0)
        if before[i] < 0 or total > most:
            most = total
            events.append((i, before[i] < 0, keys[codes[i]], total))
        if total >= max_bytes:
            break

    ends, cuts = _ends(np.array(jump))
    starts = [0, *(e[0] + 1 for e in events)]
    opens, seqno = ends[starts], np.append(b.column("at").to_numpy(), 0)
    least = int(opens.min())
    tail = [(i, keys[codes[i]], size[i]) for i in (np.flatnonzero(after[least:] >= n) + least).tolist()]
    return {"n": n, "last": int(seqno[n - 1]), "events": events, "ended": seqno[[e[0] for e in events]].tolist(), "cuts": cuts[starts].tolist(), "opens": opens.tolist(), "firsts": seqno[opens].tolist(), "tail": tail}


def _follow_overwrites(summaries: Iterator[tuple[int, dict]], max_bytes: int) -> Iterator[tuple[int, tuple]]:
    """For each chunk the memtables to report besides those that begin and end in it, the row from which those begin, and the number of the first."""
    held: dict[str | None, int] = {}
    first, last, n, number, found = 0, 0, 0, 1, None
    for chunk, rows in summaries:
        if found:
            yield found
        taken, start, pieces = 0, 0, []
        if n:
            kept, left, new, taken = sum(held.values()), len(held), 0, None
            for k, (i, is_new, key, total) in enumerate(rows["events"]):
                if is_new:
                    new += 1
                    if key in held:
                        kept, left = kept - held[key], left - 1
                if total + kept >= max_bytes:
                    pieces = [(number, first, rows["ended"][k], n + i + 1, left + new, total + kept)]
                    number, taken, start = number + 1, k + 1, i + 1
                    break
        if taken is None:  # nothing ends here, so the tail is all that these rows hold
            start, n = rows["n"], n + rows["n"]
            held |= {key: size for _, key, size in rows["tail"]}
            found = chunk, (pieces, start, number)
        else:
            found = chunk, (pieces, start, number)
            opened = rows["opens"][taken]
            number, n, first = number + rows["cuts"][taken], rows["n"] - opened, rows["firsts"][taken]
            held = {key: size for i, key, size in rows["tail"] if i >= opened}
        last = rows["last"]
    if found:
        chunk, (pieces, start, begun) = found
        yield chunk, ([*pieces, (number, first, last, n, len(held), sum(held.values()))] if n else pieces, start, begun)


def overwriting_rotations(log: DataFrame, max_bytes: int, slot: int = 32) -> DataFrame:
    """Memtables of a log that overwrites keys: a value that replaces another one gives its bytes back.

    Needs the keys of the open memtable as state; that is bounded by ``max_bytes``.
    """
    kind = "memtable long, first_seqno long, last_seqno long, writes long, entries long, bytes long"
    size = F.octet_length("key") + F.octet_length("value") + slot
    narrow = log.select(F.lit(0).cast("long").alias("grp"), F.col("seqno").cast("long").alias("at"), "key", size.cast("long").alias("bytes"))
    bounds = _bounds(narrow)
    if not bounds:
        return narrow.repartition(1).sortWithinPartitions("at").mapInArrow(lambda it: _overwritten(it, max_bytes), kind)
    chunks = _chunked(narrow, bounds)
    state = dict(_states(chunks, lambda b: _overwriting_outcomes(b, max_bytes), lambda it: _follow_overwrites(it, max_bytes)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, b in _whole(batches):
            pieces, start, number = state[chunk]
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pieces, strict=True)], ["memtable", "first_seqno", "last_seqno", "writes", "entries", "bytes"])
            yield from _overwritten(iter([b.slice(start)]), max_bytes, number, rest=False)

    return chunks.mapInArrow(cut, kind)


def block_layout(runs: DataFrame, entry_size: Column, block_size: int) -> DataFrame:
    """Blocks of each sorted run: one is closed once it holds ``block_size``.  Runs are laid out in parallel."""
    cut = _fold(runs, F.col("run_id"), "key", entry_size, block_size, 0, False, places=True)
    return cut.select(F.col("grp").alias("run_id"), F.col("piece").alias("block"), F.col("first_at").alias("first_place"), F.col("n").alias("entries"), "bytes")


def restart_points(runs: DataFrame, interval: int = 16) -> DataFrame:
    """Every ``interval``-th key of each run."""
    order = Window.partitionBy("run_id").orderBy("key")
    placed = runs.select("run_id", "key", (F.row_number().over(order) - 1).alias("place"))
    return placed.where(F.pmod("place", F.lit(interval)) == 0)


def seek(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """(run_id, wanted, seek_key): the last restart point at or before each wanted key in each run, by one ordered pass per run."""
    asked = points.select("run_id").distinct().join(wanted.select("key").distinct(), F.lit(True))
    both = points.select("run_id", "key", F.lit(0).alias("kind")).unionByName(asked.withColumn("kind", F.lit(1)))
    order = Window.partitionBy("run_id").orderBy("key", "kind")
    found = both.withColumn("seek_key", F.last(F.when(F.col("kind") == 0, F.col("key")), ignorenulls=True).over(order))
    return found.where("kind = 1 AND seek_key IS NOT NULL").select("run_id", F.col("key").alias("wanted"), "seek_key")
