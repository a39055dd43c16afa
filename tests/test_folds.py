"""Greedy cuts of logs in many chunks: the same pieces as by plain loops, in tasks of one chunk each."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brinelog.operators import folds


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(folds, "CHUNK_ROWS", 16)
    monkeypatch.setattr(folds, "SAMPLE_ROWS", 2)


def plain_cuts(rows, limit, header, before):
    out = []
    for grp in sorted({r[0] for r in rows}):
        pieces, total = [[]], header
        for _, at, size in sorted(r for r in rows if r[0] == grp):
            if before and pieces[-1] and total + size > limit:
                pieces, total = [*pieces, []], header
            pieces[-1].append((at, size))
            total += size
            if not before and total >= limit:
                pieces, total = [*pieces, []], header
        out += [(grp, i, p[0][0], p[-1][0], len(p), header + sum(size for _, size in p)) for i, p in enumerate(pieces) if p]
    return out


def test_states_between_chunks():
    rng = random.Random(1)
    for case in range(400):
        limit, header, before = rng.choice([1, 5, 30, 200, 10_000]), rng.choice([0, 8]), case % 2 == 0
        sizes = rng.choice([[3], [1, 2, 3, 4], [0, 1, 50], [40, 41]])
        rows = [(g, at, rng.choice(sizes)) for g in range(rng.choice([1, 3])) for at in range(rng.randrange(1, 90))]
        piece, got, lo = None, [], 0
        while lo < len(rows):
            hi = min(len(rows), lo + rng.randrange(1, 40))
            b = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[lo:hi], strict=True)], ["grp", "at", "bytes"])
            for cut in folds._cuts(iter([b]), limit, header, before, piece and list(piece), hi == len(rows)):
                got += zip(*(c.to_pylist() for c in cut.columns), strict=True)
            grp, at, size = (c.to_numpy() for c in b.columns)
            for a, z in folds._segments(grp):
                piece = folds._after(piece, int(grp[a]), folds._outcomes(at[a:z], size[a:z], limit, header, before), header, before, limit, 0)
            lo = hi
        assert got == plain_cuts(rows, limit, header, before), (case, limit, header, before, sizes)


@pytest.mark.parametrize("limit", [90, 700, 10**9])
@pytest.mark.parametrize("before", [True, False])
def test_cuts_in_many_chunks(spark, small_chunks, limit, before):
    rng = random.Random(limit)
    rows = [(g, at * 3 - 40, rng.randrange(30, 60)) for g, n in ((0, 300), (1, 1), (2, 2), (5, 200)) for at in range(n)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "grp long, seqno long, size long").repartition(3)
    cut = folds._fold(df, F.col("grp"), "seqno", F.col("size"), limit, 8, before)
    assert cut.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, cut.collect())) == plain_cuts(rows, limit, 8, before)


def test_rotation_sorts_no_more_than_a_chunk(spark, small_chunks):
    log = spark.range(2000).select((F.col("id") + 1).alias("seqno"), (F.col("id") % 7 + 40).alias("size"))
    cut = folds.memtable_rotations(log, F.col("size"), 500)
    assert cut.rdd.getNumPartitions() > 50
    want = [(p + 1, a, z, n, size) for _, p, a, z, n, size in plain_cuts([(0, r["seqno"], r["size"]) for r in log.collect()], 500, 0, False)]
    assert sorted(map(tuple, cut.collect())) == want


def test_blocks_of_runs_in_many_chunks(spark, small_chunks):
    keys = [(run, f"k{i * 37 % 1000:03d}é" if i % 3 else f"k{i * 37 % 1000:03d}") for run, n in ((1, 150), (2, 3), (3, 220)) for i in range(n)] + [(2, None)]
    df = spark.createDataFrame(keys, "run_id long, key string")
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + 17
    want, ordered = [], sorted(keys, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    for run in (1, 2, 3):
        mine = [k for r, k in ordered if r == run]
        want += [(g, p, a, n, b) for g, p, a, _, n, b in plain_cuts([(run, i + 1, len((k or "").encode()) + 17) for i, k in enumerate(mine)], 100, 0, False)]
    assert sorted(map(tuple, folds.block_layout(df, size, 100).collect())) == want


def plain_memtables(rows, limit):
    out, held, first, n = [], {}, 0, 0
    for at, key, size in sorted(rows):
        first, n = first if n else at, n + 1
        held[key] = size
        if sum(held.values()) >= limit:
            out.append((len(out) + 1, first, at, n, len(held), sum(held.values())))
            held, n = {}, 0
    return [*out, (len(out) + 1, first, at, n, len(held), sum(held.values()))] if n else out


def test_states_between_chunks_of_overwrites():
    rng = random.Random(2)
    for _ in range(600):
        limit, n_keys, sizes = rng.choice([1, 60, 300, 2000]), rng.choice([1, 3, 8, 60]), rng.choice([[40], [33, 40, 90], range(33, 200)])
        rows = [(at, rng.choice([None, *(f"k{i}" for i in range(n_keys))]), rng.choice(sizes)) for at in range(1, rng.randrange(2, 250))]
        batches, lo = [], 0
        while lo < len(rows):
            hi = lo + rng.randrange(1, 60)
            at, key, size = zip(*rows[lo:hi], strict=True)
            batches.append(pa.RecordBatch.from_pydict({"grp": pa.array([0] * len(at)), "at": pa.array(at), "key": pa.array(key, pa.string()), "bytes": pa.array(size)}))
            lo = hi
        got = []
        for chunk, (pieces, start, number) in folds._follow_overwrites(((i, folds._overwriting_outcomes(b, limit)) for i, b in enumerate(batches)), limit):
            for b in folds._overwritten(iter([batches[chunk].slice(start)]), limit, number, rest=False):
                pieces += zip(*(c.to_pylist() for c in b.columns), strict=True)
            got += pieces
        assert sorted(got) == plain_memtables(rows, limit)


@pytest.mark.parametrize(("limit", "n_keys"), [(2048, 1500), (500, 12), (10**6, 5)])
def test_overwriting_rotations_sort_no_more_than_a_chunk(spark, small_chunks, limit, n_keys):
    rng = random.Random(limit)
    rows = [(at * 2, f"user:{rng.randrange(n_keys)}", "v" * rng.randrange(30)) for at in range(1200)]
    log = spark.createDataFrame(rng.sample(rows, len(rows)), "seqno long, key string, value string")
    cut = folds.overwriting_rotations(log, limit)
    assert cut.rdd.getNumPartitions() > 50
    assert sorted(map(tuple, cut.collect())) == plain_memtables([(at, key, len(key) + len(value) + 32) for at, key, value in rows], limit)
