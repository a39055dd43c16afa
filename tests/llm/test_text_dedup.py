"""Substring, suffix and near-duplicate operators against brute force."""

import random

import numpy as np
import pytest
from helpers import awkward, classes, frame, prose, shingles, without_repeated_bytes, without_repeats

from brinelog.llm import common, simhash_forest, substring_dedup, suffix_dedup
from brinelog.llm.components import components

ROWS = [(r[0], r[1]) for r in awkward()]


def test_repeated_words(spark):
    got = sorted(map(tuple, substring_dedup.remove_repeats(frame(spark)).collect()), key=repr)
    assert got == sorted(without_repeats(ROWS), key=repr)


@pytest.mark.parametrize("shard", [64, 4 << 20])
def test_repeated_words_in_many_shards_and_blocks(spark, sf_dir, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(substring_dedup, "SHARD_WINDOWS", max(shard, 4000))
    monkeypatch.setattr(substring_dedup, "WIDTH", 1 << 12 if shard == 64 else 1 << 20)  # crowded counters lose nothing
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()))
    assert got == sorted(without_repeats(rows))


def thue_morse(n):
    """A word over a and b, and its complement: polynomial hashes modulo a power of two can't tell them apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_words_and_texts_that_polynomials_take_for_equal(spark):
    one, other = thue_morse(4096)
    plain = prose(12, 55).replace("\n", " ")
    rows = [(1, f"{plain} {one}"), (2, f"{plain} {other}"), (3, one), (4, other), (5, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(df).orderBy("doc_id").collect()] == [0] * 5
    got = {r["doc_id"]: r["class_id"] for r in simhash_forest.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}  # 1 and 2 share 8 of 10 word 5-grams
    rows = [(k, t, "xx", "s", 0, 7, 7, "w", 3, "c", 1, "z", 2, 9) for k, t in rows]
    check_repeated_bytes(spark, rows, 400)


def test_cleaned_keeps_columns_and_untouched_texts(spark):
    df = frame(spark)
    out = substring_dedup.cleaned(df)
    assert out.columns == df.columns
    texts = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (19, "  two  spaces   here \n  and\tthere ") in texts and 11 not in {i for i, _ in texts}


@pytest.mark.parametrize("hot", [1, 4096])
@pytest.mark.parametrize("length", [5, 13, 100])
def test_repeated_bytes(spark, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [r for r in awkward() if r[0] != 15]
    check_repeated_bytes(spark, rows, length)


def check_repeated_bytes(spark, rows, length):
    got = suffix_dedup.remove_repeated_bytes(frame(spark, rows), length).collect()
    want = without_repeated_bytes([(r[0], r[1]) for r in rows], length)
    assert sorted(((*r[:4], bytes(r["kept"])) for r in got), key=repr) == sorted(want, key=repr)
    short = without_repeated_bytes([(r[0], r[1]) for r in rows], suffix_dedup.probe_of(length))
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_repeated"]) for r in got), key=repr) == sorted((r[:3] for r in short), key=repr)


@pytest.mark.parametrize("hot", [2, 4096])
def test_400_repeated_bytes_in_many_blocks_and_tasks(spark, monkeypatch, hot):
    """Passages that many documents share in unlike surroundings, copies, a very long text (cut into slices) and one that repeats itself."""
    for name, size in (("HOT", hot), ("BLOCK_BYTES", 20_000), ("SORT_BYTES", 30_000), ("SLICE_BYTES", 7_000)):
        monkeypatch.setattr(suffix_dedup, name, size)
    passages = [prose(n, 30 + n) for n in (52, 60, 66, 80, 150)]
    rows = list(awkward())
    for k in range(60):
        text = " ".join([prose(40, 2000 + k), passages[k % 5], prose(30, 3000 + k), passages[(k // 5) % 5] if k % 3 else ""])
        rows += [(100 + k, text, *rows[0][2:])] * (2 if k % 10 == 0 else 1)
    long = prose(4000, 4000)
    rows += [(500, long + " " + passages[4] + " " + prose(2000, 4001), *rows[0][2:]), (501, long[3000:9000] + prose(50, 4002), *rows[0][2:]), (502, "ab" * 4000, *rows[0][2:])]
    check_repeated_bytes(spark, rows, 400)


def test_bucket_refinement_is_exact():
    rng = random.Random(3)
    for length in (1, 3, 8, 20, 400):
        probe = suffix_dedup.probe_of(length)
        parts = [bytes(rng.choices(b"ab", k=rng.randint(0, 600))) for _ in range(6)]
        parts += [parts[0], b"ab" * 300]
        raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
        end = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
        data = raw.tobytes()
        for size, got in zip((length, probe), suffix_dedup.refine(raw, end, np.ones(len(raw), bool), length, probe), strict=True):
            seen = {}
            for k in range(len(data)):
                if k + size <= end[k]:
                    seen.setdefault(data[k : k + size], []).append(k)
            want = {k for v in seen.values() if len(v) > 1 for k in v}
            assert set(np.flatnonzero(got).tolist()) == want


def test_near_duplicates(spark):
    rows = [r for r in ROWS if r[0] is not None]
    got = simhash_forest.near_duplicates(frame(spark)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got if r["doc_id"] is not None) == sorted(classes(rows))
    assert [r["class_id"] for r in got if r["doc_id"] is None] == [None, None]


def test_crowds_of_near_copies(spark, monkeypatch):
    """Families of copies that a quota of two partners can't link in one round, in tasks that hold few rows."""
    monkeypatch.setattr(simhash_forest, "QUOTA", 1)
    monkeypatch.setattr(simhash_forest, "CROWD", 8)
    monkeypatch.setattr(simhash_forest, "TASK", 50)
    rng = random.Random(1)
    rows, n = [], 0
    for family in range(4):
        base = prose(200, 100 + family).split(" ")
        for _ in range(30):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
            n += 1
            rows.append((n, " ".join(w)))
    rows += [(1000 + k, prose(50, 500 + k)) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in simhash_forest.near_duplicates(df).collect()}
    want = dict(classes(rows))
    assert sum(got[i] != want[i] for i in want) <= 2  # a forest finds pairs with the target probability


def test_more_texts_with_one_signature_than_a_node_takes(spark, monkeypatch):
    monkeypatch.setattr(simhash_forest, "CROWD", 5)
    monkeypatch.setattr(simhash_forest, "LEAF", 4)
    words = prose(60, 9).split()
    rows = [(k, (" " * (k + 1)).join(words)) for k in range(40)] + [(100 + k, prose(50, 900 + k)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash_forest.near_duplicates(df).collect())) == sorted(classes(rows))


def test_recall_on_documents(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = dict(classes(rows))
    got = {r["doc_id"]: r["class_id"] for r in simhash_forest.near_duplicates(docs).collect()}
    assert sum(got[i] != want[i] for i in want) <= 2
    kept = simhash_forest.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(got.values())


def test_plan_meets_target():
    for n in (0, 10, 1000, 10**6, 10**9):
        f = simhash_forest.plan(n)
        assert f.tries >= 1 and 0 <= f.depth <= 48


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)], "a long, b long")
    got = {r["id"]: r["class_id"] for r in components(links).collect()}
    assert got == {k: 0 for k in range(51)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def test_squeezing():
    for x in (np.zeros(0, np.uint64), np.array([3], np.uint64), np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)), np.array([5, 1, 2**63], np.uint64)):
        assert (common.expand(common.squeeze(x), "u8") == x).all()


@pytest.mark.parametrize("op", [substring_dedup.remove_repeats, substring_dedup.cleaned, suffix_dedup.remove_repeated_bytes, simhash_forest.near_duplicates, simhash_forest.one_of_each])
def test_empty_tables(spark, op):
    assert op(frame(spark, [])).count() == 0


def test_near_copies_within_a_crowd_of_one_template(spark):
    """More texts than a node takes share a template but aren't linked through each other; some have a near copy at 0.8 and more."""
    rng = random.Random(11)
    template = prose(160, 77).split()
    rows, pairs = [], []
    for k in range(2600):
        w = list(template)
        at = rng.randrange(146)
        w[at : at + 14] = [f"own{k}x{x}" for x in range(14)]
        rows.append((2 * k, " ".join(w)))
        if k % 6 == 0:
            for x in rng.sample([x for x in range(5, 155, 6) if not at - 5 <= x < at + 19], 3):
                w[x] = f"edit{k}x{x}"
            rows.append((2 * k + 1, " ".join(w)))
            a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
            assert 0.8 <= len(a & b) / len(a | b) < 0.84
            pairs.append(2 * k)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in simhash_forest.near_duplicates(df).collect()}
    missed = sum(got[i + 1] != got[i] for i in pairs)
    print("missed", missed, "of", len(pairs), "classes", len(set(got.values())))
    assert missed <= 0.01 * len(pairs)


def test_small_sets_at_the_threshold(spark):
    """Texts of 8 words and the same with one word more share 4 of 5 word 5-grams: exactly 0.8."""
    rng = random.Random(12)
    rows = []
    for k in range(2000):
        w = [f"w{rng.randrange(10**9)}" for _ in range(9)]
        rows += [(2 * k, " ".join(w[:8])), (2 * k + 1, " ".join(w))]
    got = {r["doc_id"]: r["class_id"] for r in simhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = sum(got[2 * k + 1] != 2 * k for k in range(2000))
    print("missed", missed)
    assert missed <= 20 and all(got[2 * k] == 2 * k for k in range(2000))


def test_plan_follows_sizes():
    chance = simhash_forest.chances_by_size(0.8)
    assert chance[4] == chance[5] == pytest.approx(0.1875) and chance[3] == 0
    rng = np.random.default_rng(3)
    for n, m, both in ((4, 5, 4), (12, 15, 12), (64, 71, 60), (33, 30, 28)):
        h = rng.integers(0, 2**63, n + m - both).astype(np.uint64)
        sets = np.concatenate([h[:n], h[n - both :]])
        s = simhash_forest.simhash(sets, np.array([0, n, n + m]), 1 << 14)
        assert np.bitwise_count(s[0] ^ s[1]).sum() / (1 << 14) == pytest.approx(simhash_forest.differing(n, m, 0.8), abs=0.02)


def test_one_row_of_each_class_with_repeated_and_null_ids(spark):
    one, other, third = prose(80, 701), prose(80, 702), prose(80, 703)
    rows = [(1, one, "a"), (1, one, "b"), (None, one, "c"), (1, other, "d"), (2, one, "e"), (None, third, "f"), (None, third, "g"), (3, other, "h"), (4, None, "i"), (None, "", "j")]
    kept = simhash_forest.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _row string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(1, one), (1, other), (None, third), (4, None)], key=repr)
