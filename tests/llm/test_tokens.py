"""Tokenizing operators against their libraries."""

import random
import zlib

import numpy as np
import pytest
from helpers import awkward, frame

from brinelog.llm import packing, piece_codec, token_counts
from brinelog.llm.registry import tokenizer_path

PIECES, BYTES = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")
ROWS = [(r[0], r[1]) for r in awkward()]


def test_pieces_as_the_library(spark):
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=PIECES)
    got = piece_codec.decode(piece_codec.encode(frame(spark), PIECES), PIECES).collect()
    assert len(got) == len(ROWS)
    want = {(i, tuple(sp.encode(t or "")), sp.decode(sp.encode(t or "")) if t else "") for i, t in ROWS}
    assert {(r["doc_id"], tuple(r["ids"]), r["text"]) for r in got} == want
    assert piece_codec.encode(frame(spark, []), PIECES).count() == 0


def test_random_texts_and_ids():
    import sentencepiece as spm

    sp, table, rng = spm.SentencePieceProcessor(model_file=PIECES), piece_codec.PrefixTable(PIECES), random.Random(2)
    for _ in range(1500):
        x = "".join(rng.choices(" \n\t▁abcdeghénrst123中梦😀<>s/\x00\x01.,", k=rng.randint(0, 50)))
        assert table.encode(x).tolist() == sp.encode(x), x
        ids = [rng.choice([0, 1, 2, 3 + 0xE2, 3 + 0x81, 3 + 0x20, 29871, 259, rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert table.decode(np.array(ids, dtype=np.int32)).decode() == sp.decode(ids), ids


def test_parts_of_long_texts(monkeypatch):
    table = piece_codec.PrefixTable(PIECES)
    text = ROWS[15][1] + "  x \n y   " + ROWS[0][1]
    whole = table.encode(text).tolist()
    monkeypatch.setattr(piece_codec, "PART", 100)
    monkeypatch.setattr(piece_codec, "CACHE", 50)
    assert table.encode(text).tolist() == whole


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES).encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("run", [10, 200_000])
def test_packing(spark, monkeypatch, run):
    monkeypatch.setattr(packing, "RUN", run)
    got = packing.pack(frame(spark), BYTES, context=256).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    want = {}
    for i, t in ROWS:
        ids = ids_of(t)
        want.setdefault((i, len(ids)), []).append(ids)
    assert by_doc.keys() == want.keys()
    for key, rs in by_doc.items():
        expected = sorted((k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], dtype="<u4").tobytes())) for ids in want[key] for k in range(0, len(ids), 256))
        assert sorted((r["start"], r["length"], r["ids_crc32"]) for r in rs) == expected
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(frame(spark, []), BYTES).count() == 0


def test_patterns_cover_the_histogram():
    rng = random.Random(4)
    for _ in range(20):
        h = {rng.randint(1, 64): rng.randint(1, 10**6) for _ in range(30)}
        packs = packing.patterns(h, 64)
        back = {}
        for n, pack in packs:
            assert n > 0 and sum(pack) <= 64
            for x in pack:
                back[x] = back.get(x, 0) + n
        assert back == h
    assert packing.patterns({}, 64) == []
    # shortest pack first: the 3 goes to the pack of 5, not to that of 6
    assert sorted(packing.patterns({6: 1, 5: 1, 3: 1}, 9)) == [(1, (5, 3)), (1, (6,))]


def test_ledger(spark):
    cols = "doc_id long, op string, text string, source string, lang string, change_no long, sign int"
    ledger = token_counts.Ledger(spark)
    n = lambda t: len(ids_of(t)) - 1
    batch = lambda *rows: spark.createDataFrame([(*r, 0) for r in rows], cols)
    first = batch((1, "insert", "one two", "a", "en", 1), (2, "insert", None, "a", None, 1), (3, "insert", "three", None, "en", 1), (None, "insert", "lost", "a", "en", 1))
    assert ledger.commit("b1", first, BYTES, "v1") and not ledger.commit("b1", first, BYTES, "v1")
    totals = lambda: {tuple(r[k] for k in ("source", "lang", "tokenizer")): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}
    assert totals() == {("a", "en", "v1"): (2, n("one two") + n("lost")), ("a", None, "v1"): (1, 0), (None, "en", "v1"): (1, n("three"))}
    ledger.compact()
    ledger.commit("b2", batch((1, "revise", "longer text now", "b", "en", 2), (1, "revise", "older", "b", "en", 1), (3, "delete", None, None, None, 1), (9, "delete", None, None, None, 1), (4, "revise", "new", "a", "en", 1)), BYTES, "v1")
    ledger.commit("b3", batch((1, "insert", "one two", "a", "en", 1)), BYTES, "v2")
    want = {("a", "en", "v1"): (2, n("lost") + n("new")), ("a", None, "v1"): (1, 0), ("b", "en", "v1"): (1, n("longer text now")), ("a", "en", "v2"): (1, n("one two"))}
    assert totals() == want
    ledger.compact()
    assert totals() == want and ledger.batches() == ["b1", "b2", "b3"]
    ledger.commit("b4", batch(), BYTES, "v1")
    assert totals() == want
    ledger.compact()
    assert totals() == want and {(r["doc_id"], r["source"]) for r in ledger.live().collect()} == {(None, "a"), (1, "a"), (1, "b"), (2, "a"), (4, "a")}
    ledger.commit("b6", batch((4, "delete", None, None, None, 1)), BYTES, "v1")
    want["a", "en", "v1"] = (1, n("lost"))
    assert totals() == want
    with pytest.raises(Exception, match="op must be"):
        ledger.commit("b5", batch((1, "upsert", "x", "a", "en", 1)), BYTES, "v1")
    assert totals() == want and token_counts.Ledger(spark).totals().count() == 0


def test_a_commit_in_between_is_noticed(spark, monkeypatch):
    ledger, one = token_counts.Ledger(spark), spark.createDataFrame([(1, "insert", "one", "a", "en")], "doc_id long, op string, text string, source string, lang string")
    known, asked = ledger.batches, []
    monkeypatch.setattr(ledger, "batches", lambda: asked.append(1) or (known() + ["other"] if len(asked) > 2 else known()))
    with pytest.raises(RuntimeError, match="send it again"):
        ledger.commit("mine", one, BYTES, "v1")
    assert known() == []


def test_ledger_without_change_numbers(spark):
    cols = "doc_id long, op string, text string, source string, lang string"
    n = lambda t: len(ids_of(t)) - 1
    ledger = token_counts.Ledger(spark)
    rows = [(1, "insert", "one two", "a", "en"), (1, "insert", "some more words", "a", "en"), (2, "insert", "three", "a", "en"), (2, "delete", "three", "a", "en"), (None, "insert", "x", "a", "en"), (None, "insert", "x", "a", "en")]
    ledger.commit("b1", spark.createDataFrame(rows, cols), BYTES, "v1")
    assert [(r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()] == [(4, n("some more words") + n("three") + 2 * n("x"))]
    ledger.commit("b2", spark.createDataFrame([(1, "delete", None, "a", "en"), (2, "delete", None, "a", "en")], cols), BYTES, "v1")
    assert [(r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()] == [(2, 2 * n("x"))]


def test_counts_query_deletes_and_revises_the_whole_table(spark, sf_dir, monkeypatch):
    from brinelog.llm.registry import QUERIES

    ledgers = []
    start = token_counts.Ledger.__init__
    monkeypatch.setattr(token_counts.Ledger, "__init__", lambda self, *x: (start(self, *x), ledgers.append(self))[0])
    got = {tuple(r[:3]): (r["n_docs"], r["n_tokens"]) for r in QUERIES["op1_token_counts"](spark, sf_dir).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        docs, tokens = want.get((r["source"], r["lang"], "byte_bpe_50k"), (0, 0))
        want[r["source"], r["lang"], "byte_bpe_50k"] = docs + 1, tokens + len(ids_of(r["text"])) - 1
    assert got == want
    signs = {(b, r["sign"]): r["count"] for b in ledgers[0].batches() for r in ledgers[0]._read("rows", token_counts.ROWS, [b]).groupBy("sign").count().collect()}
    n = sum(d for d, _ in want.values())
    assert signs == {("load", 1): n, ("revise", 1): n, ("revise", -1): n, ("delete", -1): n, ("reinsert", 1): n}
