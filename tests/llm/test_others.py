"""Quality rules, language, chats, vectors and the pipeline."""

import glob
import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import awkward, classes, frame, prose, without_repeats, words_of
from pyspark.sql import functions as F

import corpus_pipeline
from brinelog.llm import chat_format, language_id, quality_rules, vector_search
from brinelog.llm.registry import QUERIES, SQL

ROWS = [(r[0], r[1]) for r in awkward()]


def plain(v):
    return None if v is None else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, rel = QUERIES[name](spark, sf_dir), con.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())


def measured(text):
    w, text = words_of(text), text or ""
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    twice = {i for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for i in range(k, k + 5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice)


def test_measures_and_verdicts(spark):
    df = frame(spark)
    got = quality_rules.judge(df).collect()
    assert sorted(((r["doc_id"], *(r[c] for c in quality_rules.MEASURES[:5])) for r in got), key=repr) == sorted(((i, *measured(t)) for i, t in ROWS), key=repr)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and 0 <= r["p_good"] <= 1
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)
    good = quality_rules.good(df)
    assert good.columns == df.columns and sorted(r["doc_id"] or 0 for r in good.collect()) == sorted(r["doc_id"] or 0 for r in got if r["kept"])
    assert quality_rules.judge(frame(spark, [])).count() == 0 and quality_rules.good(frame(spark, [])).count() == 0


def test_em_as_in_numpy(spark):
    rng = np.random.default_rng(1)
    m = len(quality_rules.RULES)
    votes = [[int(x) for x in (rng.random(m) < (0.6 if rng.random() < 0.2 else 0.03)) * -2 + 1] for _ in range(500)]
    votes = [[0 if rng.random() < 0.1 else v for v in row] for row in votes]
    p = quality_rules.fit(spark.createDataFrame([(v,) for v in votes], "votes array<int>"))
    v = np.array(votes)
    share, on_good, on_bad = 0.9, np.full(m, 0.02), np.full(m, 0.4)
    for _ in range(quality_rules.STEPS):
        logit = np.log(share / (1 - share)) + np.where(v == 1, np.log((1 - on_good) / (1 - on_bad)), np.where(v == -1, np.log(on_good / on_bad), 0)).sum(axis=1)
        q = 1 / (1 + np.exp(-logit))
        share = (9 + q.sum()) / (10 + len(q))
        weight = 10 + quality_rules.PRIOR * len(v)
        rate = lambda w, s: (weight * s + (w[:, None] * (v == -1)).sum(axis=0)) / (weight + (w[:, None] * (v != 0)).sum(axis=0))  # noqa: B023, E731
        on_good, on_bad = rate(q, 0.02), rate(1 - q, 0.4)
    assert p["share"][0] == pytest.approx(share) and p["on_good"] == pytest.approx(list(on_good)) and p["on_bad"] == pytest.approx(list(on_bad))


def test_useless_and_inverted_rules_are_learnt_as_such(spark):
    rng = np.random.default_rng(4)
    m = len(quality_rules.RULES)
    bad = rng.random(4000) < 0.2
    chance = np.where(bad[:, None], 0.7, 0.03) * np.ones(m)
    chance[:, 2], chance[:, 5] = 0.3, np.where(bad, 0.03, 0.6)
    votes = [[int(x) for x in row] for row in (rng.random((4000, m)) < chance) * -2 + 1]
    p = quality_rules.fit(spark.createDataFrame([(v,) for v in votes], "votes array<int>"))
    assert abs(p["on_good"][2] - 0.3) < 0.05 and abs(p["on_bad"][2] - 0.3) < 0.05
    assert abs(p["on_good"][5] - 0.6) < 0.05 and p["on_bad"][5] < 0.1
    assert abs(p["share"][0] - 0.8) < 0.03 and all(abs(p["on_bad"][k] - 0.7) < 0.07 and p["on_good"][k] < 0.06 for k in (0, 1, 3, 4, 6, 7, 8, 9))


def test_quality_follows_labels(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in QUERIES["op6_quality_rules"](spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    assert all(not kept[r["doc_id"]][0] for r in labels if r["quality"] == 0)
    assert all(kept[r["doc_id"]][0] or kept[r["doc_id"]][1] for r in labels if r["quality"] == 1)


def test_language(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out(F.col("doc_id"))).collect()
    assert len(got) > 250 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97 and np.mean([r["accepted"] for r in got]) > 0.97
    odd = language_id.identify(frame(spark), model).collect()
    want = {i: not any(c.isalpha() for c in t or "") for i, t in ROWS if i is not None}
    assert len(odd) == len(ROWS) and all((r["lang_pred"] == "und") == want[r["doc_id"]] for r in odd if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and not (r["lang_pred"] == "und" and r["accepted"]) for r in odd)
    one = model.logits([docs.first()["text"]])
    assert (model.logits([docs.first()["text"], "other text"])[0] == one[0]).all()
    kept = language_id.accepted(frame(spark), model)
    assert kept.columns == frame(spark).columns and kept.count() == sum(r["accepted"] for r in odd)
    nothing = language_id.fit(frame(spark, []))
    assert {r["lang_pred"] for r in language_id.identify(frame(spark), nothing).collect()} == {"und"}


def plain_buckets(text):
    """The buckets of a text's n-grams, one by one."""
    c = [ord(x) if x.isalpha() else 0 for x in f" {text.lower()} "]
    out = []
    for n in range(1, 5):
        for k in range(len(c) - n + 1):
            w = c[k : k + n]
            if all(w[1:-1]) if n > 2 else any(w):
                h = w[0] * 0x9E3779B1 % 2**32
                for m in range(2, n + 1):
                    h = ((h ^ w[m - 1]) * 0x9E3779B1 + m) % 2**32
                out.append((h ^ h >> 15 if n > 1 else h) >> 16)
    return out


def test_language_scores_as_written_plainly(spark):
    rng = np.random.default_rng(8)
    langs = ("aa", "bb", "cc")
    model = language_id.Model(langs, rng.normal(size=(language_id.BUCKETS, 3)).astype(np.float32), rng.normal(size=3), 0.7, 0.6)
    want = []
    for i, t in ROWS:
        row = (i, "und", 0.0, False)
        if any(x.isalpha() for x in t or ""):
            found = plain_buckets(t)
            logits = [(sum(float(model.table[b, k]) for b in found) / len(found) + model.bias[k]) / 0.7 for k in range(3)]
            odds = [np.exp(z - max(logits)) for z in logits]
            score = max(odds) / sum(odds)
            row = (i, langs[odds.index(max(odds))], score, score >= 0.6)
        want.append(row)
    got = language_id.identify(frame(spark), model).collect()
    assert sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 6), r["accepted"]) for r in got), key=repr) == sorted(((i, p, round(float(x), 6), bool(a)) for i, p, x, a in want), key=repr)
    assert language_id.identify(frame(spark, []), model).count() == 0


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int, formatted string")


def digests(rows):
    """The contract in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        # each turn's marks, and one more character for each control string that is escaped
        escaped = lambda x: len(x or "") + len(re.findall(r"<\\*/?s>|\[\\*/?INST\]", x or ""))
        formatted = 3 + sum(17 + escaped(r[2]) + escaped(r[3]) for r in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), formatted)
    return out


@pytest.mark.parametrize("part", [40, 8 << 20])
def test_chats(spark, monkeypatch, part):
    monkeypatch.setattr(chat_format, "PART", part)
    hostile = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>\\", "[\\/INST]", "<", "</s", "[INST", "é😀<s>中\\", "", None, "<s></s><\\s>[[INST]]"]
    rows = [(c, k, ["user", "assistant", "system", None, "<s>[INST]"][k % 5], t) for c in range(4) for k, t in enumerate(hostile * (c + 1))]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (9, 1, "assistant", "same"), (9, 1, "assistant", "same"), (10, 0, "user", "z" * 100)]
    df = chats(spark, [(*r, 0, "f") for r in rows])
    made = chat_format.format_conversations(df)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in chat_format.read_back(made).collect()}
    assert got == digests(rows)
    assert chat_format.read_back(chat_format.format_conversations(chats(spark, []))).count() == 0


def nearest(rows, queries, k):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in ok:
        if i in queries:
            scored = sorted((-vector_search.exact_cosines(q[None], v[None])[0], j) for j, v in ok if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "group"), [(3, 1), (2, 2), (2048, 16)])
def test_vectors(spark, monkeypatch, block, group):
    monkeypatch.setattr(vector_search, "BLOCK", block)
    monkeypatch.setattr(vector_search, "GROUP", group)
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, [0.0] * 8), (103, None), (104, [1.0, None] * 4), (105, [float("nan")] * 8), (106, [float("inf")] + [1.0] * 7), (107, []), (108, [1.0, 2.0]), (None, rows[0][1]), (109, [1e-200] * 8), (110, [1e200] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], "vec_id long, embedding array<double>, rank int, block int, score double")
    wanted = {0, 50, 100, 102, 103, 108, 109}
    got = vector_search.search(df, df.where(df.vec_id.isin(list(wanted))), 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == nearest(rows, wanted, 5)
    assert vector_search.search(df.limit(0), df.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_pipeline_on_awkward_and_empty_tables(spark, sf_dir):
    for rows in (awkward(), []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)


def test_substring_stage_keeps_every_document(spark, sf_dir):
    docs = frame(spark, [r for r in awkward() if r[0] in (4, 5, 10, 11)] + [(20, prose(60, 2), "xx", "s", 0, 7, 7, "w", 3, "c", 1, "z", 2, 9)])
    got = sorted((r["doc_id"], r["text"] == "", r["n_chars"] == 0) for r in corpus_pipeline.substring(spark, docs, sf_dir).collect())
    assert got == [(4, False, False), (5, False, False), (5, False, False), (10, False, False), (11, True, True), (20, True, True)]


def test_filtering_stages_keep_what_the_operators_accept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    good = corpus_pipeline.quality(spark, docs, sf_dir)
    judged = {r["doc_id"]: (measured(r["text"]), r["kept"]) for r in quality_rules.judge(docs).join(docs.select("doc_id", "text"), "doc_id").collect()}
    assert ids(good) == sorted(i for i, (_, kept) in judged.items() if kept)
    assert all(not kept for (n, _, _, _, repeated), kept in judged.values() if n < 10 or 100 * repeated > 20 * n)
    told = language_id.identify(good, language_id.fit(good))
    assert ids(corpus_pipeline.language(spark, good, sf_dir)) == ids(told.where("accepted")) and told.where("accepted AND lang_pred = 'und'").count() == 0


def test_dedup_stages_as_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stand = {c for _, c in classes(rows)}
    near = spark.createDataFrame(corpus_pipeline.near_dedup(spark, docs, sf_dir).collect(), docs.schema)
    kept = [(r["doc_id"], r["text"]) for r in near.collect()]
    assert sorted(kept) == sorted((i, t) for i, t in rows if i in stand)
    want = {i: t if not lost else left for (i, t), (_, _, lost, left) in zip(kept, without_repeats(kept), strict=True)}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.substring(spark, near, sf_dir).collect()} == want


def test_run_is_the_composition_of_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(made.collect(), made.schema)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, docs.select(key).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(key).collect()))
