"""Every query against its SQL, over the smallest tables."""

import glob
import os
import zlib

import duckdb
import pytest

from brinelog.operators import merge
from brinelog.plans import QUERIES, SQL
from brinelog.sources.logs import events_log


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return None if v is None else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    rel = con.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    assert got == want


def log_of(spark, sf_dir):
    return sorted((r["seqno"], r["key"], r["value"], r["tombstone"]) for r in events_log(spark, sf_dir).collect())


def test_record_checksums(spark, sf_dir):
    want = {n: zlib.crc32("\x00".join(["DEL" if gone else "PUT", str(n), key, value]).encode()) for n, key, value, gone in log_of(spark, sf_dir)}
    assert {r["seqno"]: r["crc"] for r in QUERIES["record_checksums"](spark, sf_dir).collect()} == want


def test_rotations_of_overwritten_keys(spark, sf_dir):
    want, held, first, n = [], {}, 0, 0
    for seqno, key, value, _ in log_of(spark, sf_dir):
        first, n = first if n else seqno, n + 1
        held[key] = len(key.encode()) + len(value.encode()) + 32
        if sum(held.values()) >= 2048:
            want.append((len(want) + 1, first, seqno, n, len(held), sum(held.values())))
            held, n = {}, 0
    if n:
        want.append((len(want) + 1, first, seqno, n, len(held), sum(held.values())))
    got = QUERIES["memtable_rotation_overwrites"](spark, sf_dir)
    assert sorted(map(tuple, got.select("memtable", "first_seqno", "last_seqno", "writes", "entries", "bytes").collect())) == want


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(SQL) == {"record_checksums", "memtable_rotation_overwrites"}


def test_filters_rule_out_absent_keys(spark, sf_dir):
    rows = QUERIES["bloom_negative_ratio"](spark, sf_dir.replace("0.001", "0.01")).collect()
    assert sum(r["negative"] for r in rows) > 0.9 * sum(r["checked"] for r in rows) > 1000


@pytest.mark.parametrize("unique", [True, False])
def test_newest_wins_with_nulls_and_clashing_names(spark, unique):
    rows = [("a", 1, "x", None, 7), ("a", 2, None, "t", 8), (None, 5, "n", None, 9), (None, 6, "m", None, 1), ("b", 3, "", None, None)]
    df = spark.createDataFrame(rows, "key string, seqno long, value string, _row string, top int")
    got = sorted(map(tuple, merge.newest_wins(df, unique=unique).select("key", "seqno", "value", "_row", "top").collect()), key=repr)
    assert got == sorted([("a", 2, None, "t", 8), (None, 6, "m", None, 1), ("b", 3, "", None, None)], key=repr)
    assert merge.newest_wins(df.limit(0), unique=unique).count() == 0


def test_no_sort_under_the_newest_of_a_log(spark, sf_dir):
    plan = merge.newest_wins(events_log(spark, sf_dir), unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_too_many_runs_are_refused(spark):
    manifest = spark.range(5).selectExpr("id", "'a' AS min_key", "'b' AS max_key", "id AS min_seqno", "id AS max_seqno")
    assert merge.ranges_row(manifest, 5).first()["ranges"][4]["id"] == 4 and merge.bounded(manifest, 5).count() == 5
    for refused in (merge.ranges_row(manifest, 4), merge.bounded(manifest, 4)):
        with pytest.raises(Exception, match="too many runs"):
            refused.collect()


def test_range_scan_whole_and_by_page(spark):
    keys = [f"user:{k:03d}" for k in range(100)]
    snapshot = spark.createDataFrame([(k, "v") for k in reversed(keys)], "key string, value string")
    assert [r["key"] for r in merge.range_scan(snapshot, "user:010", "user:059").collect()] == keys[10:60]
    assert [r["key"] for r in merge.range_scan(snapshot, "user:010", "user:059", 20).collect()] == keys[10:30]
