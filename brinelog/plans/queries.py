"""Queries: operators applied to logs derived from the test tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom_bits_of, bloom_params, entry_bytes, file_name, iso_utc, md5_bits_of, memtable_bytes, record_bytes, record_crc
from ..operators import compaction, folds, merge, stats, wal
from ..sources.logs import events_log, flushed, orders_log, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
HOUR, NOW, GRACE = 3600, 20 * 3600, 17 * 3600


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one only where there is one machine, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or tempfile.mkdtemp(prefix="brinelog-")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def runs_of(spark: SparkSession, d: str) -> DataFrame:
    return flushed(events_log(spark, d))


def manifest_of(runs: DataFrame) -> DataFrame:
    """The manifest of runs; created an hour apart, so that ages are the same everywhere."""
    return merge.run_manifest(runs, entry_bytes()).withColumn("created_at", F.col("id") * HOUR).withColumn("file_name", file_name(F.col("id")))


def chosen_ids(manifest: DataFrame) -> list[int]:
    """The picker's ids: a list as long as the fan-in."""
    row = compaction.picker_choice(manifest).first()
    return list(row["ids"]) if row else []


def wanted_keys(spark: SparkSession) -> DataFrame:
    return spark.range(0, 300, 7).select(F.concat(F.lit("user:"), F.col("id").cast("string")).alias("key"))


def segments_of(spark: SparkSession, d: str) -> DataFrame:
    """The log in ten segments as it was framed, every 997th record with a damaged checksum, kind or length."""
    log = events_log(spark, d)
    damage = F.when(F.pmod("seqno", F.lit(997)) == 0, F.pmod(F.floor(F.col("seqno") / 997), F.lit(4))).otherwise(-1)
    kind, n_key, n_value = F.when(F.col("tombstone"), 2).otherwise(1), F.octet_length("key"), F.octet_length("value")
    framed = log.withColumn("damage", damage).select(
        F.col("run_id").alias("segment"), F.col("seqno").alias("offset"), "seqno", "key", "value", "tombstone",
        (17 + n_key + n_value + F.when(F.col("damage") == 0, 1).otherwise(0)).alias("payload_len"),
        (record_crc() + F.when(F.col("damage") == 1, 1).otherwise(0)).alias("crc"),
        F.when(F.col("damage") == 2, 3).otherwise(kind).alias("kind"),
        F.when(F.col("damage") == 3, n_key + 1).otherwise(n_key).alias("n_key"),
        n_value.alias("n_value"),
    )
    valid = wal.record_valid(F.col("payload_len"), F.col("crc") == record_crc(), F.col("kind"), F.col("n_key"), F.col("n_value"))
    return framed.select("segment", "offset", "seqno", "key", "value", "tombstone", valid.alias("valid"))


@query
def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    return merge.newest_wins(events_log(spark, d).drop("run_id"), unique=True).select("key", "value", "seqno", "tombstone")


@query
def live_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return merge.live(events_log(spark, d), True).select("key", "value", "seqno")


@query
def snapshot_over_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs below, the newest tenth of the log still in memory on top."""
    log = events_log(spark, d)
    cols = ["key", "value", "seqno", "tombstone"]
    return merge.live(flushed(log.where("run_id < 10")).select(*cols).unionByName(log.where("run_id = 10").select(*cols)), True).select("key", "value", "seqno")


@query
def lineitem_latest(spark: SparkSession, d: str) -> DataFrame:
    """An update-heavy table without a sequence column: the whole row orders its versions, so nothing is numbered globally."""
    items = table(spark, d, "lineitem")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return merge.newest_wins(items, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")


@query
def point_get(spark: SparkSession, d: str) -> DataFrame:
    return merge.live(merge.point_get(events_log(spark, d), "user:7"), True).select("key", "value", "seqno")


@query
def multi_get(spark: SparkSession, d: str) -> DataFrame:
    return merge.multi_get(events_log(spark, d), wanted_keys(spark), True)


@query
def get_absent(spark: SparkSession, d: str) -> DataFrame:
    absent = spark.range(1000).select(F.concat(F.lit("absent-"), F.col("id").cast("string")).alias("key"))
    found = merge.multi_get(events_log(spark, d), absent, True)
    return found.agg(F.count("*").alias("probed"), F.count_if("found").alias("found"))


@query
def get_as_of_seqno(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d)
    return merge.as_of(log, log.count() // 2, True).select("key", "value", "seqno")


@query
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    return merge.range_scan(merge.live(events_log(spark, d), True), "user:1", "user:5").select("key", "value")


@query
def key_history(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d)
    return log.groupBy("key").agg(F.count("*").alias("versions"), F.count_if("tombstone").alias("deletes"), F.min("seqno").alias("first_seqno"), F.max("seqno").alias("last_seqno"))


@query
def run_op_rollup(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("tombstone"), "DEL").otherwise("PUT")
    return events_log(spark, d).withColumn("op", op).rollup("run_id", "op").agg(F.count("*").alias("n"), F.sum(record_bytes()).alias("bytes"))


@query
def get_trace(spark: SparkSession, d: str) -> DataFrame:
    runs = runs_of(spark, d)
    return merge.get_trace(runs, manifest_of(runs))


@query
def memtable_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.memtable_stats(merge.newest_wins(events_log(spark, d), unique=True), memtable_bytes())


@query
def run_manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifest_of(runs_of(spark, d)).withColumn("created", iso_utc(F.col("created_at"))).drop("created_at")


@query
def manifest_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.manifest_totals(manifest_of(runs_of(spark, d)))


@query
def range_skip(spark: SparkSession, d: str) -> DataFrame:
    return merge.covering(manifest_of(runs_of(spark, d)), wanted_keys(spark))


@query
def bloom_parameters(spark: SparkSession, d: str) -> DataFrame:
    p = bloom_params(F.col("entries"))
    return manifest_of(runs_of(spark, d)).select("id", "entries", F.round(p["bits_per_key"], 6).alias("bits_per_key"), p["hashes"].alias("hashes"), p["bits"].alias("bits"))


@query
def bloom_no_false_negative(spark: SparkSession, d: str) -> DataFrame:
    """Every key of a run passes the run's own filter."""
    runs = runs_of(spark, d)
    sized = runs.groupBy("run_id").agg(F.count("*").alias("entries"))
    p = bloom_params(F.col("entries"))
    sized = sized.select("run_id", p["bits"].alias("bits"), p["hashes"].alias("hashes"))
    wanted = runs.join(F.broadcast(sized), "run_id").select("run_id", "key", bloom_bits_of(F.col("key"), F.col("bits"), F.col("hashes")).alias("wanted"))
    have = wanted.select("run_id", F.explode("wanted").alias("bit")).distinct()
    probes = wanted.select("run_id", "key", F.explode(F.array_distinct("wanted")).alias("bit"), F.size(F.array_distinct("wanted")).alias("need"))
    hits = probes.join(have, ["run_id", "bit"], "left_semi").groupBy("run_id", "key", "need").agg(F.count("*").alias("got"))
    return hits.groupBy("run_id").agg(F.count("*").alias("probed"), F.count_if(F.col("got") < F.col("need")).alias("false_negatives"))


def _passed(runs: DataFrame, probed: DataFrame) -> DataFrame:
    """(key, run_id, may): whether the run's explicit Bloom filter (by MD5) lets each probe pass."""
    sized = runs.groupBy("run_id").agg(F.count("*").alias("entries"))
    p = bloom_params(F.col("entries"))
    sized = sized.select("run_id", p["bits"].alias("bits"), p["hashes"].alias("hashes"))
    bit = F.explode(F.array_distinct(md5_bits_of(F.col("key"), F.col("bits"), F.col("hashes")))).alias("bit")
    have = runs.join(sized, "run_id").select("run_id", bit).distinct().withColumn("set", F.lit(1))
    asked = probed.select("key", "run_id").join(sized, "run_id").select("key", "run_id", bit)
    return asked.join(have, ["run_id", "bit"], "left").groupBy("key", "run_id").agg((F.count("set") == F.count("*")).alias("may"))


@query
def bloom_negative_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are nowhere: how many filters are asked, and how many rule the key out."""
    runs = runs_of(spark, d)
    absent = spark.range(1000).select(F.concat(F.lit("user:"), F.col("id").cast("string"), F.lit("x")).alias("key"))
    passed = _passed(runs, merge.probes(runs, manifest_of(runs), absent))
    return passed.groupBy("run_id").agg(F.count("*").alias("checked"), F.count_if(~F.col("may")).alias("negative"))


@query
def flush_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs_of(spark, d).select("run_id", "key", "value", "seqno", "tombstone")


@query
def sst_block_layout(spark: SparkSession, d: str) -> DataFrame:
    return folds.block_layout(runs_of(spark, d), entry_bytes(), 1024)


@query
def sst_block_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.block_stats(folds.block_layout(runs_of(spark, d), entry_bytes(), 1024))


@query
def sst_restart_points(spark: SparkSession, d: str) -> DataFrame:
    return folds.restart_points(runs_of(spark, d)).withColumn("place", F.col("place").cast("long"))


@query
def sparse_index_seek(spark: SparkSession, d: str) -> DataFrame:
    """For each wanted key: the last restart point at or before it in each run that may hold it."""
    return folds.seek(folds.restart_points(runs_of(spark, d)), wanted_keys(spark))


@query
def picker_windows(spark: SparkSession, d: str) -> DataFrame:
    return compaction.picker_windows(manifest_of(runs_of(spark, d))).drop("ids")


@query
def picker_choice(spark: SparkSession, d: str) -> DataFrame:
    choice = compaction.picker_choice(manifest_of(runs_of(spark, d)))
    return choice.select(F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "total", "reason")


@query
def picker_no_candidate(spark: SparkSession, d: str) -> DataFrame:
    few = manifest_of(runs_of(spark, d)).where("id <= 3")
    return compaction.picker_choice(few).select(F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "total", "reason")


@query
def compaction_merge(spark: SparkSession, d: str) -> DataFrame:
    runs = runs_of(spark, d)
    return compaction.merged(runs, chosen_ids(manifest_of(runs))).select("key", "value", "seqno", "tombstone")


@query
def tombstone_gc(spark: SparkSession, d: str) -> DataFrame:
    """The four oldest runs, of which two are past the grace time."""
    runs = runs_of(spark, d)
    return compaction.tombstone_gc(runs, manifest_of(runs), [1, 2, 3, 4], NOW, GRACE).select("key", "seqno", "tombstone", "source_run", "dropped")


def _job(spark: SparkSession, d: str) -> DataFrame:
    runs = runs_of(spark, d)
    outcome = compaction.tombstone_gc(runs, manifest_of(runs), [1, 2, 3, 4], NOW, GRACE)
    return compaction.job_stats(runs, outcome, [1, 2, 3, 4], entry_bytes())


@query
def compaction_job_stats(spark: SparkSession, d: str) -> DataFrame:
    return _job(spark, d)


@query
def compaction_job_line(spark: SparkSession, d: str) -> DataFrame:
    return stats.job_line(_job(spark, d).withColumn("job_id", F.lit(1)))


@query
def amplification(spark: SparkSession, d: str) -> DataFrame:
    runs = runs_of(spark, d)
    job = _job(spark, d).select(F.round(stats.ratio(F.col("bytes_out").cast("double"), F.col("bytes_in")), 6).alias("write_ratio"))
    reads = merge.get_trace(runs, manifest_of(runs)).agg(F.round(stats.ratio(F.sum("consulted").cast("double"), F.count("*")), 6).alias("runs_per_read"))
    return job.join(reads, F.lit(True))


@query
def compaction_manual(spark: SparkSession, d: str) -> DataFrame:
    """Lists of runs someone asked to compact, and whether that is allowed."""
    cases = {"adjacent": [4, 3, 2], "gap": [5, 3], "unknown": [99, 1], "single": [1], "unordered": [7, 9, 8]}
    asked = spark.createDataFrame([(c, i) for c, ids in cases.items() for i in ids], "case string, id long")
    return compaction.manual_choice(manifest_of(runs_of(spark, d)), asked)


@query
def manifest_after_compaction(spark: SparkSession, d: str) -> DataFrame:
    runs = runs_of(spark, d)
    manifest = manifest_of(runs)
    ids = chosen_ids(manifest)
    output = merge.run_manifest(compaction.merged(runs, ids).drop("run_id").withColumn("run_id", F.lit(11).cast("long")), entry_bytes())
    cols = ["id", "entries", "file_size", "min_seqno", "max_seqno"]
    return compaction.manifest_after(manifest.select(*cols), ids, output.select(*cols))


@query
def version_diff(spark: SparkSession, d: str) -> DataFrame:
    runs = runs_of(spark, d)
    manifest = manifest_of(runs)
    ids = chosen_ids(manifest)
    output = merge.run_manifest(compaction.merged(runs, ids).drop("run_id").withColumn("run_id", F.lit(11).cast("long")), entry_bytes())
    return compaction.version_diff(manifest.select("id"), compaction.manifest_after(manifest.select("id"), ids, output.select("id")))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A folder listing in which one run is missing, and two files too many."""
    names = manifest_of(runs_of(spark, d)).where("id <> 3").select("file_name")
    return names.unionByName(spark.createDataFrame([("000099.sst",), ("000100.sst",), ("notes.txt",)], "file_name string"))


@query
def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    return wal.orphans(_files(spark, d), manifest_of(runs_of(spark, d)))


@query
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    return wal.missing(_files(spark, d), manifest_of(runs_of(spark, d)))


@query
def wal_segment_list(spark: SparkSession, d: str) -> DataFrame:
    return segments_of(spark, d).select("segment").distinct().select("segment", file_name(F.col("segment"), ".wal").alias("file_name"))


@query
def wal_recovery_report(spark: SparkSession, d: str) -> DataFrame:
    return wal.recovery_report(segments_of(spark, d))


@query
def wal_valid_prefix(spark: SparkSession, d: str) -> DataFrame:
    kept = wal.valid_prefix(segments_of(spark, d))
    return kept.groupBy("segment").agg(F.count("*").alias("records"), F.max("seqno").alias("last_seqno"))


@query
def wal_segment_roll(spark: SparkSession, d: str) -> DataFrame:
    return folds.wal_segments(events_log(spark, d), record_bytes(), 4096)


@query
def memtable_rotation(spark: SparkSession, d: str) -> DataFrame:
    return folds.memtable_rotations(orders_log(spark, d), memtable_bytes(), 65536)


@query
def memtable_rotation_overwrites(spark: SparkSession, d: str) -> DataFrame:
    return folds.overwriting_rotations(events_log(spark, d), 2048)


@query
def wal_cleanup(spark: SparkSession, d: str) -> DataFrame:
    log = segments_of(spark, d)
    flushed_to = log.where("segment = 7").agg(F.max("seqno")).first()[0] or 0
    return wal.removable_segments(log, flushed_to)


@query
def wal_seqno_monotonic(spark: SparkSession, d: str) -> DataFrame:
    return wal.order_violations(segments_of(spark, d))


@query
def run_ranges_disjoint(spark: SparkSession, d: str) -> DataFrame:
    return wal.overlapping_runs(manifest_of(runs_of(spark, d)))


@query
def seqno_source_run(spark: SparkSession, d: str) -> DataFrame:
    """Which run each newest version lies in, by seqno range."""
    runs = runs_of(spark, d)
    return merge.source_runs(merge.newest_wins(runs.drop("run_id"), unique=True), manifest_of(runs))


@query
def record_checksums(spark: SparkSession, d: str) -> DataFrame:
    return events_log(spark, d).select("seqno", record_crc().alias("crc"))


@query
def write_stall_state(spark: SparkSession, d: str) -> DataFrame:
    loads = spark.range(0, 25, 3).select(F.col("id").alias("tables")).join(F.broadcast(spark.range(0, 6).select(F.col("id").alias("immutables"))), F.lit(True))
    return stats.stall_state(loads)


@query
def error_counts(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(F.lit("InvalidArgument"), F.lit("IOFailure"), F.lit("Backpressure"))
    errors = table(spark, d, "events").where("event_type = 'error'").select(F.get(kinds, F.pmod("user_id", F.lit(3)).cast("int")).alias("type"))
    return stats.error_counts(spark, errors)


def _stats(spark: SparkSession, d: str) -> DataFrame:
    """One row: a store that wrote the whole log, flushed it in ten runs, compacted none, keeps the newest tenth in memory too, and read every wanted key from its runs twice."""
    log = events_log(spark, d)
    runs = flushed(log)
    manifest = manifest_of(runs)
    memory = stats.memtable_stats(merge.newest_wins(log.where("run_id = 10"), unique=True), memtable_bytes()).select(F.col("entries").alias("active_entries"), F.col("bytes").alias("active_bytes"))
    totals = stats.manifest_totals(manifest).select(F.col("runs").alias("sst_live"), F.col("total_bytes").alias("sst_total_bytes"), F.col("max_seqno").alias("last_seqno"))
    backlog = compaction.picker_choice(manifest).agg(F.coalesce(F.max("total"), F.lit(0)).alias("compaction_backlog_bytes"))
    segments = log.agg(F.count_distinct("run_id").alias("wal_segments"), (F.sum(F.when(F.col("run_id") == 10, record_bytes())) + 8).alias("wal_active_segment_bytes"), F.count("*").alias("writes"))
    wanted = wanted_keys(spark)
    probed = merge.probes(runs, manifest, wanted).join(_passed(runs, merge.probes(runs, manifest, wanted)), ["key", "run_id"])
    looked = probed.agg((2 * F.count("*")).alias("blooms_checked"), (2 * F.count_if(~F.col("may"))).alias("blooms_negative"), F.count_if("may").alias("disk_block_reads"))
    where = runs.groupBy("key").agg(F.max("run_id").alias("source_run"))
    consulted = wanted.join(where, "key", "left").join(merge.ranges_row(manifest), F.lit(True)).agg(
        (2 * F.sum(F.size(F.filter("ranges", lambda r: F.col("source_run").isNull() | (r["id"] >= F.col("source_run")))))).alias("runs_consulted"), (2 * F.count("*")).alias("reads")
    )
    one = memory
    for row in (totals, backlog, segments, looked, consulted):  # one row each
        one = one.join(row, F.lit(True))
    zero = dict.fromkeys(("immutables", "immutables_bytes", "jobs_running", "memory_hits", "compactions", "compaction_bytes_in", "compaction_bytes_out", "stalls"), F.lit(0).cast("long"))
    same = {"epoch": "sst_live", "flushes": "sst_live", "versions": "sst_live", "bytes_written": "sst_total_bytes", "cache_hits": "disk_block_reads", "cache_misses": "disk_block_reads"}
    one = one.withColumns(zero | {k: F.col(v).cast("long") for k, v in same.items()})
    lookups = (F.col("cache_hits") + F.col("cache_misses")).cast("double")
    return one.withColumn("version_id", F.col("epoch") + 1).withColumn("block_cache_hit_rate", stats.ratio(F.col("cache_hits").cast("double"), lookups))


STATS = ["epoch", "version_id", "last_seqno", "active_bytes", "active_entries", "immutables", "immutables_bytes", "sst_live", "sst_total_bytes", "block_cache_hit_rate", "disk_block_reads", "blooms_checked", "blooms_negative", "compaction_backlog_bytes", "jobs_running", "wal_segments", "wal_active_segment_bytes"]


@query
def engine_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).select(*STATS)


@query
def prometheus_export(spark: SparkSession, d: str) -> DataFrame:
    return stats.as_metrics(_stats(spark, d), error_counts(spark, d))


@query
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest versions again, kept by a streaming query over the events file."""
    from ..streaming import latest_stream

    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)
    gone = F.col("event_type") == "error"
    log = stream.select(
        (F.col("event_id") + 1).alias("seqno"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(gone, "").otherwise(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))).alias("value"),
        gone.alias("tombstone"),
    )
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    latest_stream(log, f"{folder}/latest", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/latest").select("key", "value", "seqno", "tombstone")
