"""Statistics as DataFrames: counters, ratios and their export as metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CLASSES

#: Metric name -> (kind, column of the one-row statistics).
METRICS = {
    "lsm_writes_total": ("counter", "writes"),
    "lsm_wal_appends_total": ("counter", "writes"),
    "lsm_wal_active_segment_bytes": ("gauge", "wal_active_segment_bytes"),
    "lsm_wal_segments_total": ("gauge", "wal_segments"),
    "lsm_memtable_active_bytes": ("gauge", "active_bytes"),
    "lsm_memtable_active_entries": ("gauge", "active_entries"),
    "lsm_memtables_immutable": ("gauge", "immutables"),
    "lsm_flush_jobs_total": ("counter", "flushes"),
    "lsm_sst_created_total": ("counter", "flushes"),
    "lsm_sst_bytes_written_total": ("counter", "bytes_written"),
    "lsm_reads_total": ("counter", "reads"),
    "lsm_read_hit_memtable_total": ("counter", "memory_hits"),
    "lsm_read_sstable_consulted_total": ("counter", "runs_consulted"),
    "lsm_bloom_checks_total": ("counter", "blooms_checked"),
    "lsm_bloom_negative_total": ("counter", "blooms_negative"),
    "lsm_block_cache_hits_total": ("counter", "cache_hits"),
    "lsm_block_cache_misses_total": ("counter", "cache_misses"),
    "lsm_disk_block_reads_total": ("counter", "disk_block_reads"),
    "lsm_compaction_jobs_total": ("counter", "compactions"),
    "lsm_compaction_bytes_in_total": ("counter", "compaction_bytes_in"),
    "lsm_compaction_bytes_out_total": ("counter", "compaction_bytes_out"),
    "lsm_compaction_backlog_bytes": ("gauge", "compaction_backlog_bytes"),
    "lsm_versions_published_total": ("counter", "versions"),
    "lsm_epoch_current": ("gauge", "epoch"),
    "lsm_sst_live_total": ("gauge", "sst_live"),
    "lsm_write_stalls_total": ("counter", "stalls"),
}


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def memtable_stats(rows: DataFrame, slot_size: Column) -> DataFrame:
    """One row over newest versions: entries, bytes, delete markers and the newest sequence number."""
    return rows.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum(slot_size), F.lit(0)).alias("bytes"),
        F.count_if("tombstone").alias("tombstones"),
        F.coalesce(F.max("seqno"), F.lit(0)).alias("newest_seqno"),
    )


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count("*").alias("runs"),
        F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.max("max_seqno"), F.lit(0)).alias("max_seqno"),
        F.max_by("id", "max_seqno").alias("newest_id"),
    )


def block_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("run_id").agg(F.count("*").alias("blocks"), F.min("bytes").alias("min_bytes"), F.max("bytes").alias("max_bytes"), F.round(F.avg("bytes"), 4).alias("avg_bytes"))


def error_counts(spark: SparkSession, errors: DataFrame) -> DataFrame:
    """(type, n) for all error classes, also those that never happened."""
    kinds = spark.createDataFrame([(c,) for c in CLASSES], "type string")
    return kinds.join(errors.groupBy("type").agg(F.count("*").alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def as_metrics(stats: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(name, kind, value) rows of a one-row table of statistics, and of the error counts (type, n), whose type becomes a label."""
    known = [(name, kind, c) for name, (kind, c) in METRICS.items() if c in stats.columns]
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.col(c).cast("long").alias("value")) for n, k, c in known))
    out = stats.select(F.explode(rows).alias("m")).select("m.*")
    if errors is None:
        return out
    return out.unionByName(errors.select(F.format_string('lsm_errors_total{type="%s"}', "type").alias("name"), F.lit("counter").alias("kind"), F.col("n").cast("long").alias("value")))


def stall_state(loads: DataFrame, max_immutable: int = 4, stop_writes: int = 20) -> DataFrame:
    """What happens to a write at (tables, immutables): refused, blocked or accepted."""
    state = F.when(F.col("tables") > stop_writes, "refused").when(F.col("immutables") >= max_immutable, "blocked").otherwise("accepted")
    return loads.select("tables", "immutables", state.alias("state"))


def job_line(jobs: DataFrame) -> DataFrame:
    """A line of text for each compaction job."""
    text = F.format_string("job %d: %d -> %d keys, %d -> %d bytes, dropped %.0f%%, markers kept %d, dropped %d", "job_id", "keys_in", "keys_out", "bytes_in", "bytes_out", "drop_pct", "tombstones_kept", "tombstones_dropped")
    return jobs.select("job_id", text.alias("line"))
