"""Choosing runs to compact, merging them, and collecting delete markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merge import bounded, newest_wins

NO_SEQNO = 2**63 - 1


def picker_windows(manifest: DataFrame, fan_in: int = 4, ratio: float = 2.0) -> DataFrame:
    """All windows of ``fan_in`` neighbouring runs, newest first: pos, newest_id, ids, total, sizes and whether they are alike in size.

    The window over the whole manifest is one task's work on purpose: a manifest has a row per run.
    """
    k = max(2, fan_in)
    order = Window.orderBy(F.desc("max_seqno"))
    ahead = order.rowsBetween(0, k - 1)
    frames = manifest.select(
        F.row_number().over(order).cast("long").alias("pos"),
        F.col("id").alias("newest_id"),
        F.collect_list("id").over(ahead).alias("ids"),
        F.sum("file_size").over(ahead).alias("total"),
        F.max("file_size").over(ahead).alias("max_size"),
        F.min("file_size").over(ahead).alias("min_size"),
    )
    return frames.where(F.size("ids") == k).withColumn("qualifies", F.col("max_size") <= F.lit(float(ratio)) * F.col("min_size"))


def picker_choice(manifest: DataFrame, fan_in: int = 4, ratio: float = 2.0) -> DataFrame:
    """The window to compact (no row if there are too few runs): alike in size first, then the smallest, then the newest."""
    chosen = picker_windows(manifest, fan_in, ratio).orderBy(F.desc("qualifies"), "total", "pos").limit(1)
    reason = F.when(F.col("qualifies"), "runs of similar size").otherwise("no similar runs, the smallest")
    return chosen.select("ids", "total", reason.alias("reason"))


def manual_choice(manifest: DataFrame, asked: DataFrame) -> DataFrame:
    """For (case, id) lists: how many ids, how many are live, and whether they are neighbours; valid needs two or more, all live and adjacent."""
    order = Window.orderBy(F.desc("max_seqno"))
    placed = manifest.select("id", F.row_number().over(order).alias("pos"))
    found = asked.join(F.broadcast(bounded(placed)), "id", "left")
    out = found.groupBy("case").agg(F.count("*").alias("n"), F.count("pos").alias("n_live"), (F.max("pos") - F.min("pos") + 1).cast("long").alias("span"))
    adjacent = F.coalesce((F.col("n_live") == F.col("n")) & (F.col("span") == F.col("n")), F.lit(False))
    return out.select("case", "n", "n_live", adjacent.alias("adjacent"), (adjacent & (F.col("n") >= 2)).alias("valid"))


def merged(runs: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Newest version per key over some runs, delete markers included; runs share no sequence number."""
    return newest_wins(runs.where(F.col("run_id").isin(list(ids))).select("key", "value", "seqno", "tombstone", "run_id"), unique=True)


def droppable(seqno: Column, tombstone: Column, created: Column, now: int, grace: int, outside_min: Column) -> Column:
    """A delete marker can go once it is older than the grace time and nothing older lies outside the inputs."""
    return tombstone & (F.lit(now) - created > grace) & (outside_min > seqno)


def tombstone_gc(runs: DataFrame, manifest: DataFrame, ids: Sequence[int], now: int, grace: int) -> DataFrame:
    """The merged rows of the chosen runs with source_run and whether they are dropped."""
    inside = F.col("id").isin(list(ids))
    outside = manifest.where(~inside).agg(F.coalesce(F.min("min_seqno"), F.lit(NO_SEQNO)).alias("outside_min"))
    sources = manifest.where(inside).select(F.col("id").alias("source_run"), "created_at")
    rows = merged(runs, ids).withColumnRenamed("run_id", "source_run")
    found = rows.join(F.broadcast(bounded(sources)), "source_run", "left").join(F.broadcast(outside), F.lit(True))  # a row per input, one row
    drop = droppable(F.col("seqno"), F.col("tombstone"), F.coalesce(F.col("created_at"), F.lit(now)), now, grace, F.col("outside_min"))
    return found.select("key", "value", "seqno", "tombstone", "source_run", drop.alias("dropped"))


def job_stats(runs: DataFrame, outcome: DataFrame, ids: Sequence[int], entry_size: Column) -> DataFrame:
    """One row of counters of a compaction: what went in, what came out, what was dropped."""
    went_in = runs.where(F.col("run_id").isin(list(ids))).agg(F.count("*").alias("keys_in"), F.coalesce(F.sum(entry_size), F.lit(0)).alias("bytes_in"))
    kept = ~F.col("dropped")
    out = outcome.agg(
        F.count_if(kept).alias("keys_out"),
        F.coalesce(F.sum(F.when(kept, entry_size)), F.lit(0)).alias("bytes_out"),
        F.count_if(kept & F.col("tombstone")).alias("tombstones_kept"),
        F.count_if("dropped").alias("tombstones_dropped"),
    )
    both = went_in.join(out, F.lit(True))  # one row each
    dropped = F.col("keys_in") - F.col("keys_out")
    share = F.coalesce(F.try_divide(100.0 * dropped, F.col("keys_in")), F.lit(0.0))
    return both.withColumn("keys_dropped", dropped).withColumn("drop_pct", F.round(share, 4))


def manifest_after(manifest: DataFrame, removed: Sequence[int], added: DataFrame | None) -> DataFrame:
    """The manifest once a compaction is published: inputs out, the output in."""
    rest = manifest.where(~F.col("id").isin(list(removed)))
    return rest if added is None else rest.unionByName(added)


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): run ids that came or went between two versions."""
    a, b = old.select("id", F.lit(True).alias("was")), new.select("id", F.lit(True).alias("stays"))
    both = a.join(b, "id", "full_outer")
    return both.where("was IS NULL OR stays IS NULL").select("id", F.when(F.col("was").isNull(), "added").otherwise("removed").alias("change"))
