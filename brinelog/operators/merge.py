"""Newest-wins merging, snapshots and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs of a manifest that is set beside other rows: some megabytes.
RUNS = 50_000


def newest_wins(rows: DataFrame, keys: Sequence[str] = ("key",), version: Sequence[str] = ("seqno",), unique: bool = False) -> DataFrame:
    """One row per key: the one with the highest version.

    In general the whole row is reduced as one struct, so that its fields stay together and nulls in them
    count; the aggregate combines on the map side, so copies of a hot key never gather.  It sorts, as
    structs don't fit into a hash aggregate's buffer.  With ``unique``, no two rows of a key have the same version, which is
    one number and never null: then the highest numbers are found by a hash aggregate, and the rows that have them by a join.
    """
    if unique and len(version) == 1:
        top = rows.groupBy(*keys).agg(F.max(version[0]).alias("top")).select(F.struct("*").alias("_best"))
        same = [F.col(f"_all.{k}").eqNullSafe(F.col(f"_best.{k}")) for k in keys]
        # Not "=": the join is by key alone then, as the aggregate is partitioned already.
        both = rows.select(F.struct("*").alias("_all")).join(top, [*same, F.col(f"_all.{version[0]}") >= F.col("_best.top")], "left_semi")
        return both.select(*(F.col(f"_all.{c}").alias(c) for c in [*keys, *(c for c in rows.columns if c not in keys)]))
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    return best.select(*keys, "_row.*")


def live(rows: DataFrame, unique: bool = False) -> DataFrame:
    """Newest versions without deleted keys.  The filter comes after the reduction: before it, old versions would come back."""
    return newest_wins(rows, unique=unique).where(~F.col("tombstone")).drop("tombstone")


def as_of(log: DataFrame, seqno: int, unique: bool = False) -> DataFrame:
    """The live keys as they were when ``seqno`` was written."""
    return live(log.where(F.col("seqno") <= seqno), unique)


def multi_get(rows: DataFrame, wanted: DataFrame, unique: bool = False) -> DataFrame:
    """(key, value, found) for each wanted key (a distinct set is assumed by the caller), from all versions: only those of wanted keys are merged."""
    found = live(rows.join(wanted.select("key"), "key", "left_semi"), unique).select("key", "value", F.lit(True).alias("found"))
    return wanted.select("key").join(found, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def point_get(snapshot: DataFrame, key: str) -> DataFrame:
    return snapshot.where(F.col("key") == key)


def range_scan(snapshot: DataFrame, low: str, high: str, most: int | None = None) -> DataFrame:
    """The keys from ``low`` to ``high`` in byte order: all, or the first ``most``."""
    found = snapshot.where(F.col("key").between(low, high)).orderBy("key")
    return found if most is None else found.limit(most)


def run_manifest(runs: DataFrame, entry_size: object) -> DataFrame:
    """One row per run: entries, size, key range and seqno range."""
    return runs.groupBy(F.col("run_id").alias("id")).agg(
        F.count("*").alias("entries"),
        F.sum(entry_size).alias("file_size"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.min("seqno").alias("min_seqno"),
        F.max("seqno").alias("max_seqno"),
    )


def bounded(manifest: DataFrame, runs: int = RUNS) -> DataFrame:
    """The manifest, which may have ``runs`` rows: a store refuses writes long before (``l0_stop_writes``), and a larger one is an error here, so that it can be broadcast."""
    n = F.count("*").over(Window.partitionBy())
    return manifest.withColumn("_n", n).where(F.when(F.col("_n") <= runs, True).otherwise(F.raise_error(F.lit("too many runs: compact first")))).drop("_n")


def ranges_row(manifest: DataFrame, runs: int = RUNS) -> DataFrame:
    """One row with the whole manifest as an array, to be set beside other rows; ``bounded`` in size."""
    one = F.struct("id", "min_key", "max_key", "min_seqno", "max_seqno")
    held = F.when(F.count("*") <= runs, F.sort_array(F.collect_list(one))).otherwise(F.raise_error(F.lit("too many runs: compact first")))
    return F.broadcast(manifest.agg(held.alias("ranges")))


def _outside(r: Column) -> Column:
    return (F.col("key") < r["min_key"]) | (F.col("key") > r["max_key"])


def covering(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted key: how many runs may hold it by key range, and how many are skipped.  No row per key and run is made."""
    skipped = F.size(F.filter("ranges", _outside)).cast("long")
    both = wanted.select("key").join(ranges_row(manifest), F.lit(True))
    return both.select("key", (F.size("ranges") - skipped).alias("candidates"), skipped.alias("skipped"))


def get_trace(runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """How a newest-first probe would find each key: the run it stops at, runs consulted, runs skipped by range on the way."""
    where = runs.groupBy("key").agg(F.max("run_id").alias("source_run"))
    both = where.join(ranges_row(manifest), F.lit(True))
    newer = F.filter("ranges", lambda r: r["id"] >= F.col("source_run"))
    return both.select("key", "source_run", F.size(newer).cast("long").alias("consulted"), F.size(F.filter(newer, _outside)).cast("long").alias("range_skipped"))


def probes(runs: DataFrame, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, run_id, found): the runs that a newest-first probe looks into for each wanted key, as their range covers it, down to the one that has it."""
    where = runs.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.max("run_id").alias("source_run"))
    both = wanted.select("key").join(where, "key", "left").join(ranges_row(manifest), F.lit(True))
    inside = F.filter("ranges", lambda r: ~_outside(r) & (F.col("source_run").isNull() | (r["id"] >= F.col("source_run"))))
    return both.select("key", "source_run", F.explode(F.transform(inside, lambda r: r["id"])).alias("run_id")).select("key", "run_id", F.coalesce(F.col("run_id") == F.col("source_run"), F.lit(False)).alias("found"))


def source_runs(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """The run whose range of sequence numbers holds each row's: ranges are disjoint, so there is one at most."""
    inside = F.filter("ranges", lambda r: (r["min_seqno"] <= F.col("seqno")) & (F.col("seqno") <= r["max_seqno"]))
    both = rows.join(ranges_row(manifest), F.lit(True))
    return both.select("key", "seqno", F.get(inside, F.lit(0))["id"].alias("source_run")).where("source_run IS NOT NULL")
