"""Recovery-shaped questions to a log kept in segments (``segment``, ``offset``, ``valid`` next to the record)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record_valid(payload_len: Column, crc_ok: Column, kind: Column, key_len: Column, value_len: Column) -> Column:
    """Whether a decoded record can be trusted: plausible length, matching checksum and lengths, and no value on a delete."""
    sane = payload_len.between(17, 1 << 30) & crc_ok & kind.isin(1, 2)
    return sane & (key_len + value_len + 17 == payload_len) & ((kind == 1) | (value_len == 0))


def valid_prefix(records: DataFrame) -> DataFrame:
    """The records of each segment before its first bad one; what follows a bad record can't be trusted."""
    bad = records.where(~F.col("valid")).groupBy("segment").agg(F.min("offset").alias("bad_at"))
    # one row per damaged segment
    return records.join(bad, "segment", "left").where(F.col("bad_at").isNull() | (F.col("offset") < F.col("bad_at"))).drop("bad_at")


def recovery_report(records: DataFrame) -> DataFrame:
    """One row over all segments: segments, records, puts, deletes, damaged segments, last seqno, last damaged segment and where it is cut."""
    bad = records.groupBy("segment").agg(F.min(F.when(~F.col("valid"), F.col("offset"))).alias("cut"), F.count("*").alias("n"))
    segments = bad.agg(F.count("*").alias("segments"), F.count("cut").alias("truncated"), F.max(F.when(F.col("cut").isNotNull(), F.col("segment"))).alias("truncated_segment"), F.max_by("cut", F.when(F.col("cut").isNotNull(), F.col("segment"))).alias("truncated_to"))
    good = valid_prefix(records).agg(F.count("*").alias("records"), F.count_if(~F.col("tombstone")).alias("puts"), F.count_if("tombstone").alias("deletes"), F.coalesce(F.max("seqno"), F.lit(0)).alias("last_seqno"))
    return segments.join(good, F.lit(True))


def removable_segments(records: DataFrame, watermark: int) -> DataFrame:
    """Segments all of whose records were flushed; the last segment is in use and stays."""
    tops = records.groupBy("segment").agg(F.max("seqno").alias("max_seqno"))
    active = tops.agg(F.max("segment").alias("active"))
    return tops.join(active, F.lit(True)).where((F.col("max_seqno") <= watermark) & (F.col("segment") != F.col("active"))).select("segment", "max_seqno")


def order_violations(records: DataFrame) -> DataFrame:
    """(violations): places where the sequence number doesn't grow, within segments by ``lag`` and between them by their ends."""
    within = Window.partitionBy("segment").orderBy("offset")
    inside = records.withColumn("before", F.lag("seqno").over(within)).agg(F.count_if(F.col("before") >= F.col("seqno")).alias("a"))
    ends = records.groupBy("segment").agg(F.min_by("seqno", "offset").alias("first"), F.max_by("seqno", "offset").alias("last"))
    between = ends.withColumn("before", F.lag("last").over(Window.orderBy("segment"))).agg(F.count_if(F.col("before") >= F.col("first")).alias("b"))
    return inside.join(between, F.lit(True)).select((F.col("a") + F.col("b")).alias("violations"))


def overlapping_runs(manifest: DataFrame) -> DataFrame:
    """Neighbouring runs whose seqno ranges touch: none in a healthy manifest."""
    order = Window.orderBy(F.desc("max_seqno"))
    both = manifest.withColumn("next_max", F.lead("max_seqno").over(order)).withColumn("next_id", F.lead("id").over(order))
    return both.where(F.col("next_max") >= F.col("min_seqno")).select("id", "next_id")


def orphans(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Run files on disk that the manifest doesn't know."""
    return files.where(F.col("file_name").endswith(".sst")).join(manifest.select("file_name"), "file_name", "left_anti")


def missing(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Runs of the manifest without their file: any row means corruption."""
    return manifest.select("file_name").join(files, "file_name", "left_anti")
