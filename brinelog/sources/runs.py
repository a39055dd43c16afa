"""Runs as Parquet: sorted by key, with statistics and a Bloom filter on the key."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptionDetected, IOFailure
from ..schemas import ENTRY

FILTER = "_keys.bloom"
CHECKSUMS = "parquet.page.verify-checksum.enabled"


def write_run(rows: DataFrame, path: str, entries: int, false_positive: float = 0.01, files: int = 1, codec: str = "snappy") -> None:
    """Write newest versions as one run.

    ``files`` > 1 range-partitions a large run by key: each file keeps its own key range, so
    readers skip files by statistics.  Without an expected count, the Bloom filter would take
    its largest size in every file.
    """
    narrow = rows.select("key", "value", "seqno", "tombstone")
    placed = narrow.repartitionByRange(files, "key") if files > 1 else narrow.coalesce(1)
    writer = placed.sortWithinPartitions("key").write.option("compression", codec)
    writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(1, entries // files)))
    writer = writer.option("parquet.bloom.filter.fpp#key", str(false_positive)).option("parquet.page.write-checksum.enabled", "true")
    try:
        writer.parquet(path)
    except Exception as e:
        raise IOFailure(f"run {path} can't be written: {str(e)[:200]}") from e


def write_filter(rows: DataFrame, path: str, entries: int, false_positive: float) -> None:
    """The Bloom filter of a run's keys for readers on the driver, merged from the executors' parts; Spark passes over its name."""
    sketch = rows._jdf.stat().bloomFilter("key", max(1, entries), float(false_positive))
    stream = rows.sparkSession._jvm.java.io.FileOutputStream(os.path.join(path, FILTER))
    try:
        sketch.writeTo(stream)
    finally:
        stream.close()


def read_filter(spark: SparkSession, path: str) -> object:
    try:
        stream = spark._jvm.java.io.FileInputStream(os.path.join(path, FILTER))
        try:
            return spark._jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(stream)
        finally:
            stream.close()
    except Py4JJavaError as e:
        raise CorruptionDetected(f"run {path}: its filter can't be read") from e


def read_runs(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """All rows of some runs with their ``run_id``; keys pushed down to it skip row groups by range and Bloom filter."""
    if not paths:
        return spark.createDataFrame([], ENTRY).withColumn("run_id", F.lit(0).cast("long"))
    out = None
    for run_id, path in paths.items():
        rows = spark.read.schema(ENTRY).parquet(path).withColumn("run_id", F.lit(run_id).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def inspect_run(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a run: bytes, entries, key range and seqno range."""
    rows = spark.read.schema(ENTRY).parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return rows.groupBy("file", "bytes").agg(F.count("*").alias("entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seqno").alias("min_seqno"), F.max("seqno").alias("max_seqno"), F.count_if("tombstone").alias("tombstones"))


def check_footers(path: str, entries: int) -> None:
    """Whether all files of a run end as Parquet files do, and hold as many entries as the manifest says."""
    try:
        found = sum(pq.read_metadata(os.path.join(path, n)).num_rows for n in os.listdir(path) if n.endswith(".parquet"))
    except (OSError, pa.ArrowException) as e:
        raise CorruptionDetected(f"run {path}: {str(e)[:200]}") from e
    if found != entries:
        raise CorruptionDetected(f"run {path}: {found} entries in footers, the manifest says {entries}")


def verify_run(spark: SparkSession, path: str) -> int:
    """Read every page of a run against its checksum and check that keys are unique; gives the number of entries."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get(CHECKSUMS)
    conf.set(CHECKSUMS, "true")
    try:
        row = spark.read.schema(ENTRY).parquet(path).agg(F.count("*"), F.count_distinct("key"), F.sum(F.crc32(F.concat_ws("|", "key", "value").cast("binary")))).first()
    except Exception as e:
        raise CorruptionDetected(f"run {path}: {str(e)[:200]}") from e
    finally:
        conf.set(CHECKSUMS, before) if before is not None else conf.unset(CHECKSUMS)
    if row[0] != row[1]:
        raise CorruptionDetected(f"run {path}: {row[0] - row[1]} repeated keys")
    return row[0]
