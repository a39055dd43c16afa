"""Micro-batches of a log: into a store, or straight to the newest version of each key."""

from __future__ import annotations

import zlib
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import newest_wins

if TYPE_CHECKING:
    from ..store import Store


def log_stream(spark: SparkSession, path: str, schema: object, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream; the number of files per batch is the back pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_stream(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Newest version per key, kept as streaming state; each batch replaces the Parquet table at ``path``, written by the executors."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return newest_wins(log).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_into(log: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Each micro-batch becomes one run of the store.  A batch that is run again after a failure finds itself committed; streams are told apart by their checkpoints."""
    name = f"stream-{zlib.crc32(checkpoint.encode()):08x}"

    def commit(batch: DataFrame, batch_id: int) -> None:
        store.apply_batch(batch.select("key", "value", F.col("tombstone"), "seqno"), f"{name}-{batch_id}")

    return log.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
