"""Schemas of the versioned log, of runs and of the manifest; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

LOG = T.StructType(
    [
        T.StructField("seqno", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("tombstone", T.BooleanType()),
    ]
)

ENTRY = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("seqno", T.LongType()),
        T.StructField("tombstone", T.BooleanType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("entries", T.LongType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("min_key", T.StringType()),
        T.StructField("max_key", T.StringType()),
        T.StructField("min_seqno", T.LongType()),
        T.StructField("max_seqno", T.LongType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("bloom_bits_per_key", T.DoubleType()),
        T.StructField("bloom_hashes", T.IntegerType()),
    ]
)

JOB = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("input_ids", T.ArrayType(T.LongType())),
        T.StructField("output_file", T.StringType()),
        T.StructField("bytes_in", T.LongType()),
        T.StructField("bytes_out", T.LongType()),
        T.StructField("keys_in", T.LongType()),
        T.StructField("keys_out", T.LongType()),
        T.StructField("keys_dropped", T.LongType()),
        T.StructField("tombstones_kept", T.LongType()),
        T.StructField("tombstones_dropped", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
    ]
)
