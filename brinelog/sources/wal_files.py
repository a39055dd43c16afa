"""Importing binary log segments.

A segment is eight bytes of header (``LSMW``, version 1, three unused) and records:
payload length (u32), payload, CRC-32 of the payload (u32); a payload is the kind
(1 put, 2 delete), the sequence number (u64), key and value lengths (u32 each), key, value;
all little-endian.  Decoding a file stops at its first bad record.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records that are decoded at once.
PART = 20_000
MAGIC = b"LSMW\x01\x00\x00\x00"
RECORDS = "segment long, offset long, seqno long, key string, value binary, tombstone boolean, valid boolean"


def encode_record(seqno: int, key: bytes, value: bytes | None) -> bytes:
    """One framed record; value None is a delete."""
    data = value or b""
    payload = struct.pack("<BQII", 2 if value is None else 1, seqno, len(key), len(data)) + key + data
    return struct.pack("<I", len(payload)) + payload + struct.pack("<I", zlib.crc32(payload))


def decode_segment(data: bytes) -> Iterator[tuple[int, int | None, str | None, bytes | None, bool | None, bool]]:
    """(offset, seqno, key, value, tombstone, valid) of each record; the last one may be a bad one."""
    if data[:5] != MAGIC[:5]:
        if data:
            yield 0, None, None, None, None, False
        return
    at = len(MAGIC)
    while at < len(data):
        bad = (at, None, None, None, None, False)
        if at + 4 > len(data):
            yield bad
            return
        (size,) = struct.unpack_from("<I", data, at)
        end = at + 4 + size
        if not 17 <= size <= 1 << 30 or end + 4 > len(data):
            yield bad
            return
        payload = data[at + 4 : end]
        kind, seqno, n_key, n_value = struct.unpack_from("<BQII", payload)
        if struct.unpack_from("<I", data, end)[0] != zlib.crc32(payload) or kind not in (1, 2) or 17 + n_key + n_value != size or (kind == 2 and n_value):
            yield bad
            return
        yield at, seqno, payload[17 : 17 + n_key].decode("utf-8", "replace"), payload[17 + n_key :] if kind == 1 else b"", kind == 2, True
        at = end + 4


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Records of all ``<number>.wal`` files of a folder; files with other names are passed over.

    A file is read by one task as a whole, since its records can only be found from its start; logs roll to a new one at
    ``wal_segment_roll_bytes``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path)
    number = F.try_to_number(F.regexp_extract("path", r"([0-9]+)\.wal$", 1), F.lit("9" * 18)).cast("long")
    named = files.select(number.alias("segment"), "content").where("segment IS NOT NULL")

    def decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["segment", "offset", "seqno", "key", "value", "tombstone", "valid"]
        for pdf in batches:
            rows = ((s, *r) for s, data in zip(pdf["segment"], pdf["content"], strict=True) for r in decode_segment(data))
            while part := list(islice(rows, PART)):  # a segment's records are never held all at once
                yield pd.DataFrame(part, columns=names).astype({"seqno": "Int64", "tombstone": "boolean"})

    return named.mapInPandas(decode, RECORDS)
