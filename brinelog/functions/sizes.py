"""Logical sizes of what a log and its runs hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Header bytes of a run entry, of a log record and of a log segment; bytes a memtable slot takes besides its data.
ENTRY_HEADER, RECORD_HEADER, SEGMENT_HEADER, SLOT = 17, 25, 8, 32


def _data(key: str, value: str) -> Column:
    return (F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def entry_bytes(key: str = "key", value: str = "value") -> Column:
    return _data(key, value) + ENTRY_HEADER


def record_bytes(key: str = "key", value: str = "value") -> Column:
    return _data(key, value) + RECORD_HEADER


def memtable_bytes(key: str = "key", value: str = "value", slot: int = SLOT) -> Column:
    return _data(key, value) + slot
