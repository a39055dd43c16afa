"""Names, times and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(number: Column, suffix: str = ".sst") -> Column:
    """Six digits, zero-padded, and a suffix; longer numbers stay whole."""
    digits = number.cast("string")
    return F.concat(F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits), F.lit(suffix))


def iso_utc(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def record_crc(seqno: str = "seqno", key: str = "key", value: str = "value", tombstone: str = "tombstone") -> Column:
    """CRC-32 of a record's fields in a fixed text form."""
    kind = F.when(F.col(tombstone), "DEL").otherwise("PUT")
    return F.crc32(F.concat_ws("\x00", kind, F.col(seqno).cast("string"), key, value).cast("binary"))
