"""Bloom filter arithmetic and an explicit filter as rows (run, bit), for runs that aren't Parquet files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bloom_params(entries: Column, false_positive: float = 0.01) -> dict[str, Column]:
    """bits_per_key, hashes and bits for a number of entries."""
    ln2 = F.log(F.lit(2.0))
    per_key = -F.log(F.lit(false_positive)) / (ln2 * ln2)
    return {
        "bits_per_key": per_key,
        "hashes": F.greatest(F.lit(1), F.round(ln2 * per_key).cast("int")),
        "bits": F.greatest(F.lit(64).cast("long"), F.ceil(entries * per_key).cast("long")),
    }


def bloom_bits_of(key: Column, bits: Column, hashes: Column) -> Column:
    """The bits a key sets: double hashing with an odd step, in 31-bit numbers so that nothing overflows."""
    one = F.xxhash64(key).bitwiseAND(F.lit(0x7FFFFFFF))
    two = F.xxhash64(key, F.lit(1)).bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), hashes - 1), lambda i: F.pmod(one + i.cast("long") * two, bits))


def md5_bits_of(key: Column, bits: Column, hashes: Column) -> Column:
    """The same from two parts of an MD5 digest, for filters that other engines are to read as well."""
    part = lambda at: F.conv(F.substring(F.md5(key.cast("binary")), at, 7), 16, 10).cast("long")
    one, two = part(1), part(9).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), hashes - 1), lambda i: F.pmod(one + i.cast("long") * two, bits))
