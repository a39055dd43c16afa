"""Helpers that several operators share: shared folder, Arrow plumbing, hashing."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII space, tab, newline, VT, FF and CR.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
#: Odd multiplier of the polynomial over bytes, and its inverse modulo 2**64.
BYTE_BASE = 0x9FB21C651E98DF25
BYTE_BASE_INV = pow(BYTE_BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one is set only if unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="brinelog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/brinelog-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_written(spark: SparkSession) -> None:
    """Delete everything this application has left in the shared folder."""
    delete(spark, own_dir(spark))


class Scratch:
    """Tables written in the shared folder: lineage ends there, on storage that outlives executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        path = f"{own_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        # Once the table is written nothing reads its shuffles again: they needn't wait for the driver's garbage collection.
        before = self.spark.conf.get(CLEAN_SHUFFLES, "false")
        self.spark.conf.set(CLEAN_SHUFFLES, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEAN_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the tables; nothing may read from them any more."""
        while self.paths:
            delete(self.spark, self.paths.pop())


_OWNER: ContextVar[Scratch | None] = ContextVar("owner", default=None)


@contextmanager
def owned(scratch: Scratch) -> Iterator[None]:
    """Within it, tables that results go on reading from belong to ``scratch``; else they stay until ``drop_written``."""
    token = _OWNER.set(scratch)
    try:
        yield
    finally:
        _OWNER.reset(token)


def written(df: DataFrame, name: str) -> DataFrame:
    """A written table that an operator's result still reads from."""
    return (_OWNER.get() or Scratch(df.sparkSession)).written(df, name)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), whatever else the table holds."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], text_col: int = 1, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text_col)
        off = offsets(col)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(off, off[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets (n + 1) of a string or binary array; nulls have length 0."""
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if large else np.int32
    raw = np.frombuffer(col.buffers()[1], dtype=kind, count=col.offset + len(col) + 1)
    return raw[col.offset :].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and offsets from 0; null counts as empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    off = offsets(col)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def give_back() -> None:
    """Return freed memory to the system, which glibc otherwise keeps for the process."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x + GOLDEN
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.full(size, U64(base), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each text (n + 1)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    word = ~IS_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    at = off[1:-1]
    at = at[(at > 0) & (at < len(raw))]
    first[at] = word[at]
    last[at - 1] = word[at - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def digests(values: Iterable[bytes]) -> np.ndarray:
    """(n, 2) uint64: 128 bits of BLAKE2b of each value."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in values), dtype="<u8").reshape(-1, 2)


def word_digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, 2) uint64: ``digests`` of all words of ``raw``, as ``word_spans`` finds them; each distinct word is digested once."""
    bytes_of_words = np.ascontiguousarray(raw[~IS_SPACE[raw]])
    off = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(bytes_of_words)]).dictionary_encode()
    return digests(words.dictionary.to_pylist())[words.indices.to_numpy()]


def window_hashes(words: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every ``size`` consecutive word hashes (across text ends too: callers mask those)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, size):
        h *= U64(base)
        h += words[k : k + n]
    return mix(h)


def squeeze(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as compressed gaps; numbers of any order and kind work too, less densely."""
    n, size = len(values), values.dtype.itemsize
    if not n:
        return b""
    gaps = values.copy()
    gaps[1:] -= values[:-1]
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(n, size).T)
    return n.to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def expand(data: bytes, dtype: str) -> np.ndarray:
    """What ``squeeze`` was given."""
    kind = np.dtype(dtype)
    if not data:
        return np.zeros(0, kind)
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], n * kind.itemsize, "zstd", asbytes=True)
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(kind.itemsize, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind)[:, 0], dtype=kind)


def in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def carried(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[Column], str]:
    """(doc_id, text, _0, _1, ...) with all other columns under neutral names; what restores the columns of ``df``; schema of the neutral ones."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(others)))
    back = {id_col: "doc_id", text_col: "text"} | {c: f"_{k}" for k, c in enumerate(others)}
    kinds = {c: rows.schema[name].dataType.simpleString() for c, name in back.items()}
    return rows, [F.col(back[c]).alias(c) for c in df.columns], "".join(f", {back[c]} {kinds[c]}" for c in others)


def blocked(df: DataFrame, block_bytes: int) -> tuple[DataFrame, int, int]:
    """A table with doc_id and text, hashed into ``block``s of about ``block_bytes`` of text and partitioned by block; all bytes of text; the number of blocks.

    Later steps group by block, so that they share one shuffle of the texts.
    """
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    docs = df.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"), "*")
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(max(1, min(n_blocks, max(default, n_blocks // 8))), "block"), total, n_blocks
