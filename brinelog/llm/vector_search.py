"""Operator 10: nearest neighbours by a block matrix join.

Vectors of one length are put into blocks.  A tile is one block of queries
against one block of candidates: both are scaled to int8, the product of the
codes gives approximate cosines, and the exact norms of what rounding took away
bound the error.  Only pairs whose upper bound reaches the query's current k-th
best are computed again from the original vectors in double precision, and go
to the query's heap.  A task streams candidate blocks past a group of ``GROUP`` query blocks, so that
candidates are sent once per group, and holds the group and one candidate block; the heaps of the tasks are merged at the end.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part; vectors of different lengths never meet; ties go to
the smaller id; a query never finds rows with its own id; repeated rows are
candidates each, and repeated query rows are answered each; rows with null id
take no part; extra columns are not looked at; an empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in a block; query blocks in a group, about.
BLOCK, GROUP = 2048, 16
FOUND = "query_id long, query_row long, vec_id long, cand_row long, score double"
BLOCKS = "dim int, block long, ids binary, rows binary, vectors binary"


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, row, v array<double>) of the vectors that take part; row tells repeated rows apart."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["dim", "block", "ids", "rows", "vectors"]
    for b in batches:
        sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            of = b.filter(pa.array(sizes == dim))
            for k in range(0, of.num_rows, BLOCK):
                part = of.slice(k, BLOCK)
                blob = [part.column(c).to_numpy(zero_copy_only=False).astype("<i8").tobytes() for c in (0, 1)]
                blob.append(part.column(2).flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes())
                uid = part.column(1)[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([uid], pa.int64()), *(pa.array([x], pa.binary()) for x in blob)], names)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.frombuffer(row["vectors"], dtype="<f8").reshape(-1, row["dim"])
    return np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["rows"], dtype="<i8"), v


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, the step of each, and the norm of what rounding took away."""
    top = np.abs(v).max(axis=1, keepdims=True)
    unit = v / top
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    step = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / step)
    lost = np.sqrt(((unit - codes * step) ** 2).sum(axis=1))
    return codes.astype(np.int8), step[:, 0], lost


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of a[i] and b[i], added up in order of the components."""
    dot, na, nb = (np.zeros(len(a)) for _ in range(3))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for d in range(a.shape[1]):
            x, y = a[:, d], b[:, d]
            dot += x * y
            na += x * x
            nb += y * y
        score = dot / np.sqrt(na * nb)
        odd = ~np.isfinite(score) | (na * nb < 1e-290)
    if odd.any():  # squares that leave the range of doubles
        p, q = a[odd] / np.abs(a[odd]).max(axis=1, keepdims=True), b[odd] / np.abs(b[odd]).max(axis=1, keepdims=True)
        score[odd] = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
    return np.clip(score, -1.0, 1.0)


class Tiles:
    """Heaps of one query block, fed with candidate blocks."""

    def __init__(self, row: dict, k: int) -> None:
        self.ids, self.rows, self.v = _unpack(row)
        self.codes, self.step, self.lost = quantise(self.v)
        self.k = k
        self.heaps: list[list[tuple[float, int, int]]] = [[] for _ in self.ids]

    def add(self, row: dict) -> None:
        ids, rows, v = _unpack(row)
        codes, step, lost = quantise(v)
        # Products of int8 codes are whole numbers below 2**53: the float product is exact.
        kind = np.float32 if self.v.shape[1] * 127 * 127 < 1 << 24 else np.float64
        near = (self.codes.astype(kind) @ codes.astype(kind).T) * self.step[:, None] * step[None, :]
        slack = self.lost[:, None] * (1 + lost[None, :]) + lost[None, :] + 1e-6
        own = self.ids[:, None] == ids[None, :]
        low = np.where(own, -np.inf, near - slack)
        floor = np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.heaps])
        if low.shape[1] >= self.k:
            floor = np.maximum(floor, np.partition(low, -self.k, axis=1)[:, -self.k])
        q, c = np.nonzero((near + slack >= floor[:, None]) & ~own)
        scores = exact_cosines(self.v[q], v[c])
        for i, s, vec, r in zip(q.tolist(), scores.tolist(), ids[c].tolist(), rows[c].tolist(), strict=True):
            item = (s, -vec, -r)
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)

    def found(self) -> pa.RecordBatch:
        flat = [(int(self.ids[i]), int(self.rows[i]), -v, -r, s) for i, h in enumerate(self.heaps) for s, v, r in h]
        cols = list(zip(*flat, strict=True)) or [(), (), (), (), ()]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.float64())], ["query_id", "query_row", "vec_id", "cand_row", "score"])


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest candidates of each query by cosine: query_id, rank, vec_id, score."""
    spark = candidates.sparkSession
    mine, theirs = usable(queries, id_col, vec_col), usable(candidates, id_col, vec_col)
    n_queries = mine.count()
    n_blocks = max(1, -(-n_queries // BLOCK))
    n_groups = -(-n_blocks // GROUP)
    lanes = max(1, -(-2 * spark.sparkContext.defaultParallelism // n_groups))
    salted = mine.withColumn("block_key", F.pmod(F.xxhash64("id", "row"), F.lit(n_blocks)).cast("int"))
    # A query block is a row: its size is that of BLOCK vectors, whatever the corpus.
    grouped = salted.repartition(n_blocks, "block_key").sortWithinPartitions("block_key").select("id", "row", "v").mapInArrow(_blocks, BLOCKS)
    # Written, so that both uses below see the same blocks (a repeated shuffle may order rows otherwise).
    numbered = written(grouped, "query-blocks").withColumn("query_group", F.pmod(F.xxhash64("block"), F.lit(n_groups)).cast("int"))
    keys = numbered.select("dim", "query_group").distinct()
    names = ["dim", "query_group", "lane", "kind", "ids", "rows", "vectors"]
    left = numbered.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("kind", F.lit(0)).select(*names)
    right = theirs.mapInArrow(_blocks, BLOCKS).withColumn("lane", F.pmod(F.xxhash64("dim", "block"), F.lit(lanes)).cast("int"))
    right = right.join(F.broadcast(keys) if n_groups <= 10_000 else keys, "dim").withColumn("kind", F.lit(1)).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: list[Tiles] = []
        held = None
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                at = row["dim"], row["query_group"], row["lane"]
                if at != held:
                    yield from (t.found() for t in tiles)
                    tiles, held = [], at
                if row["kind"] == 0:
                    tiles.append(Tiles(row, k))
                else:
                    for t in tiles:
                        t.add(row)
        yield from (t.found() for t in tiles)

    key = ["dim", "query_group", "lane"]
    parts = left.unionByName(right).repartition(n_groups * lanes, *key).sortWithinPartitions(*key, "kind").mapInArrow(run, FOUND)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "cand_row")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
