"""Connected components of a link table, by alternating large and small stars.

Links never leave the cluster: each round is two joins on the link table, written
to the shared folder, and stops when a round changes nothing.  Up to ``ONE_TASK`` links
are done by a single task instead, by hooking and pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written

#: Links that one task takes: 16 bytes each, a few times over.
ONE_TASK = 1_000_000


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Connect each node's larger (or smaller) neighbours with the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.where("b < a")
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = around.join(least, "a")
    if large:
        fresh = moved.where("b > a").select(F.col("m").alias("a"), "b")
    else:
        fresh = moved.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return fresh.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def least_of_component(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the smallest node that each is connected with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        high, low = np.maximum(up[x], up[y]), np.minimum(up[x], up[y])
        open_ = high != low
        x, y = x[open_], y[open_]
        np.minimum.at(up, high[open_], low[open_])
        while (up[up] != up).any():
            up = up[up]
    return nodes, nodes[up]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_of_component(a, b)], ["id", "class_id"])


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, class_id): the smallest id that links (a, b) connect each node with; nodes without links are left out."""
    now, before = Scratch(links.sparkSession), Scratch(links.sparkSession)
    links = now.written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        sums = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(sums) == state:
            break
        if state is None and sums[0] <= ONE_TASK:
            found = (scratch.written if scratch else written)(links.coalesce(1).mapInArrow(_in_one_task, "id long, class_id long"), "components")
            now.drop()
            return found
        state = tuple(sums)
        now, before = before, now
        links = now.written(_stars(_stars(links, True), False), "links")
        before.drop()
    # The last table stays behind the result.
    links = (scratch.written if scratch else written)(links, "components")
    now.drop()
    return links.select(F.col("b").alias("id"), F.col("a").alias("class_id")).unionByName(links.select(F.col("a").alias("id"), F.col("a").alias("class_id")).distinct())
