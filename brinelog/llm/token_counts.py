"""Operator 1: token counts as rollups that are maintained by deltas.

``Ledger`` keeps signed rows per document in one folder per committed batch.
A batch of changes (insert, delete, revise) is joined by doc_id with the live
rows it touches; each change gives at most one row with sign -1 (what it takes
back) and one with sign +1 (what it adds).  Next to them lies the batch's
delta: additive totals by source, language and tokenizer version.  A batch is
written under a temporary name and becomes visible by one rename, and a batch
id that is already there is left alone, so a batch may be sent any number of
times.  Totals are the sums of the deltas; ``compact`` adds them up once into a
snapshot that names the batches it holds, together with the rows that are live then, so that later
commits and totals read the snapshot and the batches after it only.  A ledger has one writer at a time: a commit that finds
another batch committed since it began is given up, and may be sent again.

Defined results: null text has 0 tokens; null source or language is a group of
its own; deleting or revising an unknown document deletes nothing (a revision
inserts); inserting a live document revises it; if one batch holds several
changes of one document, the one with the highest ``change_no`` counts, and on
ties, or without ``change_no``, the greatest by (op, text, source, lang); rows with null doc_id are
counted, but can't be addressed later; an unknown op fails the batch; extra
columns are not looked at; an empty batch commits an empty delta.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .common import own_dir, slices

ROWS = "doc_id long, source string, lang string, tokenizer string, sign int, n_tokens long"
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
KEYS = ["source", "lang", "tokenizer"]


def counted(df: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, lang, op, n_tokens): the tokens of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for b in slices(batches):
            n = pa.array([len(bpe.encode(x or "")) for x in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), n], ["doc_id", "source", "lang", "op", "n_tokens"])

    picked = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("op").cast("string"))
    return picked.mapInArrow(run, "doc_id long, source string, lang string, op string, n_tokens long")


class Ledger:
    """Signed document rows and rollup deltas in a folder, by batch."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{own_dir(spark)}/token-ledger-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(n[len("batch=") :] for n in names if n.startswith("batch="))

    def _read(self, kind: str, schema: str, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/batch={b}/{kind}" for b in batches])

    def live(self) -> DataFrame:
        """(doc_id, source, lang, tokenizer, n_tokens) of the documents that count now."""
        rows = self._since("rows", ROWS)
        return rows.groupBy("doc_id", *KEYS, "n_tokens").agg(F.sum("sign").alias("copies")).where("copies > 0")

    def commit(self, batch_id: str, changes: DataFrame, tokenizer: str, version: str) -> bool:
        """Apply changes (doc_id, op, text, source, lang, optional change_no); False if the batch was there already."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
            raise ValueError("a batch id holds letters, digits, _ . and - only")
        if batch_id in self.batches():
            return False
        before = self.batches()
        op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.lit("op must be insert, delete or revise")))
        changes = changes.withColumn("op", op)
        numbered = "change_no" in changes.columns
        if numbered or changes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
            changes = changes if numbered else changes.withColumn("change_no", F.lit(None).cast("long"))
            last = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("change_no"), F.desc("op"), F.desc("text"), F.desc("source"), F.desc("lang"))
            keyed = changes.where("doc_id IS NOT NULL").withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
            changes = keyed.unionByName(changes.where("doc_id IS NULL"))
        fresh = counted(changes, tokenizer)
        added = fresh.where("op <> 'delete'").select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.lit(1).alias("sign"), "n_tokens")
        rows = added
        if before:
            touched = changes.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
            taken = self.live().where(F.col("tokenizer") == version).join(touched, "doc_id", "left_semi")
            rows = rows.unionByName(taken.select("doc_id", *KEYS, (-F.col("copies")).cast("int").alias("sign"), "n_tokens"))
        part = f"{self.path}/_tmp-{uuid.uuid4().hex}"
        rows.write.parquet(f"{part}/rows")
        done = self.spark.read.schema(ROWS).parquet(f"{part}/rows")
        done.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")).write.parquet(f"{part}/delta")
        if self.batches() != before:
            self._fs.delete(self._path(part), True)
            raise RuntimeError(f"another batch was committed while {batch_id} was prepared; send it again")
        if not self._fs.rename(self._path(part), self._path(f"{self.path}/batch={batch_id}")):
            raise OSError(f"batch {batch_id} can't be committed")
        return True

    def _snapshots(self) -> list[str]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.path))]
        return sorted(n for n in names if n.startswith("snapshot="))

    def _since(self, kind: str, schema: str) -> DataFrame:
        """The rows of the last snapshot and of the batches that it doesn't hold."""
        marks, batches = self._snapshots(), self.batches()
        if not marks:
            return self._read(kind, schema, batches)
        held = set(json.loads(self.spark.read.text(f"{self.path}/{marks[-1]}/held", wholetext=True).first()[0]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/{marks[-1]}/{kind}").unionByName(self._read(kind, schema, [b for b in batches if b not in held]))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens), groups without documents left out."""
        sums = self._since("delta", DELTA).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Add up the deltas of all batches into a snapshot, with the rows that are live."""
        held, n = self.batches(), len(self._snapshots())
        part = f"{self.path}/_tmp-{uuid.uuid4().hex}"
        self.totals().coalesce(1).write.parquet(f"{part}/delta")
        self.live().select("doc_id", *KEYS, F.col("copies").cast("int").alias("sign"), "n_tokens").write.parquet(f"{part}/rows")
        self.spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.text(f"{part}/held")
        if not self._fs.rename(self._path(part), self._path(f"{self.path}/snapshot={n:08d}")):
            raise OSError("the snapshot can't be written")
