"""A corpus pipeline of five stages, each over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last have
the columns of ``documents``.  Between stages the table is written as Parquet
and read again; a stage begins by deleting what the stage before it has left in the
shared folder.  The verdict of the quality rules and the language model are fitted to the
documents that reach the stage, so SQL can't express the whole: ORACLE_SQL is None.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelog.llm import language_id, packing, quality_rules, simhash_forest, substring_dedup
from brinelog.llm.common import Scratch, owned
from brinelog.llm.registry import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ORACLE_SQL: str | None = None
_LEFT: dict[str, Scratch] = {}


def _stage(f: Stage) -> Stage:
    """Delete what the stage before left behind its result, which is written by now."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        _LEFT.setdefault(app, Scratch(spark)).drop()
        if f is packed:
            return f(spark, docs, sf_dir)
        with owned(_LEFT[app]):
            return f(spark, docs, sf_dir)

    return run


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject."""
    return quality_rules.good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told."""
    return language_id.accepted(docs, language_id.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return simhash_forest.one_of_each(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages that start in an earlier document; ``n_chars`` follows the text.  Every document stays, with an empty text if nothing is left."""
    return substring_dedup.cleaned(docs, emptied=True).withColumn("n_chars", F.char_length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1,024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [(name, _stage(f)) for name, f in (("quality rules", quality), ("language ID", language), ("near-dedup", near_dedup), ("substring dedup", substring), ("packing", packed))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = [Scratch(spark), Scratch(spark)]
    for name, stage in STAGES[:-1]:
        docs = kept[0].written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        kept.reverse()
        kept[0].drop()
    return STAGES[-1][1](spark, docs, sf_dir)
