"""A training-corpus pipeline: each stage works on all that the one before it kept.

Rows that share a doc_id stand or fall together where a stage drops documents by id; rows without an id are judged
with the others, and only a stage that drops by id keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, jaccard_join, line_dedup, pieces, quality_rules
from lexloom.llm.common import attach, stored


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose id is not among the dropped ones."""
    ids = stored(dropped.select("doc_id").where("doc_id is not null").distinct())
    return attach(docs, ids, "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules and the isolation forest: documents that they reject go."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: chunks of lines that an earlier document has are cut out of the texts."""
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the document with the smallest id of each group stays."""
    return _without(docs, jaccard_join.near_duplicates(docs).where("not (doc_id <=> component_id)"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go."""
    return _without(docs, decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece encoding: the ids of the best segmentation of each text, and the figures of the N best."""
    return pieces.encode(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("piece_encoding", encode),
]

#: SQL can't express the isolation forest or the N-best search; tests/llm checks the pipeline stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each stored in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
