"""Incremental index maintenance: a stream of documents upserted into stored postings, one version a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.index import add, postings


def maintain(docs: DataFrame, path: str, checkpoint: str):
    """Start a query that writes version n + 1 of the postings under `path` for each micro-batch of (doc_id, text)."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch = batch.dropDuplicates(["doc_id"])
        new = postings(batch)
        old = latest(spark, path, number)
        (add(old, new, batch) if old is not None else new).write.mode("overwrite").parquet(f"{path}/v={number + 1}")

    return docs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    return spark.read.parquet(f"{path}/v={version}") if version else None


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts with a watermark, for batch and stream alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
