"""An inverted index that a stream of additions, updates and deletions keeps up to date, in immutable segments.

A micro-batch writes one segment: the postings of its documents, each with the number of the batch, and a row for each document that it
names (deleted or not). Nothing older is touched: postings are live if their batch is the last one that names their document
and did not delete it, so that rows of newer segments are the tombstones of older ones. As soon as FAN segments of a level have gathered
they are merged into one of the next level, which drops what its own rows supersede; a posting is rewritten once a level,
so that what is written stays in proportion to the batches, times the logarithm of their number.

Each version has a list of its segments, derived from the list of the version before. A batch that is replayed after a failure
writes the same segments and the same list again. Old segments stay for readers of older versions until `vacuum`.

Rows (doc_id, text) with an optional boolean `deleted`; of several rows of one id in a batch the largest (deleted, text) counts. A null
text has no words; rows without an id are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import tokens

FAN = 4
_POSTINGS, _DOCS = "term string, doc_id long, tf long, batch long", "doc_id long, batch long, deleted boolean"
_LIST = "name string, level int"


def segments(spark: SparkSession, path: str, version: int) -> list[tuple[str, int]]:
    """(name, level) of the segments of a version, oldest first; version 0 is empty."""
    rows = spark.read.schema(_LIST).json(f"{path}/versions/{version}").collect() if version else []
    return sorted(((r.name, r.level) for r in rows), key=lambda s: s[0])


def _read(spark: SparkSession, path: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(postings, documents) of some segments, and nothing else of the index."""
    if not names:
        return spark.createDataFrame([], _POSTINGS), spark.createDataFrame([], _DOCS)
    return spark.read.schema(_POSTINGS).parquet(*(f"{path}/segments/{n}/postings" for n in names)), spark.read.schema(_DOCS).parquet(*(f"{path}/segments/{n}/docs" for n in names))


def _last(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_id").agg(F.max(F.struct("batch", "deleted")).alias("x")).select("doc_id", "x.batch", "x.deleted")


def _write(path: str, name: str, rows: DataFrame, docs: DataFrame) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/segments/{name}/postings")
    docs.write.mode("overwrite").parquet(f"{path}/segments/{name}/docs")


def counted(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of documents with unique ids: words are counted as runs of the sorted words of a row, so that no table of words is held or shuffled."""
    rows = docs.select("doc_id", F.array_sort(tokens(F.col("text"))).alias("w")).where("size(w) > 0")
    ends = rows.select("doc_id", "w", F.expr("filter(sequence(1, size(w)), i -> i = size(w) or w[i - 1] <> w[i])").alias("ends"))
    found = ends.select("doc_id", F.explode(F.expr("transform(ends, (e, j) -> named_struct('term', w[e - 1], 'tf', cast(e - if(j = 0, 0, ends[j - 1]) as long)))")).alias("x"))
    return found.select("x.term", "doc_id", "x.tf")


def ingest(batch: DataFrame, path: str, version: int, fan: int = FAN) -> None:
    """Write version + 1 of the index from a version and a batch of documents."""
    spark = batch.sparkSession
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
    rows = batch.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.struct(gone.alias("deleted"), "text")).alias("x")).select("doc_id", "x.deleted", "x.text")
    rows = rows.withColumn("batch", F.lit(version).cast("long"))
    own = counted(rows.where("not deleted")).select("term", "doc_id", "tf", F.lit(version).cast("long").alias("batch"))
    name = f"{version:012d}-0"
    _write(path, name, own, rows.select("doc_id", "batch", "deleted"))
    now, level = [*segments(spark, path, version), (name, 0)], 0
    while len(some := [n for n, at in now if at == level]) >= fan:
        old, docs = _read(spark, path, some)
        docs, level = _last(docs), level + 1
        name = f"{version:012d}-{level}"
        live = old.join(docs.where("not deleted").select("doc_id", "batch"), ["doc_id", "batch"], "left_semi")
        _write(path, name, live.select("term", "doc_id", "tf", "batch"), docs)
        now = [s for s in now if s[0] not in some] + [(name, level)]
    spark.createDataFrame(now, _LIST).coalesce(1).write.mode("overwrite").json(f"{path}/versions/{version + 1}")


def index(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(term, doc_id, tf): the live postings of a version."""
    rows, docs = _read(spark, path, [n for n, _ in segments(spark, path, version)])
    live = _last(docs).where("not deleted").select("doc_id", "batch")
    return rows.join(live, ["doc_id", "batch"], "left_semi").select("term", "doc_id", "tf")


def vacuum(spark: SparkSession, path: str, version: int) -> list[str]:
    """Delete the segments that the given version, now the oldest to be read, and later ones no longer name; returns their names."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segments")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = {n for n, _ in segments(spark, path, version)}
    names = sorted(f.getPath().getName() for f in fs.listStatus(fs_path))
    old = [n for n in names if n not in kept and int(n.split("-")[0]) < version]
    for n in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segments/{n}"), True)
    return old


def maintain(docs: DataFrame, path: str, checkpoint: str, fan: int = FAN):
    """Start a query that ingests each micro-batch of a stream; batch n makes version n + 1."""
    return docs.writeStream.foreachBatch(lambda batch, number: ingest(batch, path, number, fan)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
