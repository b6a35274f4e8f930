"""What a session needs: the shared work folder, and this package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode, where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="lexloom-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_MADE: list[str] = []
_HADOOP: list = []  # the session's file system settings, which outlive it


def _remove_made() -> None:
    """Delete this process's tables in the shared folder, whether its session still runs or was stopped."""
    if (jvm := SparkContext._jvm) is None:
        return
    spark = SparkSession.getActiveSession()
    for path in _MADE:
        if spark and (name := path.rsplit("/", 1)[-1]).startswith("lexloom_"):  # a bucketed table has an entry in the catalog
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(_HADOOP[-1]).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    if not _MADE:
        atexit.register(_remove_made)
    _HADOOP[:] = [spark._jsc.hadoopConfiguration()]
    _MADE.append(f"{work_dir(spark)}/{name}")
    return _MADE[-1]


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors. The table goes when
    the process ends. With `by`, rows of other values of that column are not read where a filter names some."""
    spark = df.sparkSession
    path = new_path(spark, f"lexloom-{uuid.uuid4().hex}")
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FEW = 1 << 18


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """A stored table that is broadcast if it has few rows, as what queries ask for has; with more rows it is joined as any other."""
    df = stored(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


SMALL_PART = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of less than SMALL_PART for each core, which may lie in one row group, is dealt over all cores; others are read as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_PART else df


_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, and keep Arrow batches small where the session sets no size."""
    for key, value in _BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    sc = spark.sparkContext
    if getattr(sc, "_lexloom_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lexloom-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/lexloom_pkg.zip", "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(top)))
    sc.addPyFile(f"{folder}/lexloom_pkg.zip")
    sc._lexloom_shipped = True
