"""Readers and writers: books in CSV, documents in JSON, JSON lines, Parquet tables, run files, caches and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOOK_CSV = {"id": "bookId", "title": "title", "author": "author", "description": "description", "genres": "genres", "characters": "characters", "languages": "language", "publish_date": "publish_date", "num_pages": "num_pages", "avg_rating": "avg_rating"}
LISTS = ("genres", "characters", "languages")
INDEX_NAMES = ("documents", "characters", "genres", "description", "tiered", "document_length", "metadata")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    col = lambda c: F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("")
    out = []
    for name, source in BOOK_CSV.items():
        c = col(source)
        if name in LISTS:
            c = F.transform(F.split(c, ","), lambda x: F.trim(x))
        elif name == "num_pages":
            c = F.coalesce(F.expr("try_cast(try_cast(`num_pages` as double) as int)") if source in raw.columns else F.lit(None), F.lit(0)).cast("int")
        elif name == "avg_rating":
            c = F.coalesce(F.expr("try_cast(`avg_rating` as double)") if source in raw.columns else F.lit(None), F.lit(0.0))
        out.append(c.alias(name))
    return raw.select(*out)


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, also gzipped; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_runs(run: DataFrame, path: str, columns: list[str]) -> None:
    """One JSON object for each query, its results in rank order."""
    run.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("results")).write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(f"query_id string, results array<struct<rank:int,{columns}>>").json(path).select("query_id", F.explode("results").alias("r")).select("query_id", "r.*")


def store_index(index: DataFrame, path: str, name: str) -> str:
    """Write an index by field; unknown names are refused."""
    if name not in INDEX_NAMES:
        raise ValueError(f"no index named {name}")
    at = f"{path}/{name}_index"
    writer = index.write.mode("overwrite")
    (writer.partitionBy("field") if "field" in index.columns else writer).parquet(at)
    return at


def read_index(spark: SparkSession, path: str, name: str, field: str | None = None) -> DataFrame:
    """A field's part is read alone, by its partition."""
    if name not in INDEX_NAMES:
        raise ValueError(f"no index named {name}")
    df = spark.read.parquet(f"{path}/{name}_index")
    return df.where(F.col("field") == field) if field else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def write_json_array(df: DataFrame, path: str) -> None:
    """One file with a JSON array of all rows, for tables of a size that one task can write (reports, small catalogs)."""
    df.select(F.struct(*df.columns).alias("r")).agg(F.to_json(F.collect_list("r")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_image_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, height, width, path) of a (gzipped) CSV of images."""
    return spark.read.csv(path, header=True, schema="image_id string, height int, width int, path string")


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Listings, one JSON object a line, gzipped or not, whose texts come as arrays of (language_tag, value)."""
    text = "array<struct<language_tag:string,value:string>>"
    plain = "array<struct<value:string>>"
    return spark.read.schema(f"item_id string, item_name {text}, brand {text}, bullet_point {text}, product_description {text}, color {text}, material {text}, style {text}, product_type {plain}, item_keywords {text}, main_image_id string, node array<struct<node_name:string>>").json(path)


def aligned(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Stored vectors for exactly these ids: others are left out, and a missing or repeated id is refused."""
    x = ids.select("doc_id").distinct().join(vectors, "doc_id", "left")
    bad = x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count(vectors.columns[1]).alias("v")).where("n <> 1 or v <> 1").limit(1).count()
    if bad:
        raise ValueError("the index and the catalog have different ids")
    return x


def vocabulary_cache(docs: DataFrame, path: str) -> DataFrame:
    """The spelling vocabulary of the documents, read from its file if there is one, else built and stored."""
    from lexloom.operators.spell import vocabulary

    spark = docs.sparkSession
    try:
        return spark.read.parquet(path)
    except Exception as e:  # the first call finds no cache
        if "PATH_NOT_FOUND" not in str(e):
            raise
    vocabulary(docs).write.parquet(path)
    return spark.read.parquet(path)


def cached(queries: DataFrame, path: str, encode, found=None) -> DataFrame:
    """Vectors of the queries: those in the cache are read, the others are encoded and appended to it. Empty results, for
    which the condition `found` is false, are not kept, so that they are encoded again next time."""
    spark = queries.sparkSession
    try:
        old = spark.read.parquet(path)
        missing = queries.join(old, "query_id", "left_anti")
    except Exception as e:  # the first call finds no cache
        if "PATH_NOT_FOUND" not in str(e):
            raise
        missing = queries
    made = encode(missing)
    (made if found is None else made.where(found)).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(queries.select("query_id"), "query_id", "left_semi")


#: What an index manifest must name.
MANIFEST_FIELDS = ("num_products", "dense_model", "dense_input_format", "dense_embedding_policy", "manual_text_image_vector_mixing", "sparse_model", "dense_dimension", "sparse_top_n", "vector_store", "created_at")


def manifest(spark: SparkSession, fields: dict[str, str], path: str) -> None:
    """One JSON object with the index's properties; the required fields must be there."""
    if lacking := [f for f in MANIFEST_FIELDS if f not in fields]:
        raise ValueError(f"the manifest lacks {', '.join(lacking)}")
    spark.createDataFrame([tuple(map(str, fields.values()))], list(fields)).write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str, limit: int = 100) -> str:
    """A report's table of a small aggregate."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows) + "\n"


def write_markdown(df: DataFrame, title: str, path: str, limit: int = 100) -> None:
    """The report as one text file, through Spark's writer, so that any file system will do."""
    df.sparkSession.createDataFrame([(markdown(df, title, limit),)], "value string").coalesce(1).write.mode("overwrite").text(path)
