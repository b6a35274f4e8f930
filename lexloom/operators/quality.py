"""Checks of catalogs, rankings and answers, as one row of booleans each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators import blocks
from lexloom.operators.answers import DECISIONS, FORBIDDEN, MIN_WORDS, ROLES
from lexloom.operators.evalir import METRICS
from lexloom.operators.fusion import NONZERO, RUNS, dot
from lexloom.sources.tables import MANIFEST_FIELDS


def _all(c) -> F.Column:
    return F.coalesce(F.bool_and(c), F.lit(True))


def catalog_checks(catalog: DataFrame) -> DataFrame:
    """Stage 0, of (product_id, title, product_type, product_text) and main_image_id, if it has one."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    image = [_all(filled("main_image_id")).alias("images_filled")] if "main_image_id" in catalog.columns else []
    return catalog.agg(
        _all(filled("product_id")).alias("ids_filled"),
        *image,
        (F.count(F.lit(1)) > 0).alias("has_rows"),
        (F.countDistinct("product_id") == F.count(F.lit(1))).alias("unique_ids"),
        _all(filled("title")).alias("titles_filled"),
        _all(filled("product_text")).alias("texts_filled"),
        (F.countDistinct("product_type") > 1).alias("several_types"),
        (F.avg(F.when(F.length("product_text") > F.length("title"), 1.0).otherwise(0.0)) > 0.9).alias("texts_longer"),
    )


def ranking_checks(run: DataFrame, ids: DataFrame) -> DataFrame:
    """Ranks run 1..n, ids are unique by query and known, scores fall with the rank."""
    w = Window.partitionBy("query_id").orderBy("rank")
    x = run.join(ids.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left").withColumns({"i": F.row_number().over(w), "before": F.lag("score").over(w)})
    return x.agg(_all(F.col("rank") == F.col("i")).alias("ranks_dense"), _all(F.coalesce("known", F.lit(False))).alias("ids_known"), _all(F.coalesce(F.col("before") >= F.col("score"), F.lit(True))).alias("scores_fall"), (F.countDistinct("query_id", "doc_id") == F.count(F.lit(1))).alias("ids_unique"))


def index_checks(catalog: DataFrame, dense: DataFrame, sparse: DataFrame, manifest: DataFrame, k: int = 5) -> DataFrame:
    """Stage 1, of catalog ids (doc_id), dense vectors (doc_id, v), sparse ones (doc_id, term, w) and a manifest row: the same
    ids once each on all sides, dense norms near 1, 1 to 128 positive weights a document, the manifest's fields, and, of the k
    documents with the smallest ids, each among the k nearest to its own dense vector and first for its own sparse one."""
    ids = catalog.select("doc_id").distinct()
    norm = F.sqrt(dot("v", "v"))
    aligned = ids.join(dense.select("doc_id"), "doc_id", "full_outer").agg(F.count(F.lit(1)).alias("a")).crossJoin(ids.agg(F.count(F.lit(1)).alias("b"))).crossJoin(dense.agg(F.count(F.lit(1)).alias("c")))
    n = sparse.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("w"))
    bounds = n.agg(_all(F.col("n").between(1, NONZERO)).alias("nonzero_bounded"), _all(F.col("w") > 0).alias("weights_positive"))
    fields = [f for f in MANIFEST_FIELDS if f not in manifest.columns]
    unit = dense.agg(_all(F.abs(norm - 1) <= 0.01).alias("norms_one"))
    probes = n.select(F.col("doc_id").alias("query_id")).orderBy("query_id").limit(k)  # a few self-retrievals, as a smoke check
    q = sparse.join(probes, F.col("doc_id") == F.col("query_id")).select("query_id", "term", F.col("w").alias("qw"))
    own = sparse.join(q, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("score")).withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where("query_id = doc_id")
    found = own.agg(_all(F.col("rank") == 1).alias("finds_itself"))
    asked = dense.orderBy("doc_id").limit(k).select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    others = blocks.best(asked, dense, k, cosine=False).join(asked.select("query_id", F.round(dot("q", "q"), 5).alias("own")), "query_id")
    before = others.where("score > own").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    near = before.agg(_all(F.col("n") < k).alias("finds_itself_dense"))
    return aligned.select((F.col("a") == F.col("b")).alias("same_ids"), (F.col("c") == F.col("b")).alias("ids_once")).crossJoin(unit).crossJoin(bounds).crossJoin(found).crossJoin(near).withColumn("manifest_complete", F.lit(not fields))


def retrieval_checks(retrieved: DataFrame, queries: DataFrame, catalog: DataFrame, score: str = "score", rank: str = "rank") -> DataFrame:
    """Stage 2, of (query_id, query_type, doc_id, dense, sparse, ...): ranks 1..n with falling scores, products once a query,
    known products, queries and types as given, every query answered, and a sparse score unless the query is an image."""
    w = Window.partitionBy("query_id").orderBy(rank)
    x = retrieved.join(catalog.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left").join(queries.select("query_id", F.col("query_type").alias("_kind")), "query_id", "left")
    x = x.withColumns({"i": F.row_number().over(w), "before": F.lag(score).over(w)})
    lacking = queries.join(retrieved.select("query_id").distinct(), "query_id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("all_answered"))
    return x.agg(
        _all(F.col(rank) == F.col("i")).alias("ranks_dense"),
        _all(F.coalesce(F.col("before") >= F.col(score), F.lit(True))).alias("scores_fall"),
        (F.countDistinct("query_id", "doc_id") == F.count(F.lit(1))).alias("ids_unique"),
        _all(F.coalesce("known", F.lit(False))).alias("ids_known"),
        _all(F.coalesce(F.col("query_type") == F.col("_kind"), F.lit(False))).alias("types_match"),
        _all(F.col("sparse").isNull() == (F.col("query_type") == "image")).alias("sparse_null_for_images"),
    ).crossJoin(lacking)


def rerank_checks(reranked: DataFrame, retrieved: DataFrame, queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stage 3: the checks of stage 2 by final rank, results out of the retrieved pool, and scores of model and fusion present."""
    base = retrieval_checks(reranked, queries, catalog, "final", "final_rank")
    outside = reranked.join(retrieved.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").agg((F.count(F.lit(1)) == 0).alias("within_pool"))
    scores = reranked.agg(_all(F.col("ce").isNotNull() | (F.col("query_type") == "image")).alias("model_scores"), _all(F.col("final").isNotNull()).alias("final_scores"))
    return base.crossJoin(outside).crossJoin(scores)


def evaluation_checks(table: DataFrame, pool: DataFrame, qrels: DataFrame, runs: tuple[str, ...] = RUNS, low: int = 10, high: int = 50) -> DataFrame:
    """Stage 4, of the metrics table, the pool (query_id, doc_id) and qrels (query_id, doc_id, rel): metrics within 0 and 1,
    a row over all types for each run and none of image queries for runs on text, each query's pool of low to high products,
    judgments once each, graded 0 to 2."""
    inside = table.agg(_all(F.forall(F.array(*METRICS), lambda v: v.between(0.0, 1.0))).alias("metrics_in_range"), _all(F.col("num_queries") > 0).alias("queries_positive"), _all(~(F.col("run").isin(RUNS[1], RUNS[3]) & (F.col("query_type") == "image"))).alias("text_runs_without_images"), F.countDistinct(F.when(F.col("query_type") == "all", F.col("run"))).alias("r"))
    sizes = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(_all(F.col("n").between(low, high)).alias("pool_sizes"))
    judged = qrels.agg((F.countDistinct("query_id", "doc_id") == F.count(F.lit(1))).alias("judged_once"), _all(F.coalesce(F.col("rel").between(0, 2), F.lit(False))).alias("grades_valid"))
    return inside.withColumn("runs_complete", F.col("r") == len(runs)).drop("r").crossJoin(sizes).crossJoin(judged)


def answer_checks(validated: DataFrame) -> DataFrame:
    """Stage 5, of validated answers; with judged products and retrieved ones (arrays), those must be among the first eight."""
    words = F.size(F.filter(F.split("customer_response", r"\s+"), lambda w: w != ""))
    low = F.lower("customer_response")
    clean = F.lit(True)
    for term in FORBIDDEN:
        clean = clean & ~F.contains(low, F.lit(term))
    labels = F.forall(F.split("roles", ","), lambda r: r.isin(*ROLES))
    more = [_all(F.forall("judged", lambda p: F.array_contains(F.slice("products", 1, 8), p))).alias("ids_in_first_eight")] if {"judged", "products"} <= set(validated.columns) else []
    return validated.agg(_all(labels).alias("roles_valid"), _all(F.col("decision").isin(*DECISIONS)).alias("decisions_valid"), _all(F.col("query_id").isNotNull()).alias("ids_filled"), *more, _all(words >= MIN_WORDS).alias("long_enough"), _all(clean).alias("no_commerce_terms"), _all(F.col("n_judgements") >= 1).alias("judged"))


def stratified(rows: DataFrame, c: str, key: str, cap: int, total: int) -> DataFrame:
    """At most `cap` rows of each class in the order of a hash of the key, `total` rows in all in the order of that hash."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    x = rows.withColumn("h", h).withColumn("i", F.row_number().over(Window.partitionBy(c).orderBy("h", key)))
    return x.where(F.col("i") <= cap).orderBy("h", key).limit(total).drop("i", "h")
