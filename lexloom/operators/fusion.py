"""Dense and sparse top-k search, score fusion, reranking and judgment pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators import blocks
from lexloom.operators.index import top

K, RRF, NONZERO = 100, 60, 128
# The five orderings compared, and fusion weights (cross-encoder, dense, sparse) by query type.
RUNS = ("dense_single_vector", "sparse_splade", "hybrid_prefusion", "hybrid_cross_encoder", "hybrid_cross_encoder_fused")
WEIGHTS = {"text": (0.4, 0.3, 0.3), "image": (0.0, 1.0, 0.0), "image_text": (0.3, 0.4, 0.3)}


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """Exact inner product of a stated query set (query_id, q) against all rows (doc_id, v), best k by query."""
    return top(blocks.best(queries, vectors, k, cosine=False), k)


def sparse_vectors(p: DataFrame, n_docs: DataFrame, keep: int = NONZERO) -> DataFrame:
    """(doc_id, term, w): the `keep` largest tf-idf weights of each document."""
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = p.join(df.hint("merge"), "term").crossJoin(F.broadcast(n_docs)).select("doc_id", "term", F.round((1 + F.log10("tf")) * F.log10(F.col("n") / F.col("df")), 6).alias("w")).where("w > 0")
    return top(w, keep, "doc_id", "w", "term").drop("rank")


def sparse_search(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """Queries (query_id, term, qw) against (doc_id, term, w), weights of each term once, best k by query. Blocks of queries meet blocks of
    rows, so that hits are added up and cut at k where they arise; no table of all pairs that share a term is made."""
    return top(blocks.sparse_best(queries, vectors, k), k)


def merged(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(query_id, doc_id, dense, sparse, dense_rank, sparse_rank), null where a side lacks the document."""
    d = dense.select("query_id", "doc_id", F.col("score").alias("dense"), F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "doc_id", F.col("score").alias("sparse"), F.col("rank").alias("sparse_rank"))
    return d.join(s, ["query_id", "doc_id"], "full_outer")


def with_source(both: DataFrame) -> DataFrame:
    """Adds source: which of dense and sparse found the document, in this order, joined by a comma."""
    return both.withColumn("source", F.concat_ws(",", F.when(F.col("dense").isNotNull(), "dense"), F.when(F.col("sparse").isNotNull(), "sparse")))


def for_types(both: DataFrame, types: DataFrame) -> DataFrame:
    """Adds each query's query_type; queries without text have no sparse side: its hits go, and scores are null."""
    typed = both.join(types.select("query_id", "query_type"), "query_id").withColumn("_s", sparse_applies(F.col("query_type")))
    own = {c: F.when(F.col("_s"), F.col(c)) for c in ("sparse", "sparse_rank")}
    return typed.withColumns(own).where("_s or dense is not null").drop("_s")


def sparse_applies(query_type: Column) -> Column:
    return query_type.isin("text", "image_text")


def retrieve(both: DataFrame, types: DataFrame, method: str = "rrf", k: int = K) -> DataFrame:
    """Stage 2: the candidates with source and prefusion score by each query's type, ranked. Absent dense scores count 0;
    absent sparse scores too, but for image queries, where they stay null and the dense score alone ranks."""
    typed = for_types(both, types)
    scored = rrf(typed) if method == "rrf" else weighted(typed).withColumn("score", F.when(sparse_applies(F.col("query_type")), F.col("score")).otherwise(F.round("dn", 6)))
    x = top(with_source(scored), k)
    filled = {"dense": F.coalesce("dense", F.lit(0.0)), "sparse": F.when(sparse_applies(F.col("query_type")), F.coalesce("sparse", F.lit(0.0)))}
    return x.withColumns(filled).select("query_id", "query_type", "doc_id", "dense", "sparse", "source", "score", "rank")


def retrieval_summary(retrieved: DataFrame) -> DataFrame:
    """By query type and for all: queries, mean candidates and mean candidates of both sources."""
    per = retrieved.groupBy("query_id", "query_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("source") == "dense,sparse", 1).otherwise(0)).alias("b"))
    out = per.rollup("query_type").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("n"), 4).alias("candidates"), F.round(F.avg("b"), 4).alias("in_both"))
    return out.withColumn("query_type", F.coalesce("query_type", F.lit("all")))


def rrf(both: DataFrame, k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion; ranks count from 0."""
    part = lambda c: F.coalesce(1 / (k + F.col(c) - 1), F.lit(0.0))
    return both.withColumn("score", F.round(part("dense_rank") + part("sparse_rank"), 8))


def minmax(c: str, key: str = "query_id") -> Column:
    w = Window.partitionBy(key)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high - low < 1e-9, 0.0).otherwise((F.col(c) - low) / (high - low))


def weighted(both: DataFrame, dense: float = 0.6, sparse: float = 0.4) -> DataFrame:
    return both.withColumns({"dn": minmax("dense"), "sn": minmax("sparse")}).withColumn("score", F.round(dense * F.coalesce("dn", F.lit(0.0)) + sparse * F.coalesce("sn", F.lit(0.0)), 6))


def zscore(c: str, key: str = "query_id") -> Column:
    w = Window.partitionBy(key)
    return (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-9)


def overlap_scores(pairs: DataFrame, p: DataFrame) -> DataFrame:
    """The default scorer of pairs: Jaccard similarity of the two documents' words, 0 if one has none. A model can take its place
    (`score_with`). Of p only the pairs' documents are read; each (doc_id, term) must be there once."""
    p = p.join(pairs.select("doc_id").unionByName(pairs.select(F.col("query_id").alias("doc_id"))).distinct().hint("merge"), "doc_id", "left_semi")
    size = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).hint("merge")
    a = p.select(F.col("doc_id").alias("query_id"), "term").hint("merge")
    common = pairs.select("query_id", "doc_id").join(a, "query_id").join(p.select("doc_id", "term").hint("merge"), ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    full = pairs.join(common.hint("merge"), ["query_id", "doc_id"], "left").join(size, "doc_id", "left").join(size.select(F.col("doc_id").alias("query_id"), F.col("m").alias("mq")), "query_id", "left")
    return full.withColumn("ce", F.round(F.coalesce(F.col("c") / (F.col("m") + F.col("mq") - F.col("c")), F.lit(0.0)), 6)).drop("c", "m", "mq")


def splade(rows: DataFrame, logits: str = "logits", mask: str = "mask", keep: int = NONZERO) -> DataFrame:
    """(query_id, term, qw): sparse weights from a language model's token logits (array over tokens of arrays over the
    vocabulary): the largest log(1 + max(logit, 0)) over unmasked tokens, of which the `keep` largest positive ones stay."""
    x = rows.select("query_id", F.explode(F.arrays_zip(F.col(logits).alias("l"), F.col(mask).alias("m"))).alias("t")).where("t.m > 0")
    w = x.select("query_id", F.posexplode("t.l").alias("term", "z")).groupBy("query_id", "term").agg(F.max(F.log1p(F.greatest(F.col("z").cast("double"), F.lit(0.0)))).alias("w")).where("w > 0")
    return top(w, keep, "query_id", "w", "term").select("query_id", F.col("term").cast("string").alias("term"), F.col("w").alias("qw"))


def score_with(pairs: DataFrame, scorer, schema: str) -> DataFrame:
    """Hook for a model: scorer maps an iterator of pandas frames of pairs to frames with scores."""
    return pairs.mapInPandas(scorer, schema)


def rerank(pairs: DataFrame, kind: str = "text") -> DataFrame:
    """Weighted sum of z-scores over each query's candidates; a missing sparse score counts 0."""
    ce, dense, sparse = WEIGHTS[kind]
    filled = pairs.withColumns({"dense": F.coalesce("dense", F.lit(0.0)), "sparse": F.coalesce("sparse", F.lit(0.0))})
    return filled.withColumn("final", F.round(ce * zscore("ce") + dense * zscore("dense") + sparse * zscore("sparse"), 4))


def rerank_by_type(pairs: DataFrame) -> DataFrame:
    """Stage 3: each query's candidates reranked with the weights of its query_type; adds final and final_rank."""
    w = lambda i: F.coalesce(*(F.when(F.col("query_type") == t, F.lit(x[i])) for t, x in WEIGHTS.items()))
    filled = pairs.withColumns({"_d": F.coalesce("dense", F.lit(0.0)), "_s": F.coalesce("sparse", F.lit(0.0)), "_c": F.coalesce("ce", F.lit(0.0))})
    out = filled.withColumn("final", F.round(w(0) * zscore("_c") + w(1) * zscore("_d") + w(2) * zscore("_s"), 4)).drop("_c", "_d", "_s")
    return out.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "doc_id")))


def strategies(reranked: DataFrame) -> DataFrame:
    """(run, query_id, query_type, doc_id, rank): the five orderings of reranked candidates. Image queries have no sparse and no
    cross-encoder run. Ties go by the prefusion rank, as a stable sort of the candidates would have them."""
    text = sparse_applies(F.col("query_type"))
    order = dict(zip(RUNS, (("dense", F.lit(True)), ("sparse", text), ("score", F.lit(True)), ("ce", text), ("final", F.lit(True))), strict=True))
    rows = reranked.select("query_id", "query_type", "doc_id", F.col("rank").alias("before"), F.explode(F.array(*(F.struct(F.lit(r).alias("run"), F.col(c).cast("double").alias("s"), ok.alias("ok")) for r, (c, ok) in order.items()))).alias("x")).where("x.ok")
    w = Window.partitionBy("query_id", "x.run").orderBy(F.desc_nulls_last("x.s"), "before")
    return rows.select(F.col("x.run").alias("run"), "query_id", "query_type", "doc_id", F.row_number().over(w).alias("rank"))


def annotated_pool(runs: list[DataFrame], queries: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, query_text, title, relevance): the pool to be judged, with an empty relevance; unknown texts are empty."""
    x = pool(runs, k).join(queries.select("query_id", F.col("text").alias("query_text")), "query_id", "left").join(catalog.select("doc_id", "title"), "doc_id", "left")
    return x.select("query_id", "doc_id", F.coalesce("query_text", F.lit("")).alias("query_text"), F.coalesce("title", F.lit("")).alias("title"), F.lit("").alias("relevance"))


def finalize(judged: DataFrame) -> DataFrame:
    """(query_id, doc_id, rel) of the judged pool; rows without a whole number for relevance go."""
    x = judged.withColumn("rel", F.expr("try_cast(trim(cast(relevance as string)) as int)"))
    return x.where("rel is not null").select("query_id", "doc_id", "rel")


def pool(runs: list[DataFrame], k: int = 10) -> DataFrame:
    """The union of the runs' top k."""
    out = runs[0].where(F.col("rank") <= k).select("query_id", "doc_id")
    for r in runs[1:]:
        out = out.unionByName(r.where(F.col("rank") <= k).select("query_id", "doc_id"))
    return out.distinct()
