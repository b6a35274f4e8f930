"""Ranking evaluation: set and rank metrics by query and averaged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with relevance (0 if not judged), for queries that have judgments."""
    return run.join(qrels.select("query_id").distinct(), "query_id", "left_semi").join(qrels, ["query_id", "doc_id"], "left").withColumn("known", F.col("rel").isNotNull()).withColumn("rel", F.coalesce("rel", F.lit(0)))


def grades(qrels: DataFrame) -> DataFrame:
    """(query_id, rel, n): how many documents have each grade, which is all that totals and ideal orders need."""
    return qrels.groupBy("query_id", "rel").agg(F.count(F.lit(1)).alias("n"))


def metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    return metrics_of(judged(run, qrels), grades(qrels), k)


def metrics_of(j: DataFrame, graded: DataFrame, k: int = 10) -> DataFrame:
    """Of a judged run (query_id, doc_id, rank, rel, known) and the grades (query_id, rel, n) of all judgments:
    query_id, p5, p10, r10, r20, ap, rr, dcg and ndcg (binary), ndcg5 and ndcg10 (graded, ideal over all judgments), coverage."""
    rel = F.col("rel") > 0
    w = Window.partitionBy("query_id").orderBy("rank")
    own = Window.partitionBy("query_id").orderBy(F.desc("hit"), "rank")
    j = j.withColumn("hit", F.when(rel, 1).otherwise(0))
    j = j.withColumns({"sofar": F.sum("hit").over(w.rowsBetween(Window.unboundedPreceding, 0)), "ideal": F.row_number().over(own)})
    discount = lambda c: F.when(F.col(c) == 1, 1.0).otherwise(F.log2(c))
    gain = lambda r, at, n=k: F.when(F.col(at) <= n, (F.pow(F.lit(2.0), F.col(r)) - 1) / F.log2(F.col(at) + 1)).otherwise(0.0)
    at = lambda n: F.sum(F.when(F.col("rank") <= n, F.col("hit")).otherwise(0))
    known = lambda n: F.sum(F.when((F.col("rank") <= n) & F.col("known"), 1).otherwise(0))
    per = j.groupBy("query_id").agg(
        (at(5) / 5).alias("p5"), (at(k) / k).alias("p10"), at(k).alias("h"), at(2 * k).alias("h2"), F.sum(gain("rel", "rank", k // 2)).alias("g5"), F.sum(F.col("hit") * F.col("sofar") / F.col("rank")).alias("a"),
        F.coalesce(1 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias("rr"), F.sum(F.col("hit") / discount("rank")).alias("dcg"),
        F.sum(F.col("hit") / discount("ideal")).alias("idcg"), F.sum(gain("rel", "rank")).alias("g"), ((known(5) + known(10)) / 15).alias("coverage"),
    )
    # the ideal order has the grades from the largest down: n places each, of which the first k count
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = lambda n: F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(n)), lambda i: (i > F.col("before")) & (i <= F.col("before") + F.col("n"))), F.lit(0.0), lambda s, i: s + (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(i + 1))
    best = graded.withColumn("before", before).groupBy("query_id").agg(F.sum(upto(k)).alias("ig"), F.sum(upto(k // 2)).alias("ig5"))
    total = graded.groupBy("query_id").agg(F.sum(F.when(rel, F.col("n")).otherwise(0)).alias("total"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    full = per.join(total, "query_id").join(best, "query_id")
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return full.select("query_id", r6(F.col("p5"), "p5"), r6(F.col("p10"), "p10"), r6(ratio("h", "total"), "r10"), r6(ratio("h2", "total"), "r20"), r6(ratio("a", "total"), "ap"), r6(F.col("rr"), "rr"), r6(F.col("dcg"), "dcg"), r6(ratio("dcg", "idcg"), "ndcg"), r6(ratio("g5", "ig5"), "ndcg5"), r6(ratio("g", "ig"), "ndcg10"), r6(F.col("coverage"), "coverage"))


def macro_prf(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Set precision, recall and F1, averaged over judged queries; an empty side counts 0."""
    return macro_prf_of(judged(run, qrels), grades(qrels))


def macro_prf_of(j: DataFrame, graded: DataFrame) -> DataFrame:
    n = j.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).alias("c"))
    total = graded.groupBy("query_id").agg(F.sum(F.when(F.col("rel") > 0, F.col("n")).otherwise(0)).alias("t"))
    x = total.join(n, "query_id", "left").select(F.coalesce(F.col("c") / F.col("n"), F.lit(0.0)).alias("p"), F.when(F.col("t") > 0, F.coalesce("c", F.lit(0)) / F.col("t")).otherwise(0.0).alias("r"))
    f = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return x.agg(F.round(F.avg("p"), 6).alias("precision"), F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg(f), 6).alias("f1"))


def by_type(per_query: DataFrame, types: DataFrame) -> DataFrame:
    """Macro averages by query type and over all."""
    x = per_query.join(types, "query_id")
    cols = ["p10", "ap", "ndcg10"]
    return x.rollup("query_type").agg(F.count(F.lit(1)).alias("num_queries"), *(F.round(F.avg(c), 4).alias(c) for c in cols)).withColumn("query_type", F.coalesce("query_type", F.lit("all")))


METRICS = ("p5", "p10", "r10", "r20", "ap", "ndcg5", "ndcg10", "coverage")


def metrics_table(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """(run, query_type, num_queries, the eight metrics): macro averages of (run, query_id, query_type, doc_id, rank) over
    judged queries, by run and query type and over all types."""
    return metrics_table_of(judged(runs, qrels), grades(qrels))


def metrics_table_of(j: DataFrame, graded: DataFrame) -> DataFrame:
    """metrics_table of judged runs and the grades of all judgments."""
    kinds = j.select("run", "query_id", "query_type").distinct()
    one = F.concat_ws("\x1f", "run", F.col("query_id").cast("string"))
    keyed = j.select(one.alias("query_id"), "doc_id", "rank", "rel", "known")
    graded_for = kinds.join(graded, "query_id").select(one.alias("query_id"), "rel", "n")
    per = metrics_of(keyed, graded_for).join(kinds.select(one.alias("query_id"), "run", "query_type"), "query_id")
    out = per.groupBy("run", "query_type").agg(F.count(F.lit(1)).alias("num_queries"), *(F.sum(c).alias(c) for c in METRICS))
    every = out.unionByName(out.groupBy("run").agg(F.sum("num_queries").alias("num_queries"), *(F.sum(c).alias(c) for c in METRICS)).withColumn("query_type", F.lit("all")))
    return every.select("run", "query_type", "num_queries", *(F.round(F.col(c) / F.col("num_queries"), 4).alias(c) for c in METRICS))


def judged_share(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """By run: how many of the first k results of all queries are judged, and their percentage."""
    return judged_share_of(runs.join(qrels.select("query_id", "doc_id").distinct().withColumn("known", F.lit(True)), ["query_id", "doc_id"], "left"), k)


def judged_share_of(runs: DataFrame, k: int = 10) -> DataFrame:
    """judged_share of runs that have `known`: whether the result is judged (false or null if not)."""
    x = runs.where(F.col("rank") <= k).groupBy("run").agg(F.count(F.when(F.col("known"), 1)).alias("judged"), F.count(F.lit(1)).alias("results"))
    return x.withColumn("percent", F.round(100 * F.col("judged") / F.col("results"), 4))


def from_lists(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run, qrels) of (query_id, actual array, predicted array); a null list counts as a missing one and is refused."""
    if rows.where("actual is null or predicted is null").limit(1).count():
        raise ValueError("every query needs a list of relevant and a list of predicted documents")
    run = rows.select("query_id", F.posexplode("predicted").alias("i", "doc_id")).select("query_id", "doc_id", (F.col("i") + 1).alias("rank"))
    qrels = rows.select("query_id", F.explode(F.array_distinct("actual")).alias("doc_id")).withColumn("rel", F.lit(1))
    return run, qrels


def calculate(rows: DataFrame) -> DataFrame:
    """One row of all binary metrics over (query_id, actual, predicted): set precision, recall and F1, MAP, mean DCG and NDCG, MRR.

    A query without relevant or without predicted documents counts 0 in every mean."""
    run, qrels = from_lists(rows)
    n = rows.agg(F.count(F.lit(1)).alias("queries"))
    per = metrics(run, qrels)
    sums = per.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("ap", "rr", "dcg", "ndcg")))
    hit = rows.select(F.size(F.array_intersect("actual", "predicted")).alias("c"), F.size("predicted").alias("m"), F.size(F.array_distinct("actual")).alias("t"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    prf = hit.select(ratio("c", "m").alias("p"), ratio("c", "t").alias("r")).withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    sets = prf.agg(F.sum("p").alias("p"), F.sum("r").alias("r"), F.sum("f").alias("f"))
    mean = lambda c, name: F.round(F.col(c) / F.col("queries"), 6).alias(name)
    return n.crossJoin(sets).crossJoin(sums).select("queries", mean("p", "precision"), mean("r", "recall"), mean("f", "f1"), mean("ap", "map"), mean("dcg", "dcg"), mean("ndcg", "ndcg"), mean("rr", "mrr"))


def best_example(first: DataFrame, second: DataFrame, types: DataFrame | None = None, query_type: str | None = None) -> DataFrame:
    """The query (of the given type, if any) where the first run's graded NDCG beats the second's most."""
    if query_type is not None:
        first = first.join(types.where(F.col("query_type") == query_type).select("query_id"), "query_id", "left_semi")
    x = first.select("query_id", F.col("ndcg10").alias("x")).join(second.select("query_id", F.col("ndcg10").alias("y")), "query_id").withColumn("gain", F.round(F.col("x") - F.col("y"), 6)).where("gain > 0")
    return x.orderBy(F.desc("gain"), "query_id").limit(1).select("query_id", "gain")
