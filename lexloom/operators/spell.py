"""Spelling: vocabulary words by character gram similarity, through an index of grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import kgrams, tokens
from lexloom.session import stored

LIMIT, BEST = 0.4, 5


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n)"""
    return docs.select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _rare_first(rows: DataFrame, key: list[str], often: DataFrame, name: str, limit: float) -> DataFrame:
    """The rows with their grams from the rarest on (array `name`), one for each gram and place of the prefix that the limit asks for."""
    flat = rows.select(*key, F.explode(kgrams(F.col(key[0]))).alias("gram")).join(often, "gram", "left")
    own = flat.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))), lambda x: x["gram"]).alias(name))
    return own.select(*key, name, F.posexplode(F.expr(f"slice({name}, 1, cast(size({name}) - floor({limit} * size({name})) as int))")).alias(f"{name}_at", "gram"))


def nearest_words(words: DataFrame, vocab: DataFrame, limit: float = LIMIT, best: int = BEST) -> DataFrame:
    """(word, candidate, similarity, n, rank). Words meet by a prefix of their grams, the rarest in the vocabulary first, long enough for
    every pair over the limit to share one. Sizes must be alike, and the places where they meet must leave enough grams to
    share; a pair is compared at its rarest common gram only."""
    words = stored(words.select("word"))
    often = vocab.select(F.explode(kgrams(F.col("word"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    ours = _rare_first(words, ["word"], often, "g", limit)
    theirs = _rare_first(vocab.select(F.col("word").alias("candidate"), "n"), ["candidate", "n"], often, "h", limit)
    k, m = F.size("g"), F.size("h")
    shared = F.array_intersect("g", "h")
    met = ours.join(theirs, "gram").where((F.least(k, m) > limit * F.greatest(k, m)) & (F.least(k - F.col("g_at"), m - F.col("h_at")) > limit / (1 + limit) * (k + m) - 1e-9) & (shared[0] == F.col("gram")))
    near = met.select("word", "candidate", "n", F.round(F.size(shared) / (k + m - F.size(shared)), 6).alias("similarity")).where(F.col("similarity") > limit)
    w = Window.partitionBy("word").orderBy(F.desc("similarity"), F.desc("n"), "candidate")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best)


def spell_check(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query_id, corrected): known words stay, others become their nearest word, or stay."""
    rows = queries.select("query_id", F.posexplode(tokens(F.col("text"))).alias("pos", "word"))
    unknown = rows.select("word").distinct().join(vocab, "word", "left_anti")
    best = nearest_words(unknown, vocab, best=1).select("word", "candidate")
    fixed = rows.join(best, "word", "left").withColumn("w", F.coalesce("candidate", "word"))
    return fixed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ").alias("corrected"))
