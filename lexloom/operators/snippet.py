"""Query-focused snippets: windows around the first hit of each query word, merged where they meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import PUNCTUATION, STOPWORDS, stem, tokens, without
from lexloom.session import few, stored

WINDOW = 5


def raw_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, tok, word): word is the token in lower case without punctuation at its ends."""
    rows = docs.select("doc_id", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).alias("pos", "tok"))
    return rows.withColumn("word", F.regexp_replace(F.lower("tok"), f"^{PUNCTUATION}+|{PUNCTUATION}+$", ""))


def snippets(pairs: DataFrame, docs: DataFrame, queries: DataFrame, n: int = WINDOW, stems: bool = False) -> DataFrame:
    """(query_id, doc_id, snippet) of (query_id, doc_id) pairs; words hit stand between ***; no hit gives " ... ".

    With `stems`, words are hit that have the stem of a query word."""
    words = queries.select("query_id", F.explode(F.array_distinct(without(tokens(F.col("text")), STOPWORDS))).alias("word"))
    pairs = few(pairs)
    toks = stored(raw_tokens(docs.join(few(pairs.select("doc_id").distinct()), "doc_id", "left_semi")))
    if stems:
        words = words.select("query_id", stem("word").alias("word")).distinct()
        toks = toks.join(toks.select("word").distinct().withColumn("stem", stem("word")), "word").select("doc_id", "pos", "tok", F.col("stem").alias("word"))
    hits = pairs.join(words, "query_id").join(toks, ["doc_id", "word"]).groupBy("query_id", "doc_id", "word").agg(F.min("pos").alias("at"))
    span = hits.select("query_id", "doc_id", F.greatest(F.col("at") - n, F.lit(0)).alias("lo"), (F.col("at") + n).alias("hi")).distinct()
    w = Window.partitionBy("query_id", "doc_id").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = span.withColumn("new", F.when(F.col("lo") <= reach + 1, 0).otherwise(1)).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("query_id", "doc_id", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    shown = merged.join(toks, "doc_id").where("pos between lo and hi").join(hits.select("query_id", "doc_id", "word", F.lit(True).alias("hit")), ["query_id", "doc_id", "word"], "left")
    text = F.when(F.col("hit"), F.concat(F.lit("***"), "tok", F.lit("***"))).otherwise(F.col("tok"))
    parts = shown.groupBy("query_id", "doc_id", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), " ").alias("part"))
    out = parts.groupBy("query_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "part"))), lambda x: x["part"]), " ... ").alias("snippet"))
    return pairs.join(out, ["query_id", "doc_id"], "left").withColumn("snippet", F.coalesce("snippet", F.lit(" ... ")))


def missing_words(pairs: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, missing): the query's words that the document lacks, sorted and joined."""
    pairs = few(pairs)
    d = docs.join(few(pairs.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("dw"))
    q = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("qw"))
    return pairs.join(q, "query_id").join(d, "doc_id").select("query_id", "doc_id", F.array_join(F.array_sort(F.array_except("qw", "dw")), " ").alias("missing"))
