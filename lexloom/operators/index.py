"""Inverted index tables: postings, lengths, statistics and tiers, with additions and removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import stem, tokens
from lexloom.session import few

# Tier thresholds on term frequency by field.
TIERS = {"characters": (3, 2), "genres": (1, 0), "description": (10, 5)}


def words_of(docs: DataFrame, c: Column) -> Column:
    """The words of a text column, or of all items of an array column."""
    kind = docs.select(c.alias("x")).schema[0].dataType.typeName()
    return F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), tokens)) if kind == "array" else tokens(c)


def postings(docs: DataFrame, fields: dict[str, Column] | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(field, term, doc_id, tf) of the given text or array columns; with `terms`, of those terms only, which is all
    that a set of queries needs: other words are dropped before anything is counted or shuffled."""
    fields = fields or {"description": F.col("text")}
    rows = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), words_of(docs, c).alias("w")) for f, c in fields.items()))).alias("x"))
    flat = rows.select("doc_id", "x.field", F.explode("x.w").alias("term"))
    if terms is not None:
        flat = flat.join(few(terms.select("term").distinct()), "term", "left_semi")
    return flat.groupBy("field", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def stemmed(index: DataFrame) -> DataFrame:
    """The postings with stems for terms. Only distinct terms pass through the stemmer, the rest is a join and a sum."""
    stems = index.select("term").distinct().withColumn("stem", stem("term"))
    own = [c for c in index.columns if c not in ("term", "tf")]
    return index.join(stems, "term").groupBy(*own, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf")).select(*index.columns)


def containing(docs: DataFrame, term: str, fields: dict[str, Column]) -> DataFrame:
    """(doc_id): documents that have the word in any of the fields, by a scan."""
    every = F.concat(*(words_of(docs, c) for c in fields.values()))
    return docs.where(F.array_contains(every, F.lit(term))).select("doc_id")


def posting_list(index: DataFrame, term: str, field: str = "description") -> DataFrame:
    return index.where((F.col("term") == term) & (F.col("field") == field)).select("doc_id", "tf")


def lengths(docs: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, doc_id, dl); empty fields count 0."""
    return docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.size(words_of(docs, c)).cast("long").alias("dl")) for f, c in fields.items()))).alias("x")).select("x.field", "doc_id", "x.dl")


def field_stats(dl: DataFrame) -> DataFrame:
    return dl.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("dl"), 6).alias("avg_dl"))


def term_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def tiered(index: DataFrame) -> DataFrame:
    tier = F.lit(3)
    for f, (one, two) in TIERS.items():
        tier = F.when(F.col("field") == f, F.when(F.col("tf") >= one, 1).when(F.col("tf") >= two, 2).otherwise(3)).otherwise(tier)
    return index.withColumn("tier", tier)


def add(index: DataFrame, more: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Upsert: the postings in `more` replace older ones of their documents, and of all `ids` (which may have no words now)."""
    return remove(index, more.select("doc_id") if ids is None else ids).unionByName(more)


def index_checks(docs: DataFrame, index: DataFrame, term: str) -> DataFrame:
    """Removing what was added gives the index back, and a scan for a term finds no document that its postings lack."""
    extra = postings(docs.select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    back = remove(add(index, extra), extra.select("doc_id"))
    changed = back.exceptAll(index).unionByName(index.exceptAll(back)).agg((F.count(F.lit(1)) == 0).alias("round_trip"))
    found = containing(docs, term, {"description": F.col("text")}).join(posting_list(index, term).select("doc_id"), "doc_id", "left_anti")
    return changed.crossJoin(found.agg((F.count(F.lit(1)) == 0).alias("scan_in_postings")))


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*index.columns)


def top(scores: DataFrame, k: int, key: str = "query_id", score: str = "score", item: str = "doc_id") -> DataFrame:
    """The k best of each query with their rank; ties by ascending id. Spark cuts at k before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(item))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
