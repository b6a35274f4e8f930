"""One search call over a fielded index: method and field dispatch, full or tiered, with or without stems."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import stem
from lexloom.operators import index as ix
from lexloom.operators import lemma, rank
from lexloom.session import stored

# The field weights of a plain list, in this order, and other names of methods.
FIELDS, DEFAULT_WEIGHTS = ("characters", "genres", "description"), (0.3, 0.3, 0.4)
ALIASES = {"okapibm25": "bm25"}


@dataclass
class Collection:
    """Documents, their searched fields, and whether terms are stems or lemmas. An index of stored postings and lengths is used if given."""

    docs: DataFrame
    fields: dict[str, Column]
    stems: bool = False
    postings: DataFrame | None = None
    lengths: DataFrame | None = None
    lemmas: bool = False
    kept: DataFrame | None = None

    def words(self) -> DataFrame:
        """(word): the distinct words of all fields."""
        every = F.concat(*(ix.words_of(self.docs, c) for c in self.fields.values()))
        return self.docs.select(F.explode(every).alias("word")).distinct()

    def vocabulary(self) -> DataFrame:
        """`words`, stored once."""
        if self.kept is None:
            self.kept = stored(self.words())
        return self.kept

    def forms(self, words: DataFrame, known: DataFrame) -> DataFrame:
        """(word, form): the stem or lemma of each of the distinct words; lemmas must be known words."""
        return words.select("word", stem("word").alias("form")) if self.stems else lemma.lemmas(words, known).withColumnRenamed("lemma", "form")

    def find(self, terms: DataFrame) -> DataFrame:
        """Postings of the terms (stems or lemmas, if the collection has them). Only distinct words are brought to their form, and only
        words of a wanted form are counted."""
        if self.postings is not None:
            return self.postings.join(terms.select("term").distinct(), "term", "left_semi")
        if not (self.stems or self.lemmas):
            return ix.postings(self.docs, self.fields, terms)
        words = self.vocabulary()
        wanted = stored(self.forms(words, words).join(terms.select(F.col("term").alias("form")).distinct(), "form", "left_semi"))
        p = ix.postings(self.docs, self.fields, wanted.select(F.col("word").alias("term")))
        rows = p.join(wanted.withColumnRenamed("word", "term"), "term").groupBy("field", "form", "doc_id").agg(F.sum("tf").alias("tf"))
        return rows.select("field", F.col("form").alias("term"), "doc_id", "tf")

    def terms_of(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, qtf) of (query_id, text), in the collection's forms."""
        if not self.lemmas or self.stems:
            return query_terms(queries, self.stems)
        q = query_terms(queries)
        forms = lemma.lemmas(q.select(F.col("term").alias("word")), self.vocabulary())
        return stored(q.join(forms.withColumnRenamed("word", "term"), "term").groupBy("query_id", "lemma").agg(F.sum("qtf").alias("qtf")).select("query_id", F.col("lemma").alias("term"), "qtf"))

    def sizes(self) -> DataFrame:
        return ix.lengths(self.docs, self.fields) if self.lengths is None else self.lengths

    def fetch(self, ids: DataFrame) -> DataFrame:
        """The documents with these ids."""
        return self.docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def query_terms(queries: DataFrame, stems: bool = False) -> DataFrame:
    """(query_id, term, qtf) of (query_id, text)."""
    q = rank.query_terms(queries, "query_id", "text")
    return q.withColumn("term", stem("term")).groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf")) if stems else q


def search(where: Collection, queries: DataFrame, method: str = "ltn.lnn", weights: dict[str, float] | None = None, safe: bool = True, max_results: int = 10, smoothing: str = "mixture", alpha: float = 0.5, lam: float = 0.5) -> DataFrame:
    """(query_id, doc_id, score, rank) of (query_id, text).

    Methods: "bm25", "unigram" (language model with the given smoothing; always over the full index), or a SMART scheme
    "ddd.qqq". With safe=False the tiers are searched in turn until there are max_results documents, with each tier's own
    document frequencies; a tier is read for the queries that lack documents only, and not at all if none does. Queries without words, or whose words occur nowhere, have no rows.
    """
    method = ALIASES.get(method, method)
    weights = dict(zip(FIELDS, DEFAULT_WEIGHTS, strict=True)) if weights is None else weights
    used = [f for f in where.fields if weights.get(f)]
    if not used:
        raise ValueError("no field has a weight")
    q = where.terms_of(queries)
    p, sizes = stored(where.find(q).where(F.col("field").isin(used))), where.sizes().where(F.col("field").isin(used))
    q = stored(q)

    if method == "unigram":
        scores = stored(rank.language_model(p, q, sizes, smoothing, alpha, lam))
        return ix.top(rank.log_mixture({f: scores.where(F.col("field") == f) for f in used}, weights), max_results)
    n = stored(sizes.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl")))

    def score(rows: DataFrame, q: DataFrame = q) -> DataFrame:
        return rank.over_fields(rank.bm25(rows, q, sizes, n) if method == "bm25" else rank.vsm(rows, q, n, method), weights)

    if safe:
        return ix.top(score(p), max_results)
    tiers = stored(ix.tiered(p), "tier")

    def score_tier(tier: int, active: DataFrame) -> DataFrame:
        rows = tiers.where(F.col("tier") == tier).drop("tier")
        return score(rows, active).select("query_id", "doc_id", F.col("score").alias("s"))

    return rank.by_tier(score_tier, q, max_results)


def search_text(where: Collection, text: str, n: int = 10, method: str = "ltn.lnn", weights: tuple[float, ...] = DEFAULT_WEIGHTS, **options) -> DataFrame:
    """One query, field weights as a list in the order of FIELDS, the full index: the documents found, best first."""
    queries = where.docs.sparkSession.createDataFrame([(0, text)], "query_id long, text string")
    hits = search(where, queries, method, dict(zip(FIELDS, weights, strict=True)), True, n, **options)
    return hits.drop("query_id").join(where.docs, "doc_id").orderBy("rank")
