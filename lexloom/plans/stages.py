"""Queries of the search call, the product-search stages and the learning operators, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import answers, catalogue, dedup, embeddings, evalir, fusion, index, lemma, linkage, ml, quality, search, snippet, sweep
from lexloom.plans import oracle as o
from lexloom.plans.catalog import Tables
from lexloom.session import new_path
from lexloom.streaming import delta, segments

# ---------------------------------------------------------------- search


def _collection(t: Tables, stems: bool = False) -> search.Collection:
    return search.Collection(t.documents, t.fields(), stems)


def _queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" en src1")).alias("text"))


def _search(method: str, **options):
    return lambda t: search.search(_collection(t), _queries(t), method, **options)


def _lm_queries(t: Tables) -> DataFrame:
    """Words that occur in several fields; a query with a word that a field lacks has probability 0 there."""
    k = F.col("item_id") % 3
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.when(k == 0, "en").when(k == 1, "de").otherwise("en de").alias("text"))


def _stemmed(method: str):
    return lambda t: search.search(_collection(t, True), _queries(t), method)


_W = "CASE field WHEN 'description' THEN 0.4 ELSE 0.3 END"
_FB = "qtf * log10(n / df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))"
_FV = "(1 + log10(tf)) * log10(n / df) * (1 + log10(qtf))"


def _tiers(part: str) -> str:
    return f"""WITH {o._FIELDS}, pt AS (SELECT *, {o._TIER} AS tier FROM fp), tdf AS (SELECT field, tier, term, count(*) AS df FROM pt GROUP BY ALL),
s0 AS (SELECT field, tier, query_id, doc_id, round(sum({part}), 5) AS s FROM pt JOIN fq USING (term) JOIN tdf USING (field, tier, term) JOIN fdl USING (field, doc_id) JOIN fst USING (field) GROUP BY ALL),
s AS (SELECT query_id, doc_id, tier, round(sum(s::DECIMAL(20, 5) * {_W}), 4)::DOUBLE AS s FROM s0 GROUP BY ALL),
f1 AS (SELECT query_id, doc_id, min(tier) AS t FROM s GROUP BY ALL), b AS (SELECT query_id, count(*) FILTER (t < 2) AS n1, count(*) FILTER (t < 3) AS n2 FROM f1 GROUP BY 1)
{o._top("SELECT query_id, doc_id, round(sum(s), 5) AS score FROM s JOIN b USING (query_id) WHERE tier = 1 OR (tier = 2 AND n1 < 10) OR (tier = 3 AND n2 < 10) GROUP BY ALL", 10)}"""


_LM_FIELDS = o._FIELDS.replace("text || ' en src1'", "CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'en de' END")
_LM = f"""WITH {_LM_FIELDS}, cf AS (SELECT field, term, sum(tf) AS cf FROM fp GROUP BY ALL), tot AS (SELECT field, sum(dl) AS c FROM fdl GROUP BY 1),
qf AS (SELECT query_id, field, term, qtf, cf, c FROM fq CROSS JOIN tot LEFT JOIN cf USING (field, term)),
ok AS (SELECT query_id, field FROM qf GROUP BY ALL HAVING count(*) FILTER (cf IS NULL) = 0),
cand AS (SELECT DISTINCT field, query_id, doc_id FROM fp JOIN fq USING (term)),
lp AS (SELECT cand.field, cand.query_id, cand.doc_id, round(sum(qtf * ln(0.5 * coalesce(tf, 0) / dl + 0.5 * cf / c)), 4) AS s FROM cand JOIN ok USING (query_id, field) JOIN qf USING (query_id, field) JOIN fdl ON fdl.field = cand.field AND fdl.doc_id = cand.doc_id LEFT JOIN fp ON fp.field = cand.field AND fp.doc_id = cand.doc_id AND fp.term = qf.term GROUP BY ALL),
w AS (SELECT query_id, doc_id, s + ln({_W}) AS s FROM lp)
{o._top("SELECT query_id, doc_id, round(max(s) + ln(sum(exp(s - m))), 4) AS score FROM (SELECT *, max(s) OVER (PARTITION BY query_id, doc_id) AS m FROM w) GROUP BY query_id, doc_id", 10)}"""

# ---------------------------------------------------------------- product search


def listings(t: Tables) -> DataFrame:
    """Listings made of parts: a title may lack, images are shared or missing, categories follow the size."""
    k = F.col("p_partkey")
    return t.part.select(
        F.concat(k.cast("string"), F.lit("|shop")).alias("product_id"), F.when(k % 11 == 0, "").otherwise(F.col("p_name")).alias("title"),
        F.when(k % 7 == 0, "Toys").when(k % 7 < 4, "Home & Kitchen / Lighting").otherwise("Furniture").alias("category_path"),
        F.when(k % 13 == 0, None).when(k % 5 == 0, "img0").otherwise(F.concat(F.lit("img"), k.cast("string"))).alias("main_image_id"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("product_type"), F.col("p_size").cast("string").alias("dimensions"),
        F.concat(F.lit("<p>"), F.col("p_name"), F.lit("</p> <b>new</b>")).alias("description"),
    )


def images(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    every = t.part.where(k % 3 > 0).select(F.concat(F.lit("img"), k.cast("string")).alias("image_id"), F.concat(F.lit("small/"), k.cast("string"), F.lit(".jpg")).alias("path"))
    return every.unionByName(t.spark.createDataFrame([("img0", "small/0.jpg")], "image_id string, path string"))


_LIST = """li AS (SELECT p_partkey || '|shop' AS product_id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 7 = 0 THEN 'Toys' WHEN p_partkey % 7 < 4 THEN 'Home & Kitchen / Lighting' ELSE 'Furniture' END AS category_path,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'img0' ELSE 'img' || p_partkey END AS main_image_id, p_brand, p_type, p_size, p_name FROM part),
im AS (SELECT 'img' || p_partkey AS image_id, 'small/' || p_partkey || '.jpg' AS path FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT 'img0', 'small/0.jpg'),
el AS (SELECT * FROM li WHERE title <> '' AND main_image_id IS NOT NULL AND category_path <> 'Toys'),
ok AS (SELECT * FROM el WHERE main_image_id NOT IN (SELECT main_image_id FROM el GROUP BY 1 HAVING count(*) > 5))"""


def types(t: Tables) -> DataFrame:
    """Each vector query's type, by its id."""
    k = F.col("query_id") % 60
    return t.vq().select("query_id", F.when(k == 0, "image").when(k == 20, "image_text").otherwise("text").alias("query_type"))


def retrieved(t: Tables) -> DataFrame:
    return t.once("retrieved", lambda: fusion.retrieve(fusion.merged(t.dense(), t.sparse()), types(t)))


def reranked(t: Tables) -> DataFrame:
    return t.once("reranked", lambda: fusion.rerank_by_type(fusion.overlap_scores(retrieved(t), t.terms_of_candidates())))


def runs(t: Tables) -> DataFrame:
    return t.once("runs", lambda: fusion.strategies(reranked(t)))


def pool(t: Tables) -> DataFrame:
    x = runs(t)
    return fusion.annotated_pool([x.where(F.col("run") == r) for r in (fusion.RUNS[4], fusion.RUNS[0], fusion.RUNS[1], fusion.RUNS[3])], t.documents.select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 40).alias("text")), t.documents.select("doc_id", F.col("source").alias("title")))


def judged_pool(t: Tables) -> DataFrame:
    """The pool with grades as people may enter them: blank, padded or wrong."""
    k = (F.col("query_id") + F.col("doc_id")) % 5
    return pool(t).withColumn("relevance", F.when(k == 0, "").when(k == 1, " 2").when(k == 2, "1").when(k == 3, "0").otherwise("?"))


def products(t: Tables) -> DataFrame:
    return t.vectors().select("doc_id").unionByName(t.documents.select("doc_id")).distinct()


_TYPES = "ty AS (SELECT query_id, CASE query_id % 60 WHEN 0 THEN 'image' WHEN 20 THEN 'image_text' ELSE 'text' END AS query_type FROM vq)"
_RET = f"""{o._HYB}, {_TYPES},
tm AS (SELECT query_id, doc_id, query_type, dense, dr, CASE WHEN query_type <> 'image' THEN sparse END AS sparse, CASE WHEN query_type <> 'image' THEN sr END AS sr FROM m JOIN ty USING (query_id) WHERE query_type <> 'image' OR dense IS NOT NULL),
rt AS (SELECT query_id, query_type, doc_id, coalesce(dense, 0.0) AS dense, CASE WHEN query_type <> 'image' THEN coalesce(sparse, 0.0) END AS sparse, concat_ws(',', CASE WHEN dense IS NOT NULL THEN 'dense' END, CASE WHEN sparse IS NOT NULL THEN 'sparse' END) AS source, score, rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT *, round(coalesce(1 / (60 + dr - 1), 0) + coalesce(1 / (60 + sr - 1), 0), 8) AS score FROM tm)) WHERE rank <= 100)"""
_RER = f"""{_RET}, sz AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1), cm AS (SELECT rt.query_id, rt.doc_id, count(*) AS c FROM rt JOIN p x ON x.doc_id = rt.query_id JOIN p y ON y.doc_id = rt.doc_id AND y.term = x.term GROUP BY ALL),
ce AS (SELECT rt.*, round(coalesce(c / (a.n + b.n - c), 0), 6) AS ce FROM rt LEFT JOIN cm USING (query_id, doc_id) LEFT JOIN sz a ON a.doc_id = rt.doc_id LEFT JOIN sz b ON b.doc_id = rt.query_id),
fz AS (SELECT *, round(CASE query_type WHEN 'text' THEN 0.4 WHEN 'image' THEN 0.0 ELSE 0.3 END * (ce - avg(ce) OVER w) / (stddev_pop(ce) OVER w + 1e-9) + CASE query_type WHEN 'text' THEN 0.3 WHEN 'image' THEN 1.0 ELSE 0.4 END * (dense - avg(dense) OVER w) / (stddev_pop(dense) OVER w + 1e-9)
  + CASE query_type WHEN 'image' THEN 0.0 ELSE 0.3 END * (coalesce(sparse, 0) - avg(coalesce(sparse, 0)) OVER w) / (stddev_pop(coalesce(sparse, 0)) OVER w + 1e-9), 4) AS final FROM ce WINDOW w AS (PARTITION BY query_id)),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, doc_id)::INT AS final_rank FROM fz)"""
_RUN = f"""{_RER}, xr AS ({' UNION ALL '.join(f"SELECT '{r}' AS run, query_id, query_type, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {c} DESC, rank)::INT AS rank FROM rr{w}" for r, c, w in zip(fusion.RUNS, ('dense', 'sparse', 'score', 'ce', 'final'), ('', " WHERE query_type <> 'image'", '', " WHERE query_type <> 'image'", ''), strict=True))})"""
_POOL = f"{_RUN}, pl AS (SELECT DISTINCT query_id, doc_id FROM xr WHERE rank <= 10 AND run <> '{fusion.RUNS[2]}')"
_TABLE = f"""{_RUN}, {o._QR},
j AS (SELECT xr.*, coalesce(rel, 0) AS rel, (rel IS NOT NULL)::INT AS known, (coalesce(rel, 0) > 0)::INT AS hit FROM xr LEFT JOIN qr USING (query_id, doc_id) WHERE query_id IN (SELECT query_id FROM qr)),
j2 AS (SELECT *, sum(hit) OVER (PARTITION BY run, query_id ORDER BY rank) AS sofar FROM j),
tt AS (SELECT query_id, count(*) AS total FROM qr GROUP BY 1),
ig AS (SELECT query_id, sum((2.0 ** rel - 1) / log2(r + 1)) FILTER (r <= 10) AS i10, sum((2.0 ** rel - 1) / log2(r + 1)) FILTER (r <= 5) AS i5 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS r FROM qr) GROUP BY 1),
per AS (SELECT run, query_id, any_value(query_type) AS query_type, round(sum(hit) FILTER (rank <= 5) / 5, 6) AS p5, round(sum(hit) FILTER (rank <= 10) / 10, 6) AS p10, round(sum(hit) FILTER (rank <= 10) / any_value(total), 6) AS r10, round(sum(hit) FILTER (rank <= 20) / any_value(total), 6) AS r20,
  round(sum(hit * sofar / rank) / any_value(total), 6) AS ap, round(sum((2.0 ** rel - 1) / log2(rank + 1)) FILTER (rank <= 5) / any_value(i5), 6) AS ndcg5, round(sum((2.0 ** rel - 1) / log2(rank + 1)) FILTER (rank <= 10) / any_value(i10), 6) AS ndcg10, round((sum(known) FILTER (rank <= 5) + sum(known) FILTER (rank <= 10)) / 15, 6) AS coverage
  FROM j2 JOIN tt USING (query_id) JOIN ig USING (query_id) GROUP BY run, query_id)
SELECT run, coalesce(query_type, 'all') AS query_type, count(*) AS num_queries, {', '.join(f'round(avg({c}), 4) AS {c}' for c in evalir.METRICS)} FROM per GROUP BY GROUPING SETS ((run, query_type), (run))"""


def manifest(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([tuple(quality.MANIFEST_FIELDS)], ", ".join(f"{f} string" for f in quality.MANIFEST_FIELDS))


def unit_vectors(t: Tables) -> DataFrame:
    return t.vectors().select("doc_id", F.transform("v", lambda x: x.cast("double") / F.sqrt(fusion.dot("v", "v"))).alias("v"))


def answered(t: Tables) -> DataFrame:
    return answers.validate(t.raw_answers(), with_products=True)


def generated(t: Tables) -> DataFrame:
    """A model that answers well at the first, the second or the third attempt, or never."""
    raw = t.raw_answers()
    key = F.col("query_id").cast("int") % 5

    def model(asked: DataFrame) -> DataFrame:
        return asked.join(raw.select("query_id", "raw"), "query_id").select("query_id", F.when((key == 2) & (F.col("query_id").cast("int") % 3 > F.col("attempt")), "no").when(key == 2, F.regexp_replace(F.lit(_GOOD), "ID", F.col("query_id"))).otherwise(F.col("raw")).alias("raw"))

    out = answers.generate(raw.select("query_id", F.lit("p").alias("prompt"), "products"), model)
    return out.groupBy("status", "attempts").agg(F.count(F.lit(1)).alias("n"))


_GOOD = '{"query_id":"q","interpreted_need":{"category":"c","use_case":"u","positive_preferences":[],"negative_constraints":[],"visual_preferences":[],"uncertain_fields":[]},"product_judgements":[{"product_id":"ID","role":"exact","evidence":[],"constraint_violations":[],"reason":"r"}],"decision":"recommend_exact","customer_response":"Take this one."}'


def training(t: Tables) -> DataFrame:
    hits = index.top(t.bm25(), 8)
    mine = t.queries().where("query_id % 2 = 0").select("query_id", F.lit('{"decision":"ask_clarification"}').alias("answer"))
    return answers.training_rows(mine, t.queries().withColumn("query_type", F.lit("text")), hits, t.documents.select("doc_id", F.concat_ws(" | ", "lang", "source").alias("features")))


def calculated(t: Tables) -> DataFrame:
    x = t.qrels().groupBy("query_id").agg(F.collect_list("doc_id").alias("actual")).join(t.dense(10).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda r: r["doc_id"]).alias("predicted")), "query_id")
    return evalir.calculate(x)


_CALC = f"""{o._EVAL.replace(o._top(o._DENSE_S, 100), o._top(o._DENSE_S, 10))}, x AS (SELECT t.query_id, c / n AS p, c / t AS r FROM (SELECT query_id, count(*) AS t FROM qr GROUP BY 1) t JOIN (SELECT dn.query_id, count(*) AS n, count(rel) AS c FROM dn LEFT JOIN qr USING (query_id, doc_id) GROUP BY 1) d USING (query_id)),
s AS (SELECT count(*) AS queries, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM x)
SELECT s.*, round((SELECT sum(ap) FROM mt) / queries, 6) AS map, round((SELECT sum(dcg) FROM mt) / queries, 6) AS dcg, round((SELECT sum(ndcg) FROM mt) / queries, 6) AS ndcg, round((SELECT sum(rr) FROM mt) / queries, 6) AS mrr FROM s"""

# ---------------------------------------------------------------- learning


def tfidf_sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    docs = t.documents.select("doc_id", T.tokens(F.col("text")).alias("w"), F.array_position(F.array(*(F.lit(x) for x in ("en", "de", "fr", "es"))), F.col("lang")).cast("int").alias("label"))
    return ml.split(ml.tfidf(docs), "doc_id", 0.8)


def _halves(train: DataFrame, held: DataFrame) -> DataFrame:
    return train.select("doc_id", F.lit("train").alias("part")).unionByName(held.select("doc_id", F.lit("held").alias("part")))


def _split_sql(by: str) -> str:
    return f"""WITH {o._VEC}, h AS (SELECT doc_id, label, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT AS h FROM v)
SELECT doc_id, CASE WHEN row_number() OVER ({by} ORDER BY h, doc_id) <= floor(0.8::DOUBLE * count(*) OVER ({by})) THEN 'train' ELSE 'held' END AS part FROM h"""


def _tfidf(kind: str):
    return lambda t: ml.classification_report(ml.classify(*tfidf_sets(t), kind).select("label", "predicted"))


def questions(t: Tables) -> DataFrame:
    """Groups of four words named by vectors; every tenth has an unknown one."""
    g = F.col("doc_id") - F.col("doc_id") % 4
    return t.vectors().where("doc_id < 4 * (doc_id div 4) + 4").groupBy(g.alias("g")).agg(F.array_sort(F.collect_list(F.when(F.col("doc_id") % 40 == 3, "unknown").otherwise(F.concat(F.lit("w"), F.col("doc_id").cast("string"))))).alias("words"))


def odd(t: Tables) -> DataFrame:
    return ml.odd_answers(questions(t), t.vectors().select(F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("word"), "v"))


_ODD = f"""WITH {o._VEC}, g AS (SELECT doc_id - doc_id % 4 AS g, doc_id, v, 'w' || doc_id AS word FROM v), bad AS (SELECT g FROM g WHERE doc_id % 40 = 3),
m AS (SELECT x.g, x.word, round(avg({o._DOT.format('x.v', 'y.v')} / (sqrt({o._DOT.format('x.v', 'x.v')}) * sqrt({o._DOT.format('y.v', 'y.v')}))), 5) AS m FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
od AS (SELECT g, word AS odd FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY m, word) AS r FROM m) WHERE r = 1),
an AS (SELECT DISTINCT g.g, CASE WHEN bad.g IS NULL THEN odd END AS odd, CASE WHEN bad.g IS NOT NULL THEN 'unknown' END AS error FROM g LEFT JOIN bad ON bad.g = g.g LEFT JOIN od ON od.g = g.g)"""


def profile(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return ml.cluster_terms(t.clusters().select("doc_id", "cluster"), words, t.vectors().select("doc_id", "label"))


def segmented(t: Tables) -> DataFrame:
    """The statistics of an index after two batches of new documents, one of updates and one of deletions, which comes twice."""
    at, d = new_path(t.spark, f"lexloom-{uuid.uuid4().hex}"), t.documents.select("doc_id", "text", "lang", "source")
    batches = [d.where("doc_id % 3 = 0"), d.where("doc_id % 3 > 0"), d.where("doc_id % 10 = 0").withColumn("text", F.concat_ws(" ", "lang", "source")), t.labels.where("quality = 0").select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted"))]
    for i, rows in enumerate(batches):
        segments.ingest(rows, at, i)
    segments.ingest(batches[-1], at, len(batches) - 1)
    return index.term_stats(segments.index(t.spark, at, len(batches)).withColumn("field", F.lit("description")))


def trained(t: Tables, buckets: int) -> DataFrame:
    """Vectors of the benchmark's words by a model of the documents; unknown words have some with grams only."""
    return embeddings.vectors(t.benchmark.select(F.explode(T.tokens(F.col("text"))).alias("word")), embeddings.fit(t.documents, buckets=buckets))


QUERIES = {
    "skipgram_vectors": lambda t: trained(t, 0),
    "gram_vectors": lambda t: trained(t, 1 << 14),
    "segment_index": segmented,
    "search_bm25": _search("bm25"),
    "search_vsm": _search("ltn.lnn"),
    "fielded_lm": lambda t: search.search(_collection(t), _lm_queries(t), "unigram"),
    "tiered_bm25": _search("bm25", safe=False),
    "tiered_vsm": _search("ltn.lnn", safe=False),
    "search_bm25_stemmed": _stemmed("bm25"),
    "search_vsm_stemmed": _stemmed("ltn.lnn"),
    "search_bm25_lemmas": lambda t: search.search(search.Collection(t.documents, t.fields(), lemmas=True), _queries(t), "bm25"),
    "lemma_table": lambda t: lemma.lemmas(t.documents.select(F.explode(T.tokens(F.col("text"))).alias("word"))),
    "snippets_stemmed": lambda t: snippet.snippets(t.top3(), t.documents, t.queries(), stems=True),
    "index_array_fields": lambda t: index.postings(t.documents, {"genres": F.split("source", "r"), "description": F.array("lang", "source")}),
    "containing_scan": lambda t: index.containing(t.documents, "the", t.fields()),
    "fetch_by_id": lambda t: _collection(t).fetch(t.labels.where("quality = 1")).select("doc_id", "source"),
    "index_checks": lambda t: index.index_checks(t.documents, index.postings(t.documents), "the"),
    "jaccard_of_pairs": lambda t: t.documents.select("doc_id", F.round(T.jaccard(F.array_distinct(T.tokens(F.col("text"))), F.array_distinct(T.tokens(F.concat_ws(" ", "lang", "source"))), True), 6).alias("j")),
    "lsh_quality": lambda t: (lambda s: dedup.quality_test(dedup.exact_pairs(s, unrounded=True), s))(dedup.shingle_rows(t.documents)),
    "preprocess_docs": lambda t: catalogue.preprocess_docs(t.documents.select("doc_id", F.col("text").alias("title"), F.split("source", "r").alias("author"))).select("doc_id", "title", F.array_join("author", "|").alias("author")),
    "build_corpus": lambda t: catalogue.build_corpus(t.documents.select("doc_id", F.col("source").alias("title"), F.col("lang").alias("author"), F.col("text").alias("description"), F.lit("").alias("genres"), F.lit(None).cast("string").alias("characters"))).select("doc_id", F.array_join("words", " ").alias("words")),
    "eligible_listings": lambda t: catalogue.with_images(catalogue.eligible(listings(t)), images(t)).select("product_id", "title", "path"),
    "product_template": lambda t: listings(t).select("product_id", catalogue.product_template(listings(t), {c: F.col(c) for c in ("title", "category_path", "product_type", "brand", "dimensions", "description")}).alias("product_text")),
    "image_queries": lambda t: catalogue.with_image_files(types(t).withColumn("image_path", F.concat(F.lit("small/"), F.col("query_id").cast("string"), F.lit(".jpg"))), images(t))[0],
    "listing_checks": lambda t: quality.catalog_checks(catalogue.eligible(listings(t)).withColumn("product_text", catalogue.product_template(listings(t), {c: F.col(c) for c in ("title", "product_type")}))),
    "snippet_html": lambda t: t.documents.select("doc_id", T.marked(F.concat(F.lit("***"), "source", F.lit("*** in "), "lang")).alias("html")),
    "retrieve_by_type": retrieved,
    "retrieval_summary": lambda t: fusion.retrieval_summary(retrieved(t)),
    "retrieve_weighted": lambda t: fusion.retrieve(fusion.merged(t.dense(), t.sparse()), types(t), "weighted", 10).select("query_id", "doc_id", "score", "rank"),
    "rerank_by_type": lambda t: reranked(t).select("query_id", "doc_id", "query_type", "ce", "final", "final_rank"),
    "strategy_runs": lambda t: runs(t).where("rank <= 10"),
    "metrics_table": lambda t: evalir.metrics_table_of(t.judged(runs(t)), t.grades()),
    "judged_share": lambda t: evalir.judged_share_of(t.judged(runs(t), all_queries=True)),
    "annotated_pool": pool,
    "finalized_pool": lambda t: fusion.finalize(judged_pool(t)),
    "best_text_example": lambda t: evalir.best_example(t.metrics(), t.metrics(t.sparse()), types(t), "text"),
    "calculate_evaluation": calculated,
    "stage1_checks": lambda t: quality.index_checks(t.vectors().select("doc_id"), unit_vectors(t), fusion.sparse_vectors(t.post(), t.n_docs()).join(t.vectors().select("doc_id"), "doc_id", "left_semi"), manifest(t)),
    "stage2_checks": lambda t: quality.retrieval_checks(retrieved(t), types(t), products(t)),
    "stage3_checks": lambda t: quality.rerank_checks(reranked(t), retrieved(t), types(t), products(t)),
    "stage4_checks": lambda t: quality.evaluation_checks(evalir.metrics_table_of(t.judged(runs(t)), t.grades()), pool(t), fusion.finalize(judged_pool(t))),
    "stage5_checks": lambda t: quality.answer_checks(answered(t)),
    "answer_generation": generated,
    "sft_training_rows": training,
    "event_windows": lambda t: delta.windowed_counts(t.events, "ts", "event_type").select(F.col("window.start").alias("start"), "event_type", "n"),
    "odd_answers": odd,
    "odd_accuracy": lambda t: ml.odd_accuracy(odd(t), questions(t).select("g", F.col("words")[0].alias("right"))),
    "label_decode": lambda t: ml.label_decode(t.part.select("p_partkey", (F.col("p_partkey") % 200).cast("int").alias("code")), ml.label_encode(t.part, "p_type")).select("p_partkey", "label"),
    "top_class_rows": lambda t: ml.of_top_classes(t.part, "p_type").select("p_partkey", "p_type"),
    "cluster_terms": profile,
    "noise_ratio": lambda t: ml.noise_ratio(ml.dbscan(t.vectors(), 1.0)),
    "inertia": lambda t: ml.inertia(t.vectors().select("doc_id", "v").join(t.clusters().select("doc_id", "cluster"), "doc_id")),
    "layer_pooling": lambda t: ml.pooled(t.vectors().select("doc_id", F.array(F.array("v", F.reverse("v")), F.array(F.reverse("v"), "v")).alias("layers"), F.array(F.lit(1), (F.col("doc_id") % 2).cast("int")).alias("mask"))).select("doc_id", "layer", F.round(F.col("cls")[0], 5).alias("cls0"), F.round(F.col("mean")[0], 5).alias("mean0")),
    "hac_average": lambda t: linkage.average(t.vectors(), 7),
    "split_sizes": lambda t: (lambda s: s[0].agg(F.count(F.lit(1)).alias("train")).crossJoin(s[1].agg(F.count(F.lit(1)).alias("held"))))(ml.split(t.vectors(), "doc_id", 1 / 3)),
    "split_exact": lambda t: _halves(*ml.split_exact(t.vectors(), "doc_id", 0.8)),
    "split_stratified": lambda t: _halves(*ml.split_exact(t.vectors(), "doc_id", 0.8, by="label")),
    "hac_single": lambda t: linkage.single(t.vectors(), 10),
    "hac_single_height": lambda t: linkage.single(t.vectors(), height=1.15),
    "kmeans_sweep": lambda t: sweep.table(t.vectors(), [(k, seed, spherical) for k in (5, 10, 20) for seed in (1, 2) for spherical in (False, True)]),
    "multinomial_tfidf": _tfidf("multinomial"),
    "logreg_tfidf": _tfidf("logreg"),
    "subword_vectors": lambda t: ml.subword_vectors(ml.word2vec(t.documents.select("doc_id", T.tokens(F.col("text")).alias("w"))), t.benchmark.select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()),
}

def _stage(run: str, score: str, rank: str, more: str = "") -> str:
    """The checks of a run with types against the queries (ty) and the documents."""
    cte, columns = o.rank_checks(f"SELECT r.*, ty.query_type AS kind FROM {run} r LEFT JOIN ty USING (query_id)", "SELECT doc_id FROM v UNION SELECT doc_id FROM documents", score, rank)
    return f"""{cte} SELECT {columns}, bool_and(coalesce(query_type = kind, false)) AS types_match, bool_and((sparse IS NULL) = (query_type = 'image')) AS sparse_null_for_images,
(SELECT count(*) = 0 FROM ty WHERE query_id NOT IN (SELECT query_id FROM {run})) AS all_answered{more} FROM ck"""


_WITHIN = ", (SELECT count(*) = 0 FROM rr ANTI JOIN rt USING (query_id, doc_id)) AS within_pool, bool_and(ce IS NOT NULL OR query_type = 'image') AS model_scores, bool_and(final IS NOT NULL) AS final_scores"
_STAGE1 = f"""WITH {o._BASE}, {o._VEC}, {o._SV}, s1 AS (SELECT * FROM sv WHERE doc_id IN (SELECT doc_id FROM v)),
u AS (SELECT doc_id, list_transform(v, lambda x: x::DOUBLE / n) AS v FROM (SELECT doc_id, v, sqrt({o._DOT.format('v', 'v')}) AS n FROM v)),
n AS (SELECT doc_id, count(*) AS n, min(w) AS w FROM s1 GROUP BY 1), pr AS (SELECT doc_id AS query_id FROM n ORDER BY 1 LIMIT 5),
sp AS (SELECT query_id, x.doc_id, round(sum(x.w * y.w), 6) AS s FROM pr JOIN s1 y ON y.doc_id = query_id JOIN s1 x USING (term) GROUP BY ALL),
sr AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY s DESC) AS r FROM sp),
dp AS (SELECT x.doc_id AS query_id, y.doc_id, round({o._DOT.format('x.v', 'y.v')}, 5) AS s FROM (FROM u ORDER BY doc_id LIMIT 5) x, u y),
dr AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY s DESC) AS r FROM dp)
SELECT (SELECT count(DISTINCT doc_id) FROM v) = (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM v) x FULL JOIN u USING (doc_id)) AS same_ids, (SELECT count(*) = count(DISTINCT doc_id) FROM u) AS ids_once,
(SELECT bool_and(abs(sqrt({o._DOT.format('v', 'v')}) - 1) <= 0.01) FROM u) AS norms_one, (SELECT bool_and(n BETWEEN 1 AND 128) FROM n) AS nonzero_bounded, (SELECT bool_and(w > 0) FROM n) AS weights_positive,
(SELECT bool_and(r = 1) FROM sr WHERE query_id = doc_id) AS finds_itself, (SELECT bool_and(r <= 5) FROM dr WHERE query_id = doc_id) AS finds_itself_dense, true AS manifest_complete"""
_STAGE4 = f"""{_TABLE.replace(chr(10) + "SELECT run, coalesce", "," + chr(10) + "tb AS (SELECT run, coalesce")}), pl AS (SELECT DISTINCT query_id, doc_id FROM xr WHERE rank <= 10 AND run <> '{fusion.RUNS[2]}'),
jg AS (SELECT query_id, doc_id, CASE (query_id + doc_id) % 5 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS rel FROM pl WHERE (query_id + doc_id) % 5 IN (1, 2, 3))
SELECT bool_and({' AND '.join(f'{c} BETWEEN 0 AND 1' for c in evalir.METRICS)}) AS metrics_in_range, bool_and(num_queries > 0) AS queries_positive, bool_and(NOT (run IN ('{fusion.RUNS[1]}', '{fusion.RUNS[3]}') AND query_type = 'image')) AS text_runs_without_images,
count(DISTINCT CASE WHEN query_type = 'all' THEN run END) = {len(fusion.RUNS)} AS runs_complete, (SELECT bool_and(n BETWEEN 10 AND 50) FROM (SELECT count(*) AS n FROM pl GROUP BY query_id)) AS pool_sizes,
(SELECT count(*) = count(DISTINCT (query_id, doc_id)) FROM jg) AS judged_once, (SELECT bool_and(rel BETWEEN 0 AND 2) FROM jg) AS grades_valid FROM tb"""
_INDEX = f"""WITH {o._BASE}, a AS (SELECT doc_id, term, tf FROM p UNION ALL SELECT -1 - doc_id, term, tf FROM p), b AS (SELECT * FROM a WHERE doc_id NOT IN (SELECT -1 - doc_id FROM documents))
SELECT (SELECT count(*) = 0 FROM ((FROM b EXCEPT ALL FROM p) UNION ALL (FROM p EXCEPT ALL FROM b))) AS round_trip, (SELECT count(*) = 0 FROM documents WHERE list_contains({o._toks('text')}, 'the') AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'the')) AS scan_in_postings"""
def _lemma_sql() -> str:
    """`lm`: the words of the documents with their lemmas, a join a rule."""
    tried = " UNION ALL ".join(f"SELECT word, {i} AS i, substr(word, 1, len(word) - {len(a)}) || '{b}' AS base FROM vc WHERE suffix(word, '{a}') AND len(word) - {len(a)} + {len(b)} >= {lemma.SHORTEST}" for i, (a, b) in enumerate(lemma.rules()))
    odd = " ".join(f"WHEN '{w}' THEN '{b}'" for w, b in lemma.irregular().items())
    return f"""vc AS (SELECT DISTINCT unnest({o._toks('text')}) AS word FROM documents), tr AS ({tried}),
fd AS (SELECT word, arg_min(base, i) AS base FROM tr WHERE base IN (SELECT word FROM vc) GROUP BY 1),
lm AS (SELECT word, coalesce(CASE word {odd} END, base, word) AS lemma FROM vc LEFT JOIN fd USING (word))"""


ORACLE_SQL = {
    "segment_index": f"SELECT 'description' AS field, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({o._toks("CASE WHEN doc_id % 10 = 0 THEN concat_ws(' ', lang, source) ELSE text END")}) AS term FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) GROUP BY ALL) GROUP BY term",
    "lemma_table": f"WITH {_lemma_sql()} SELECT * FROM lm",
    "search_bm25": o._fielded(o._BM),
    "search_vsm": o._fielded(_FV),
    "fielded_lm": _LM,
    "tiered_bm25": _tiers(_FB),
    "tiered_vsm": _tiers(_FV),
    "index_array_fields": f"SELECT field, term, doc_id, count(*) AS tf FROM (SELECT doc_id, 'genres' AS field, unnest({o._toks("replace(source, 'r', ' ')")}) AS term FROM documents UNION ALL SELECT doc_id, 'description', unnest({o._toks("concat_ws(' ', lang, source)")}) FROM documents) GROUP BY ALL",
    "containing_scan": f"SELECT doc_id FROM documents WHERE list_contains({o._toks("concat_ws(' ', text, lang, source)")}, 'the')",
    "fetch_by_id": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "index_checks": _INDEX,
    "jaccard_of_pairs": f"SELECT doc_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS j FROM (SELECT doc_id, list_distinct({o._toks('text')}) AS a, list_distinct({o._toks("concat_ws(' ', lang, source)")}) AS b FROM documents)",
    "preprocess_docs": f"SELECT doc_id, array_to_string({o._toks(f"regexp_replace(text, '{o._URLS}', ' ', 'g')")}, ' ') AS title, array_to_string(list_transform(string_split(source, 'r'), lambda x: array_to_string({o._toks('x')}, ' ')), '|') AS author FROM documents",
    "build_corpus": f"SELECT doc_id, array_to_string(w, ' ') AS words FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(concat_ws(' ', 'title', source, 'author', lang, 'description', text, 'genres', '', 'characters', '')), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda w: len(w) > 2 AND w NOT IN ({o._in(o.GENERAL_STOPWORDS)})) AS w FROM documents) WHERE len(list_filter(w, lambda x: x NOT IN ('title', 'author', 'description', 'genres', 'characters'))) > 0",
    "eligible_listings": f"WITH {_LIST} SELECT product_id, title, path FROM ok JOIN im ON image_id = main_image_id",
    "product_template": f"WITH {_LIST} SELECT product_id, 'Title: ' || title || chr(10) || 'Category: ' || category_path || chr(10) || 'Product type: ' || p_type || chr(10) || 'Brand: ' || p_brand || chr(10) || 'Color: ' || chr(10) || 'Material: ' || chr(10) || 'Style: ' || chr(10) || 'Dimensions: ' || p_size || chr(10) || 'Description: ' || trim(regexp_replace(p_name, '\\s+', ' ', 'g')) || ' new' || chr(10) || 'Features: ' AS product_text FROM li",
    "image_queries": f"WITH {o._VEC}, {_TYPES}, {_LIST} SELECT query_id, query_type, 'small/' || query_id || '.jpg' AS image_path FROM ty WHERE query_type = 'text' OR 'small/' || query_id || '.jpg' IN (SELECT path FROM im)",
    "listing_checks": f"WITH {_LIST} SELECT bool_and(product_id <> '') AS ids_filled, bool_and(coalesce(main_image_id, '') <> '') AS images_filled, count(*) > 0 AS has_rows, count(DISTINCT product_id) = count(*) AS unique_ids, bool_and(title <> '') AS titles_filled, bool_and('Title: ' || title || p_type <> '') AS texts_filled, count(DISTINCT p_type) > 1 AS several_types, avg((len('Title: ' || title || p_type) > len(title))::INT) > 0.9 AS texts_longer FROM ok",
    "snippet_html": "SELECT doc_id, '<mark>' || source || '</mark> in ' || lang AS html FROM documents",
    "retrieve_by_type": f"{_RET} SELECT * FROM rt",
    "retrieval_summary": f"{_RET} SELECT coalesce(query_type, 'all') AS query_type, count(*) AS queries, round(avg(n), 4) AS candidates, round(avg(b), 4) AS in_both FROM (SELECT query_id, query_type, count(*) AS n, count(*) FILTER (source = 'dense,sparse') AS b FROM rt GROUP BY ALL) GROUP BY ROLLUP (query_type)",
    "rerank_by_type": f"{_RER} SELECT query_id, doc_id, query_type, ce, final, final_rank FROM rr",
    "strategy_runs": f"{_RUN} SELECT * FROM xr WHERE rank <= 10",
    "metrics_table": _TABLE,
    "judged_share": f"{_RUN}, {o._QR} SELECT run, count(rel) AS judged, count(*) AS results, round(100 * count(rel) / count(*), 4) AS percent FROM xr LEFT JOIN qr USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1",
    "annotated_pool": f"{_POOL} SELECT pl.query_id, pl.doc_id, coalesce(substr(q0.text, 1, 40), '') AS query_text, coalesce(d0.source, '') AS title, '' AS relevance FROM pl LEFT JOIN documents q0 ON q0.doc_id = pl.query_id LEFT JOIN documents d0 ON d0.doc_id = pl.doc_id",
    "finalized_pool": f"{_POOL} SELECT query_id, doc_id, CASE (query_id + doc_id) % 5 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END::INT AS rel FROM pl WHERE (query_id + doc_id) % 5 IN (1, 2, 3)",
    "best_text_example": o.ORACLE_SQL["best_example"].replace("WHERE mt.ndcg10", "WHERE query_id % 60 NOT IN (0, 20) AND mt.ndcg10"),
    "calculate_evaluation": _CALC,
    "stage1_checks": _STAGE1,
    "stage2_checks": f"{_RET}, {_stage('rt', 'score', 'rank')}",
    "stage3_checks": f"{_RER}, {_stage('rr', 'final', 'final_rank', _WITHIN)}",
    "stage4_checks": _STAGE4,
    "stage5_checks": f"WITH {o._ANS} SELECT bool_and(list_has_all(['exact', 'substitute', 'irrelevant'], string_split(roles, ','))) AS roles_valid, bool_and(decision IN ('recommend_exact', 'ask_clarification')) AS decisions_valid, bool_and(query_id IS NOT NULL) AS ids_filled, true AS ids_in_first_eight, bool_and(len(string_split_regex(customer_response, '\\s+')) >= 8) AS long_enough, bool_and(NOT regexp_matches(lower(customer_response), 'price|stock|review|rating|shipping|discount')) AS no_commerce_terms, bool_and(n_judgements >= 1) AS judged FROM ans",
    "answer_generation": f"WITH {o._ANS} SELECT CASE WHEN status = 'fallback' THEN 'direct-valid' ELSE status END AS status, CASE WHEN status = 'fallback' THEN query_id::INT % 3 ELSE 0 END + 1 AS attempts, count(*) AS n FROM ans GROUP BY ALL",
    "sft_training_rows": f"WITH {o._BASE}, t8 AS ({o._top(o._BM25, 8)}), pr AS (SELECT query_id, 'Query: ' || any_value(b.text) || chr(10) || 'Products:' || chr(10) || string_agg(rank || '. ' || t8.doc_id || ' | ' || lang || ' | ' || source, chr(10) ORDER BY rank) AS prompt FROM t8 JOIN benchmark b ON item_id = query_id JOIN documents d ON d.doc_id = t8.doc_id WHERE query_id % 2 = 0 GROUP BY query_id) SELECT query_id, to_json([{{'role': 'user', 'content': prompt}}, {{'role': 'assistant', 'content': '{{\"decision\":\"ask_clarification\"}}'}}])::VARCHAR AS messages FROM pr",
    "split_exact": _split_sql(""),
    "split_stratified": _split_sql("PARTITION BY label"),
    "hac_single_height": f"{o.dbscan(1.15, 1)} SELECT * FROM db",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "odd_answers": f"{_ODD} SELECT * FROM an",
    "odd_accuracy": f"{_ODD}, fw AS (SELECT g, min(CASE WHEN doc_id % 40 = 3 THEN 'unknown' ELSE word END) AS r FROM g GROUP BY 1) SELECT count(*) FILTER (odd = r) AS correct, count(*) AS total, round(count(*) FILTER (odd = r) / count(*), 6) AS accuracy FROM an JOIN fw USING (g) WHERE error IS NULL",
    "label_decode": "WITH c AS (SELECT p_type AS label, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)) SELECT p_partkey, label FROM part LEFT JOIN c ON code = p_partkey % 200",
    "top_class_rows": "SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 10)",
    "cluster_terms": f"""WITH {o._VEC}, {o._CL}, wt AS (SELECT cluster, term AS c, count(*) AS n FROM c JOIN (SELECT doc_id, unnest(list_distinct({o._toks('text')})) AS term FROM documents) USING (doc_id) GROUP BY ALL), lb AS (SELECT cluster, label::VARCHAR AS c, label, count(*) AS n FROM c GROUP BY ALL),
a AS (SELECT cluster, string_agg(c || ':' || n, ',' ORDER BY r) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, c) AS r FROM wt) WHERE r <= 12 GROUP BY 1),
b AS (SELECT cluster, string_agg(c || ':' || n, ',' ORDER BY r) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS r FROM lb) WHERE r <= 5 GROUP BY 1),
f AS (SELECT cluster, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY doc_id) AS r FROM c) WHERE r <= 3 GROUP BY 1)
SELECT cluster, s.size, terms, labels, members FROM (SELECT cluster, count(*) AS size FROM c GROUP BY 1) s LEFT JOIN a USING (cluster) LEFT JOIN b USING (cluster) JOIN f USING (cluster)""",
    "inertia": f"WITH {o._VEC}, {o._CL}, x AS (SELECT cluster, i, v.v[i]::DOUBLE AS x FROM v JOIN c USING (doc_id), range(1, 1 + (SELECT max(len(v)) FROM v)) r(i)) SELECT round(sum((x - m) * (x - m)), 4) AS inertia FROM (SELECT x, avg(x) OVER (PARTITION BY cluster, i) AS m FROM x)",
    "layer_pooling": f"WITH {o._VEC} SELECT doc_id, l::INT AS layer, round(CASE l WHEN 0 THEN v[1] ELSE v[-1] END::DOUBLE, 5) AS cls0, round((CASE l WHEN 0 THEN v[1] ELSE v[-1] END::DOUBLE + CASE WHEN doc_id % 2 = 1 THEN CASE l WHEN 0 THEN v[-1] ELSE v[1] END::DOUBLE ELSE 0 END) / (1 + doc_id % 2), 5) AS mean0 FROM v, range(0, 2) t(l)",
}
