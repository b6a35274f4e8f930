"""Each check is true of a good table and false of one with the fault that it names, and the other checks stay true."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import index, quality
from lexloom.operators.evalir import METRICS
from lexloom.operators.fusion import RUNS


def flags(df):
    return df.first().asDict()


def fails(df, *names):
    got = flags(df)
    assert {k for k, v in got.items() if not v} == set(names), got


RUN = "query_id long, query_type string, doc_id long, dense double, sparse double, score double, rank int"
GOOD = [(1, "text", 1, 0.9, 0.5, 0.9, 1), (1, "text", 2, 0.8, 0.4, 0.8, 2), (2, "image", 1, 0.7, None, 0.7, 1)]
RUN_FAULTS = {
    "ranks_dense": [*GOOD[:1], (1, "text", 2, 0.8, 0.4, 0.8, 3), GOOD[2]],
    "scores_fall": [*GOOD[:1], (1, "text", 2, 0.8, 0.4, 0.95, 2), GOOD[2]],
    "ids_unique": [*GOOD[:1], (1, "text", 1, 0.8, 0.4, 0.8, 2), GOOD[2]],
    "ids_known": [*GOOD[:1], (1, "text", 77, 0.8, 0.4, 0.8, 2), GOOD[2]],
    "types_match": [(1, "image_text", 1, 0.9, 0.5, 0.9, 1), *GOOD[1:]],
    "sparse_null_for_images": [*GOOD[:2], (2, "image", 1, 0.7, 0.1, 0.7, 1)],
    "all_answered": GOOD[:2],
}


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "text"), (2, "image")], "query_id long, query_type string")


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([(i,) for i in range(10)], "doc_id long")


@pytest.mark.parametrize("fault", [None, *RUN_FAULTS])
def test_retrieval_checks(spark, queries, catalog, fault):
    run = spark.createDataFrame(RUN_FAULTS.get(fault, GOOD), RUN)
    fails(quality.retrieval_checks(run, queries, catalog), *([fault] if fault else []))
    if fault in (None, "ranks_dense", "scores_fall", "ids_unique", "ids_known"):
        fails(quality.ranking_checks(run, catalog), *([fault] if fault else []))


RERANK_FAULTS = {"within_pool": {"doc_id": 5}, "model_scores": {"ce": None}, "final_scores": {"final": None}}


@pytest.mark.parametrize("fault", [None, *RERANK_FAULTS, *RUN_FAULTS])
def test_rerank_checks(spark, queries, catalog, fault):
    pool = spark.createDataFrame(GOOD + [(1, "text", 77, 0.0, 0.0, 0.0, 3)], RUN)
    rows = [{"query_id": a, "query_type": b, "doc_id": c, "dense": d, "sparse": e, "final": f, "final_rank": g, "ce": 0.5 if b != "image" else None} for a, b, c, d, e, f, g in RUN_FAULTS.get(fault, GOOD)]
    if fault in RERANK_FAULTS:
        rows[1] |= RERANK_FAULTS[fault]
    x = spark.createDataFrame(rows, "query_id long, query_type string, doc_id long, dense double, sparse double, final double, final_rank int, ce double")
    fails(quality.rerank_checks(x, pool, queries, catalog), *([fault] if fault else []))


def stage1(spark, fault):
    ids = list(range(8))
    dense = {i: [1.0 if k == i else 0.0 for k in range(8)] for i in ids}
    sparse = [(i, f"t{i}", 2.0) for i in ids] + [(i, "all", 0.1) for i in ids]
    fields = list(quality.MANIFEST_FIELDS)
    rows = list(dense.items())
    if fault == "same_ids":
        rows.append((50, [1.0] + [0.0] * 7))
    if fault == "ids_once":
        rows.append((7, dense[7]))
    if fault == "norms_one":
        rows[6] = (6, [0.5 * x for x in dense[6]])
    if fault == "nonzero_bounded":
        sparse += [(7, f"x{k}", 0.1) for k in range(130)]
    if fault == "weights_positive":
        sparse.append((7, "y", 0.0))
    if fault == "finds_itself":
        sparse.append((5, "t2", 9.0))
    if fault == "finds_itself_dense":
        rows = [(i, [0.995, 0.0] + [0.0] * 6 if i == 0 else [1.0] + [0.0] * 7) for i in ids]
    if fault == "manifest_complete":
        fields = fields[1:]
    make = spark.createDataFrame
    return make([(i,) for i in ids], "doc_id long"), make(rows, "doc_id long, v array<double>"), make(sparse, "doc_id long, term string, w double"), make([tuple(fields)], fields)


@pytest.mark.parametrize("fault", [None, "same_ids", "ids_once", "norms_one", "nonzero_bounded", "weights_positive", "finds_itself", "finds_itself_dense", "manifest_complete"])
def test_stage_1_checks(spark, fault):
    fails(quality.index_checks(*stage1(spark, fault)), *([fault] if fault else []), *(["ids_once"] if fault == "same_ids" else ["same_ids"] if fault == "ids_once" else []))


TABLE = [{"run": r, "query_type": t, "num_queries": 3, **dict.fromkeys(METRICS, 0.5)} for r in RUNS for t in ("text", "all")]


@pytest.mark.parametrize("fault", [None, "metrics_in_range", "queries_positive", "text_runs_without_images", "runs_complete", "pool_sizes", "judged_once", "grades_valid"])
def test_evaluation_checks(spark, fault):
    table, pool, qrels = [dict(x) for x in TABLE], [(1, d) for d in range(12)], [(1, d, d % 3) for d in range(12)]
    if fault == "metrics_in_range":
        table[0][METRICS[0]] = 1.5
    if fault == "queries_positive":
        table[0]["num_queries"] = 0
    if fault == "text_runs_without_images":
        table.append({**table[0], "run": RUNS[1], "query_type": "image"})
    if fault == "runs_complete":
        table = [x for x in table if x["run"] != RUNS[2]]
    if fault == "pool_sizes":
        pool.append((2, 1))
    if fault == "judged_once":
        qrels.append(qrels[0])
    if fault == "grades_valid":
        qrels.append((2, 1, 3))
    schema = "run string, query_type string, num_queries int, " + ", ".join(f"{c} double" for c in METRICS)
    x = quality.evaluation_checks(spark.createDataFrame(table, schema), spark.createDataFrame(pool, "query_id long, doc_id long"), spark.createDataFrame(qrels, "query_id long, doc_id long, rel int"))
    fails(x, *([fault] if fault else []))


@pytest.mark.parametrize("fault", [None, "round_trip", "scan_in_postings"])
def test_index_checks(spark, monkeypatch, fault):
    docs = spark.createDataFrame([(1, "the cat"), (2, "a dog"), (3, "The end.")], "doc_id long, text string")
    p = index.postings(docs)
    if fault == "round_trip":
        monkeypatch.setattr(index, "remove", lambda rows, ids: rows.where("term <> 'dog'"))
    if fault == "scan_in_postings":
        p = p.where("doc_id <> 3")
    fails(index.index_checks(docs, p, "the"), *([fault] if fault else []))


CATALOG = [("1", "lamp", "home", "Title: lamp", "img1"), ("2", "chair", "seat", "Title: chair", "img2")]


@pytest.mark.parametrize(
    "fault, rows",
    [
        (None, CATALOG),
        ("ids_filled", [*CATALOG, ("", "x", "home", "Title: x", "i")]),
        ("images_filled", [*CATALOG, ("3", "x", "home", "Title: x", None)]),
        ("unique_ids", [*CATALOG, CATALOG[0]]),
        ("titles_filled", [*CATALOG, ("3", "", "home", "Title: x", "i")]),
        ("several_types", CATALOG[:1]),
        ("texts_longer", [*CATALOG, ("3", "a long title", "home", "short", "i")]),
    ],
)
def test_catalog_checks(spark, fault, rows):
    x = spark.createDataFrame(rows, "product_id string, title string, product_type string, product_text string, main_image_id string")
    fails(quality.catalog_checks(x), *([fault] if fault else []))
    if fault is None:
        assert not flags(quality.catalog_checks(x.limit(0)))["has_rows"]
        assert not flags(quality.catalog_checks(x.withColumn("product_text", F.lit(""))))["texts_filled"]


ANSWER = {"query_id": "1", "roles": "exact", "decision": "recommend_exact", "customer_response": "take this one as it is the best fit", "n_judgements": 1, "judged": ["1"], "products": ["1", "2"]}


@pytest.mark.parametrize(
    "fault, change",
    [(None, {}), ("roles_valid", {"roles": "exact,maybe"}), ("decisions_valid", {"decision": "buy"}), ("ids_filled", {"query_id": None}), ("ids_in_first_eight", {"judged": ["9"]}), ("long_enough", {"customer_response": "too short"}), ("no_commerce_terms", {"customer_response": ANSWER["customer_response"] + " at this price"}), ("judged", {"n_judgements": 0})],
)
def test_answer_checks(spark, fault, change):
    x = spark.createDataFrame([ANSWER, ANSWER | change], "query_id string, roles string, decision string, customer_response string, n_judgements int, judged array<string>, products array<string>")
    fails(quality.answer_checks(x), *([fault] if fault else []))
