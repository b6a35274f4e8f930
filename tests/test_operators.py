"""Golden values and edge cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import answers, catalogue, dedup, evalir, fusion, index, ml, rank, search, snippet, spell
from lexloom.sources import tables
from lexloom.streaming import delta


def one(df):
    return df.collect()[0]


def test_graded_metrics(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "c", 1), ("q", "x", 1)], "query_id string, doc_id string, rel int")
    m = one(evalir.metrics(run, qrels))
    assert math.isclose(m.ap, 5 / 9, abs_tol=1e-6) and math.isclose(m.ndcg10, 0.8472668888, abs_tol=1e-6) and m.rr == 1.0
    assert evalir.metrics(run, qrels.limit(0)).count() == 0


def test_text(spark):
    df = spark.sql("select 'cat' w, 'a b a b' s, 'a' o, '' e, cast(null as string) n, 'see http://x.y and Me@b.c now!' u")
    r = one(df.select(T.kgrams(F.col("w")).alias("k"), T.shingles(T.tokens(F.col("s"))).alias("s"), T.shingles(T.tokens(F.col("o"))).alias("o"), T.shingles(T.tokens(F.col("e"))).alias("e"), T.normalised(F.col("u")).alias("u")))
    assert r.k == ["$c", "ca", "at", "t$"] and r.s == ["a b", "b a"] and r.o == ["a"] and r.e == [] and r.u == "see and now"
    assert [T.porter(w) for w in ("caresses", "ponies", "relational", "hopping", "controlling")] == ["caress", "poni", "relat", "hop", "control"]


def test_index_round_trip(spark):
    docs = spark.createDataFrame([(1, "good book good"), (2, None), (3, "")], "doc_id long, text string")
    p = index.postings(docs)
    more = index.postings(spark.createDataFrame([(100, "good new")], "doc_id long, text string"))
    back = index.remove(index.add(p, more), more.select("doc_id"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, p.collect()))
    assert index.add(p, p).exceptAll(p).count() == 0
    tf = spark.createDataFrame([("description", "a", 1, 10), ("description", "b", 1, 5), ("description", "c", 1, 4)], "field string, term string, doc_id long, tf long")
    assert [r.tier for r in index.tiered(tf).orderBy("term").collect()] == [1, 2, 3]


def test_repeated_query_term_counts_twice(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d e")], "doc_id long, text string")
    p, dl = index.postings(docs).drop("field"), docs.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("dl"))
    n = dl.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl"))
    q = rank.query_terms(spark.createDataFrame([(1, "a"), (2, "a a"), (3, "zz")], "k long, t string"), "k", "t")
    s = {r.query_id: r.score for r in rank.bm25(p, q, dl, n).collect()}
    assert math.isclose(s[2], 2 * s[1], abs_tol=1e-4) and 3 not in s


def test_fusion(spark):
    hits = spark.createDataFrame([(1, 7, 3.0, 1), (1, 8, 3.0, 2)], "query_id int, doc_id int, score double, rank int")
    assert one(fusion.rrf(fusion.merged(hits, hits)).orderBy(F.desc("score"))).score == round(2 / 60, 8)
    assert {r.m for r in hits.select(fusion.minmax("score").alias("m")).collect()} == {0.0}


def test_snippet_without_hit(spark):
    docs = spark.createDataFrame([(1, "nothing here")], "doc_id long, text string")
    q = spark.createDataFrame([(5, "absent")], "query_id long, text string")
    pairs = spark.createDataFrame([(5, 1)], "query_id long, doc_id long")
    assert one(snippet.snippets(pairs, docs, q)).snippet == " ... "


def test_consecutive_pairs_are_near_duplicates(spark):
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(80)) + (" end" if i % 2 else "")) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in dedup.near_duplicates_removed(docs).collect()) == list(range(0, 20, 2))


def test_answers(spark):
    rows = [("1", "not json", ["p"]), ("2", None, ["p"]), ("3", '{"query_id": "x"}', [])]
    got = {r.query_id: r.status for r in answers.validate(spark.createDataFrame(rows, "query_id string, raw string, products array<string>")).collect()}
    assert set(got.values()) == {"fallback"}


def test_sources(spark, tmp_path):
    (tmp_path / "b.csv").write_text('bookId,title,author,description,genres,characters,language,publish_date,num_pages,avg_rating\n1,"A, b",c,"two\nlines","x, y",,en,2000,12.0,\n')
    b = one(tables.read_books(spark, str(tmp_path / "b.csv")))
    assert b.genres == ["x", "y"] and b.num_pages == 12 and b.avg_rating == 0.0 and b.description == "two\nlines"
    run = spark.createDataFrame([("q", 2, "b", 0.5), ("q", 1, "a", 0.9)], "query_id string, rank int, doc_id string, score double")
    tables.write_runs(run, str(tmp_path / "run"), ["doc_id", "score"])
    assert sorted(map(tuple, tables.read_runs(spark, str(tmp_path / "run"), "doc_id:string,score:double").collect())) == [("q", 1, "a", 0.9), ("q", 2, "b", 0.5)]
    encode = lambda df: df.select("query_id", F.length("query_id").alias("n"))
    q = spark.createDataFrame([("a",), ("bb",)], "query_id string")
    assert tables.cached(q.limit(1), str(tmp_path / "cache"), encode).count() == 1
    assert tables.cached(q, str(tmp_path / "cache"), encode).count() == 2
    assert "| q | 1 |" in tables.markdown(run.orderBy("rank"), "t")


def test_stream_keeps_the_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = delta.maintain(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "idx"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(map(tuple, delta.latest(spark, str(tmp_path / "idx"), 1).collect())) == sorted(map(tuple, index.postings(docs).collect()))


def test_stems_meet_in_search_and_snippets(spark):
    docs = spark.createDataFrame([(1, "Many books about hopping"), (2, "one book"), (3, "nothing")], "doc_id long, text string")
    where = search.Collection(docs, {"description": F.col("text")}, stems=True)
    q = spark.createDataFrame([(7, "books hop")], "query_id long, text string")
    assert {r.doc_id for r in search.search(where, q, "okapibm25", {"description": 1.0}).collect()} == {1, 2}
    plain = search.Collection(docs, {"description": F.col("text")})
    assert {r.doc_id for r in search.search(plain, q, "bm25", {"description": 1.0}).collect()} == {1}
    pairs = spark.createDataFrame([(7, 2)], "query_id long, doc_id long")
    assert one(snippet.snippets(pairs, docs, q, stems=True)).snippet == "one ***book***"
    fields = {"characters": F.lit("x"), "genres": F.lit("y"), "description": F.col("text")}
    found = search.search_text(search.Collection(docs, fields), "book", 5, "ltn.lnn").collect()
    assert [(r.doc_id, r.rank) for r in found] == [(2, 1)]
    for bad in ({}, {"description": 0}):
        try:
            search.search(plain, q, "bm25", bad)
        except ValueError:
            continue
        raise AssertionError("a search without weights must be refused")


def test_stored_index_gives_the_same_results(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c d e")], "doc_id long, text string")
    fields = {"description": F.col("text")}
    q = spark.createDataFrame([(1, "a c")], "query_id long, text string")
    stored = search.Collection(docs, fields, postings=index.postings(docs), lengths=index.lengths(docs, fields))
    for method, safe in (("bm25", True), ("unigram", True), ("lnc.ltc", True), ("ltn.lnn", False)):
        a, b = (sorted(map(tuple, search.search(w, q, method, {"description": 1.0}, safe).collect())) for w in (stored, search.Collection(docs, fields)))
        assert a == b and a


def test_fielded_probabilities_add_up(spark):
    a = spark.createDataFrame([(1, 1, math.log(0.2)), (1, 2, -9999.0)], "query_id int, doc_id int, score double")
    b = spark.createDataFrame([(1, 1, math.log(0.1)), (1, 3, math.log(0.5))], "query_id int, doc_id int, score double")
    got = {r.doc_id: r.score for r in rank.log_mixture({"x": a, "y": b}, {"x": 0.3, "y": 0.4}).collect()}
    assert got == {1: round(math.log(0.3 * 0.2 + 0.4 * 0.1), 4), 3: round(math.log(0.2), 4)}


def test_array_fields_and_scans(spark):
    docs = spark.createDataFrame([(1, ["Sci Fi", None, "war"], "the end"), (2, None, None)], "doc_id long, genres array<string>, text string")
    p = {(r.term, r.doc_id): r.tf for r in index.postings(docs, {"genres": F.col("genres")}).collect()}
    assert p == {("sci", 1): 1, ("fi", 1): 1, ("war", 1): 1}
    assert [r.doc_id for r in index.containing(docs, "war", {"g": F.col("genres"), "t": F.col("text")}).collect()] == [1]


def test_an_update_to_an_empty_text_drops_the_postings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    p = index.postings(docs)
    empty = spark.createDataFrame([(1, "")], "doc_id long, text string")
    assert {r.doc_id for r in index.add(p, index.postings(empty), empty).collect()} == {2}
    schema = "doc_id long, text string"
    for i, rows in enumerate(([(1, "a b"), (2, "b")], [(1, "")])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        delta.maintain(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "idx"), str(tmp_path / "cp")).awaitTermination(120)
        assert i == 0 or {r.doc_id for r in delta.latest(spark, str(tmp_path / "idx"), 2).collect()} == {2}


def test_prefixes_lose_no_pair(spark):
    import random

    r = random.Random(1)
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(w for w in base if r.random() > 0.08) + f" x{i % 3}") for i in range(40)]
    sets = {i: {f"{a} {b}" for a, b in zip(t.split(), t.split()[1:], strict=False)} for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.8}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x.a, x.b) for x in dedup.exact_pairs(dedup.shingle_rows(docs)).collect()} == want and want
    vocab = spark.createDataFrame([("".join(r.choice("abc") for _ in range(r.randint(1, 7))), 1) for _ in range(150)], "word string, n long").dropDuplicates(["word"])
    words = spark.createDataFrame([("".join(r.choice("abc") for _ in range(r.randint(1, 7))),) for _ in range(30)], "word string").distinct()
    grams = lambda w: {f"${w}$"[i : i + 2] for i in range(len(w) + 1)}
    near = {(a.word, b.word) for a in words.collect() for b in vocab.collect() if len(grams(a.word) & grams(b.word)) / len(grams(a.word) | grams(b.word)) > 0.4}
    assert {(x.word, x.candidate) for x in spell.nearest_words(words, vocab, best=1000).collect()} == near
    assert dedup.PRIME == 268435459 and [dedup.next_prime(n) for n in (0, 1, 2, 13)] == [2, 2, 3, 17]


def test_blocks_of_vectors(spark, monkeypatch):
    import numpy as np
    from lexloom.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 7 * 8 * 5)
    x = np.random.default_rng(0).normal(size=(60, 5)).round(3)
    x[5] = x[9] = x[20]
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(100, None, 0), (101, [None] * 5, 1)], "doc_id long, v array<double>, label int").repartition(4)
    q = rows.where("doc_id < 20 or doc_id >= 100").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    got = {}
    for h in fusion.dense_search(q, rows, 4).orderBy("query_id", "rank").collect():
        got.setdefault(h.query_id, []).append(h.doc_id)
    assert got == {i: sorted((j for j in range(60) if j != i), key=lambda j, i=i: (-round(float(x[i] @ x[j]), 5), j))[:4] for i in range(20)}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    good = rows.where("doc_id < 100")
    assert {(r.a, r.b) for r in ml.neighbours_within(good, 1.2).collect()} == {(i, j) for i in range(60) for j in range(60) if d[i, j] <= 1.2}
    s = []
    for i in range(60):
        mean = [np.mean([d[i, j] for j in range(60) if j % 3 == c and j != i]) for c in range(3)]
        a, b = mean[i % 3], min(m for c, m in enumerate(mean) if c != i % 3)
        s.append((b - a) / max(a, b))
    assert math.isclose(one(ml.silhouette(good)).silhouette, np.mean(s), abs_tol=2e-5)


def test_agglomerative_clusters(spark):
    points = [(i, [float(c * 10 + i % 4), float(i % 3)]) for c in range(3) for i in range(c * 20, c * 20 + 12)]
    df = spark.createDataFrame(points, "doc_id long, v array<double>")
    for linkage in ("single", "complete", "average"):
        assert {r.doc_id: r.cluster for r in ml.hac(df, 3, linkage).collect()} == {i: i // 20 * 20 for i, _ in points}
    assert ml.hac(df.limit(0), 3).count() == 0
    try:
        ml.hac(df, 3, limit=5)
    except ValueError:
        return
    raise AssertionError("more points than the limit must be refused")


def test_models_and_vectors(spark, tmp_path):
    words = spark.createDataFrame([(i, ["red", "fox", "runs"] if i % 2 else ["blue", "bird", "sings"]) for i in range(60)], "doc_id long, w array<string>")
    made = {r.word: r.vector for r in ml.word2vec(words, 4, save_to=str(tmp_path / "m")).collect()}
    assert {r.word: r.vector for r in ml.word_vectors(str(tmp_path / "m")).collect()} == made
    (tmp_path / "v.txt").write_text("2 2\nfox 1.0 2.0\nbox 3.0 4.0\n")
    read = ml.read_word_vectors(spark, str(tmp_path / "v.txt"))
    got = {r.word: r.vector for r in ml.subword_vectors(read, spark.createDataFrame([("foxy",), ("zzz",)], "word string")).collect()}
    assert set(got) == {"foxy"} and got["foxy"] == [1.0, 2.0]
    noisy = spark.createDataFrame([(1, -1), (2, 5), (3, 5), (4, 7)], "doc_id long, cluster long")
    assert tuple(one(ml.noise_ratio(noisy))) == (0.25, 2)


def test_axes_keep_their_signs(spark):
    points = spark.createDataFrame([(i, [float(i), 0.5 * i, (-1.0) ** i]) for i in range(10)], "doc_id long, v array<double>")
    x = {r.doc_id: r.x for r in ml.pca_2d(points).collect()}
    assert [x[i] < x[i + 1] for i in range(9)] == [True] * 9 and x[0] < 0 < x[9]


def test_sources_of_the_product_search(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"]), (2, [])], "doc_id long, w array<string>")
    tables.write_json_array(df, str(tmp_path / "a"))
    assert sorted(map(tuple, tables.read_json_array(spark, str(tmp_path / "a"), "doc_id long, w array<string>").collect())) == [(1, ["a"]), (2, [])]
    (tmp_path / "im.csv").write_text("image_id,height,width,path\nx,1,2,a/b.jpg\n")
    assert tuple(one(tables.read_image_metadata(spark, str(tmp_path / "im.csv")))) == ("x", 1, 2, "a/b.jpg")
    (tmp_path / "l.json").write_text('{"item_id":"i","item_name":[{"language_tag":"de_DE","value":"Stuhl"},{"language_tag":"en_US","value":"Chair"}],"main_image_id":"x"}\n')
    listing = tables.read_listings(spark, str(tmp_path / "l.json"))
    assert one(listing.select(catalogue.preferred(F.col("item_name")).alias("t"))).t == "Chair"
    for bad in (lambda: tables.manifest(spark, {"num_products": "1"}, str(tmp_path / "m")), lambda: tables.aligned(df, df.where("doc_id = 1")), lambda: catalogue.build_corpus(df)):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError("must be refused")
    tables.manifest(spark, dict.fromkeys(tables.MANIFEST_FIELDS, "x"), str(tmp_path / "m"))
    encode = lambda q: q.select("query_id", F.lit(0).alias("n"))
    q = spark.createDataFrame([("a",)], "query_id string")
    assert tables.cached(q, str(tmp_path / "c"), encode, F.col("n") > 0).count() == 0
    tables.write_markdown(df.select("doc_id"), "t", str(tmp_path / "r"))
    assert "| 1 |" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "r")).collect())
    docs = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    assert {r.word: r.n for _ in (1, 2) for r in tables.vocabulary_cache(docs, str(tmp_path / "v")).collect()} == {"a": 2, "b": 1}
    r = one(spark.sql("select double('nan') a, cast(null as double) b, 1.0d c").select(*(T.present(F.col(c), 0.0).alias(c) for c in "abc")))
    assert tuple(r) == (0.0, 0.0, 1.0)


def test_toy_metrics_of_lists(spark):
    rows = spark.createDataFrame([(1, ["a", "c", "x"], ["a", "b", "c"]), (2, ["q"], []), (3, [], ["z"])], "query_id int, actual array<string>, predicted array<string>")
    m = one(evalir.calculate(rows))
    assert m.queries == 3 and math.isclose(m.precision, 2 / 9, abs_tol=1e-6) and math.isclose(m.map, 5 / 27, abs_tol=1e-6) and math.isclose(m.mrr, 1 / 3, abs_tol=1e-6)
    try:
        evalir.calculate(rows.withColumn("predicted", F.when(F.col("query_id") > 1, F.col("predicted"))))
    except ValueError:
        return
    raise AssertionError("a missing list must be refused")


def test_words_are_marked_literally(spark):
    df = spark.sql("select 'c++ and C++ x' t, 'a ***b*** c' s")
    assert one(df.select(T.highlighted(F.col("t"), "c.+").alias("x"))).x == "c++ and C++ x"
    assert one(df.select(T.marked(F.col("s")).alias("x"))).x == "a <mark>b</mark> c"


def test_candidates_beat_other_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f"), (3, "q r s"), (4, "x y z"), (5, "k l m"), (6, "o p"), (7, "g h i"), (8, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    assert tuple(one(dedup.quality_test(pairs, dedup.shingle_rows(docs)))) == (2, 0.5)


def test_hooks_for_models(spark):
    rows = spark.createDataFrame([(1, [[1.0, -2.0, 0.5], [0.0, 3.0, 9.0]], [1, 0])], "query_id long, logits array<array<double>>, mask array<int>")
    assert {(r.term, round(r.qw, 6)) for r in fusion.splade(rows).collect()} == {("0", round(math.log(2), 6)), ("2", round(math.log(1.5), 6))}
    pairs = spark.createDataFrame([(1, 2)], "query_id long, doc_id long")
    scored = fusion.score_with(pairs, lambda frames: (f.assign(ce=0.5) for f in frames), "query_id long, doc_id long, ce double")
    assert tuple(one(scored)) == (1, 2, 0.5)
    points = spark.createDataFrame([(k, i, [float(i % 2 * 10 + k), float(i)], i % 2) for k in (0, 1) for i in range(6)], "layer int, doc_id long, v array<double>, label int")
    got = {r.layer: r.silhouette for r in ml.layer_silhouettes(points).collect()}
    assert set(got) == {0, 1} and got[0] == got[1] > 0.5


def test_vector_index(spark):
    import numpy as np
    from lexloom.operators import ann, blocks
    from lexloom.operators.index import top

    r = np.random.default_rng(2)
    x = np.concatenate((r.normal(size=(300, 9)), r.normal(size=(300, 9)) * 0.1 + 3))
    x[7] = x[8] = x[350]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None] * 9)], "doc_id long, v array<double>").repartition(3)
    q = rows.where("doc_id % 20 = 0 or doc_id >= 900").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    want = sorted(map(tuple, top(blocks.best(q, rows, 5, cosine=False), 5).collect()))
    ix = ann.build(rows, 8, 4)
    assert ix.rows() == 600 and sorted(map(tuple, ann.exact_search(ix, q, 5).collect())) == want
    few = ann.build(rows, 8, 4, sample=50)  # a model of few rows changes the work, not the rows
    assert few.rows() == 600 and sorted(map(tuple, ann.exact_search(few, q, 5).collect())) == want
    assert sorted(map(tuple, ann.search(ix, q, 5, 8, 600).collect())) == want
    codes = ann.encode(ix.model, x)
    made = ix.model.centroids[codes[0]] + np.concatenate([ix.model.books[s][codes[1][:, s]] for s in range(4)], 1)[:, :9]
    assert np.allclose(np.sqrt(((x - made) ** 2).sum(1)), codes[2])  # the bound of the exact search
    assert np.allclose(np.sqrt(((x - ix.model.centroids[codes[0]]) ** 2).sum(1)), codes[3])
    got = ann.report(ix, q, 5, 6, 60).first()
    assert got.recall >= 0.9 and got.vectors_read <= 0.1 and got.codes_read <= 1
    none = ann.build(rows.limit(0), 8, 4)
    assert none.rows() == 0 and ann.exact_search(none, q, 5).count() == ann.search(none, q, 5, 2, 9).count() == 0


def test_vector_index_cuts(spark, monkeypatch):
    import numpy as np
    from lexloom.operators import ann

    r = np.random.default_rng(4)
    x = r.normal(size=(200, 6))
    x[20:60] = x[19]  # ties at the cut
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, v array<double>").repartition(2)
    q = rows.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    ix = ann.build(rows, 4, 3)
    cut = sorted(map(tuple, ann.cuts(ix, q, 3, 30).collect()))  # one row a query, whatever is reranked
    assert len(cut) == 10 and all(c[4] == 30 for c in cut)
    found = sorted(map(tuple, ann.search(ix, q, 5, 3, 30).collect()))
    monkeypatch.setattr(ann, "PART_ROWS", 70)
    assert sorted(map(tuple, ann.cuts(ix, q, 3, 30).collect())) == cut and sorted(map(tuple, ann.search(ix, q, 5, 3, 30).collect())) == found


def test_vector_index_recall_on_the_tables(spark):
    from lexloom.plans.registry import QUERIES

    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        got = QUERIES["ann_report"](spark, d).first()
        assert got.recall >= 0.9 and got.vectors_read <= 0.1 and got.codes_read <= 0.8


@pytest.mark.parametrize("eps", [0.2, 0.5, 1.5])
def test_dbscan_by_pivots(spark, eps):
    import numpy as np
    from lexloom.operators import density
    from lexloom.session import work_dir

    work_dir(spark)
    r = np.random.default_rng(0)
    x = np.concatenate((r.normal(size=(60, 2)) * 0.3, r.normal(size=(60, 2)) * 0.3 + 4, r.uniform(-3, 8, size=(60, 2)), np.zeros((20, 2)), np.cumsum(np.full((40, 2), 0.3), 0) + 10))
    ids = r.permutation(len(x)).tolist()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = d.sum(1) >= 4
    label = {i: ids[i] for i in range(len(x)) if core[i]}
    changed = True
    while changed:
        changed = False
        for i in label:
            least = min(label[j] for j in np.flatnonzero(d[i] & core).tolist())
            changed, label[i] = changed or least < label[i], least
    want = {}
    for i in range(len(x)):
        near = [j for j in np.flatnonzero(d[i] & core).tolist()]
        want[ids[i]] = label[i] if core[i] else label[min(near, key=lambda j: ids[j])] if near else -1
    points = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(999, None)], "doc_id long, v array<double>").repartition(3)
    for pivots, hand in ((7, 20), (1, 1000)):
        assert dict(map(tuple, density.dbscan(points, eps, 4, pivots=pivots, hand_rows=hand).collect())) == want | {999: -1}
    assert density.dbscan(points.limit(0), eps).count() == 0


def test_components(spark):
    from lexloom.operators.graph import components
    from lexloom.session import work_dir

    work_dir(spark)
    edges = [(i, i + 1) for i in range(40, 80)] + [(90, k) for k in range(91, 120)] + [(5, 5), (7, 200), (200, 7), (3, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 40 for i in range(40, 81)} | {i: 90 for i in range(90, 120)} | {5: 5, 7: 3, 200: 3, 3: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_block_max_search(spark, tmp_path):
    import random

    from lexloom.operators import blockmax
    from lexloom.session import work_dir

    work_dir(spark)
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=r.randint(1, 80))) for _ in range(400)] + [None, "", "w1 w1", "w1 w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = [(i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(30)] + [(30, "unknown"), (31, ""), (32, "w59"), (33, "w1 w1 w1")]
    q = rank.query_terms(spark.createDataFrame(asked, "id long, text string"), "id", "text")
    p = index.postings(docs).drop("field")
    dl = docs.select("doc_id", F.size(T.tokens(F.col("text"))).alias("dl"))
    n = dl.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl"))
    want = sorted(map(tuple, index.top(rank.bm25(p, q, dl, n), 10).collect()))
    for shard, width, prime, block in ((1000, 8, 4, 100), (90, 4, 2, 7)):
        ix = blockmax.build(docs, shard, width)
        assert sorted(map(tuple, blockmax.search(ix, q, 10, width, prime, block).collect())) == want
        if shard == 90:
            ix.write(str(tmp_path / "ix"))
            assert sorted(map(tuple, blockmax.search(blockmax.read(spark, str(tmp_path / "ix")), q, 10, width, prime, block).collect())) == want
        got = blockmax.report(ix, q, 10, width, prime, block).first()
        assert got.postings == p.join(q, "term").count() and 0 < got.share_read
    alike = spark.createDataFrame([(i, "w1 w2") for i in range(40)], "doc_id long, text string")
    assert [r.doc_id for r in blockmax.search(blockmax.build(alike.unionByName(spark.createDataFrame([(99, "w3")], "doc_id long, text string"))), q.where("query_id = 33"), 10).orderBy("rank").collect()] == list(range(10))


def test_tiers_that_no_query_needs_are_not_read(spark):
    from lexloom.session import work_dir

    work_dir(spark)
    p = spark.createDataFrame([(t, d, 11 if t == "a" and d < 12 else 6 if d < 20 else 1) for t in "ab" for d in range(30)], "term string, doc_id long, tf long").withColumn("field", F.lit("description"))
    q = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "x", 1)], "query_id long, term string, qtf long")
    tiers = index.tiered(p).drop("field")
    assert sorted(map(tuple, rank.tier_reads(tiers, q.where("query_id < 2")).collect())) == [(1, 1, 12)]
    assert sorted(map(tuple, rank.tier_reads(tiers, q.where("query_id < 3")).collect())) == [(1, 2, 12), (2, 1, 20)]
    assert sorted(map(tuple, rank.tier_reads(tiers, q).collect())) == [(1, 3, 12), (2, 2, 20), (3, 1, 0)]


def test_linkage_without_the_driver(spark):
    import numpy as np
    from lexloom.operators import linkage
    from lexloom.session import work_dir

    work_dir(spark)
    r = np.random.default_rng(1)
    x = np.concatenate((r.normal(size=(25, 3)), r.normal(size=(25, 3)) + 4))
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(r.permutation(50) * 3, x)] + [(999, None)], "doc_id long, v array<double>").repartition(3)
    good = points.where("doc_id < 999")
    tree, ave = linkage.spanning_tree(points).collect(), linkage.average_merges(points)
    assert len(tree) == 49 and ave.count() == 49
    for k in (2, 9):
        assert sorted(map(tuple, linkage.single(points, k).collect())) == sorted(map(tuple, ml.hac(good, k, "single").collect()))
    assert sorted(map(tuple, linkage.average(points, 6).collect())) == sorted(map(tuple, ml.hac(good, 6, "average").collect()))
    alike = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "doc_id long, v array<double>")  # ties close no cycle
    assert len(linkage.spanning_tree(alike).collect()) == 5 and {c for _, c in linkage.average(alike, 1).collect()} == {0}
    assert linkage.single(points.limit(0), 3).count() == 0 and linkage.average(points.limit(0), 3).count() == 0


def test_average_linkage_in_bands(spark, monkeypatch):
    import numpy as np
    from lexloom.operators import linkage
    from lexloom.session import work_dir

    work_dir(spark)
    r = np.random.default_rng(3)
    x = np.concatenate((r.normal(size=(20, 3)), r.normal(size=(20, 3)) + 2))
    x[5:9] = x[30]
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(r.permutation(40) * 3 - 30, x)], "doc_id long, v array<double>").repartition(3)
    whole = sorted(map(tuple, linkage.average_merges(points).collect()))
    monkeypatch.setattr(linkage, "FEW_CLUSTERS", 20)
    monkeypatch.setattr(linkage, "BAND_BYTES", 900)
    assert sorted(map(tuple, linkage.average_merges(points).collect())) == whole and len(whole) == 39
    assert sorted(map(tuple, linkage.average(points, 5).collect())) == sorted(map(tuple, ml.hac(points, 5, "average").collect()))
    tables = []
    monkeypatch.setattr(linkage, "stored", lambda df, store=linkage.stored: tables.append(1) or store(df))
    copies = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(99, [0.0, 1.0])], "doc_id long, v array<double>")
    got = sorted(map(tuple, linkage.average_merges(copies).collect()))  # copies take no round each
    assert len(tables) < 12 and got[:2] == [(0, 1, 0.0, 2), (0, 2, 0.0, 3)] and len(got) == 30 and [h for *_, h, n in got if n == 31] == [pytest.approx(2**0.5)]


def test_sweep_is_plain_k_means(spark):
    import numpy as np
    from lexloom.operators import sweep
    from lexloom.session import work_dir

    work_dir(spark)
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(40, 4)) + 6 * r.normal(size=4) for _ in range(4)])
    points = spark.createDataFrame([(i, v.tolist(), i // 40) for i, v in enumerate(x)] + [(999, None, 1)], "doc_id long, v array<double>, label int").repartition(4)
    sets = [(3, 1, False), (4, 2, False), (4, 2, True), (200, 3, False)]
    begin = sweep.starts(points.where("v is not null"), sets)
    assert [len(c.v) for c in begin] == [3, 4, 4, 160]
    done = sweep.starts(points.where("v is not null"), sets)
    sweep.step(points.where("v is not null"), done)
    for a, b in zip(begin, done, strict=True):
        y = x / np.linalg.norm(x, axis=1)[:, None] if a.spherical else x
        own = [min(range(len(a.v)), key=lambda j, p=p: (((p - a.v[j]) ** 2).sum(), j)) for p in y]
        mean = [y[[i for i in range(160) if own[i] == j]].mean(0) if j in own else a.v[j] for j in range(len(a.v))]
        assert np.allclose([m / np.linalg.norm(m) for m in mean] if a.spherical else mean, b.v)
    rows = {(t.k, t.seed, t.spherical): t for t in sweep.table(points, sets).collect()}
    fitted = sweep.fit(points, sets)
    for c in fitted:
        own, gap = sweep.nearest(x, c)
        t = rows[c.k, c.seed, c.spherical]
        assert t.inertia == pytest.approx(gap.sum(), abs=1e-3) and t.clusters == len(set(own.tolist()))
        plain = ml.cluster_measures(spark.createDataFrame([(int(o), i // 40) for i, o in enumerate(own)], "cluster int, label int")).first()
        assert (t.purity, t.nmi, t.rand) == pytest.approx((plain.purity, plain.nmi, plain.rand), abs=2e-6)


def test_exact_splits(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3) for i in range(1003)], "doc_id long, label int")
    for share in (0.8, 1 / 3, 0.0, 1.0):
        train, held = ml.split_exact(rows.repartition(5), "doc_id", share)
        assert train.count() == int(share * 1003) and train.unionByName(held).distinct().count() == 1003
        assert sorted(map(tuple, train.collect())) == sorted(map(tuple, ml.split_exact(rows.repartition(2), "doc_id", share)[0].collect()))
    train, held = ml.split_exact(rows, "doc_id", 0.8, by="label")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    assert {r.label: r["count"] for r in train.groupBy("label").count().collect()} == {k: int(0.8 * n) for k, n in sizes.items()}
    assert train.unionByName(held).distinct().count() == 1003


def test_lemmas(spark):
    from lexloom.operators import lemma
    from lexloom.session import work_dir

    work_dir(spark)
    words = "cats cat boxes box buses bus women woman cities city running run runn making make baked bake larger large mice better glass is as yes tests".split()
    got = dict(map(tuple, lemma.lemmas(spark.createDataFrame([(w,) for w in words] + [(None,), ("cats",)], "word string")).collect()))
    assert got == {w: w for w in words} | {"cats": "cat", "boxes": "box", "buses": "bus", "women": "woman", "cities": "city", "running": "runn", "making": "make", "baked": "bake", "larger": "large", "mice": "mouse", "better": "good"}
    assert dict(map(tuple, lemma.lemmas(spark.createDataFrame([("larger",), ("cats",), ("mice",)], "word string"), spark.createDataFrame([("cat",), ("large",)], "word string"), ("noun",)).collect())) == {"larger": "larger", "cats": "cat", "mice": "mouse"}
    docs = spark.createDataFrame([(1, "the mouse and the cat"), (2, "mice mice"), (3, "cats"), (4, "dogs")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "mice"), (2, "cats cat"), (3, "dog")], "query_id long, text string")
    where = search.Collection(docs, {"description": F.col("text")}, lemmas=True)
    hits = search.search(where, asked, "nnn.nnn", {"description": 1.0}).collect()
    assert sorted((h.query_id, h.doc_id, h.score) for h in hits) == [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 2.0), (2, 3, 2.0)]  # "dogs" has no base in the documents


def test_segments_equal_a_rebuild(spark, tmp_path):
    import random

    from lexloom.streaming import segments

    r, path, state = random.Random(3), str(tmp_path / "ix"), {}
    schema = "doc_id long, text string, deleted boolean"
    text = lambda: " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 9)))
    written = []
    for n in range(9):
        ids = r.sample(range(30), 6)
        rows = [(i, text(), r.random() < 0.3) for i in ids] + [(None, "x y", False)] + ([(ids[0], "zzz", False)] if n == 2 else [])
        for i, t, gone in sorted(rows[:6] + rows[7:], key=lambda x: (x[2], x[1])):
            state[i] = None if gone else t
        batch = spark.createDataFrame(rows, schema)
        segments.ingest(batch, path, n, fan=3)
        if n in (4, 8):
            segments.ingest(batch, path, n, fan=3)  # replayed
        docs = spark.createDataFrame([(i, t) for i, t in state.items() if t is not None], "doc_id long, text string")
        assert sorted(map(tuple, segments.index(spark, path, n + 1).collect())) == sorted(map(tuple, index.postings(docs).select("term", "doc_id", "tf").collect()))
        written.append(segments.segments(spark, path, n + 1))
    assert [sorted(level for _, level in s) for s in written] == [[0], [0, 0], [1], [0, 1], [0, 0, 1], [1, 1], [0, 1, 1], [0, 0, 1, 1], [2]]
    before = sorted(map(tuple, segments.index(spark, path, 9).collect()))
    assert len(segments.vacuum(spark, path, 9)) == 12 - 0 and sorted(map(tuple, segments.index(spark, path, 9).collect())) == before
    assert segments.index(spark, path, 0).count() == 0


def test_segments_count_words_by_document(spark):
    from lexloom.operators import index
    from lexloom.streaming import segments

    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "The the c"), (5, "x " * 50)], "doc_id long, text string")
    got = segments.counted(docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, index.postings(docs).select("term", "doc_id", "tf").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan  # a task holds the words of a document, not those of all it reads



def test_segments_of_a_stream(spark, tmp_path):
    from lexloom.streaming import segments

    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    for part in (docs, spark.createDataFrame([(2, "d"), (3, "a a")], "doc_id long, text string")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        segments.maintain(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(map(tuple, segments.index(spark, str(tmp_path / "ix"), 2).collect()))
    assert got == [("a", 1, 1), ("a", 3, 2), ("b", 1, 1), ("d", 2, 1)]


def topics(r, texts):
    words = [[f"{t}{c}{d}" for c in "abcd" for d in "xyz"] for t in ("red", "blue", "sun", "rock")]
    return [(i, " ".join(r.choice(words[i % 4]) for _ in range(30))) for i in range(texts)], words


def test_trained_vectors(spark):
    import random

    import numpy as np
    from lexloom.operators import embeddings as e
    from lexloom.session import work_dir

    work_dir(spark)
    rng = np.random.default_rng(0)
    m = e.Model(["cat", "cats", "dog"], 7, rng.normal(size=(10, 4)), rng.normal(size=(3, 4)))
    c, o, neg = np.array([0, 1, 0, 2]), np.array([1, 2, 2, 0]), rng.integers(0, 3, (4, 2))
    loss, (units, du), (outs, dv) = e.gradients(m, c, o, neg)
    plain = 0.0
    for i in range(4):
        x = np.mean([m.vin[u] for u in e.units_of(m.words[c[i]], int(c[i]), 3, 7)], axis=0)
        plain += np.log1p(np.exp(-x @ m.vout[o[i]])) + sum(np.log1p(np.exp(x @ m.vout[j])) for j in neg[i])
    assert loss == pytest.approx(plain / 4)
    for rows, grads, matrix in ((units, du, m.vin), (outs, dv, m.vout)):
        for row, g in zip(rows.tolist(), grads, strict=True):
            for k in range(4):
                kept, ends = matrix[row, k], []
                for step in (1e-6, -1e-6):
                    matrix[row, k] = kept + step
                    ends.append(e.gradients(m, c, o, neg)[0])
                matrix[row, k] = kept
                assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(g[k], abs=1e-6)
    a, b = e.pairs(np.array([5, 6, 7, 8]), np.array([0, 3, 3, 4]), 2)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(5, 6), (5, 7), (6, 5), (6, 7), (7, 5), (7, 6)]
    rows, words = topics(random.Random(1), 120)
    docs = spark.createDataFrame(rows + [(500, None), (501, "alone")], "doc_id long, text string")
    one, two = (e.fit(docs.repartition(n), dim=12, rounds=8, shard_words=1500) for n in (2, 7))
    assert (one.vin == two.vin).all() and (one.vout == two.vout).all() and len(one.words) == 48
    unit = one.vin / np.linalg.norm(one.vin, axis=1)[:, None]
    near = np.argsort(-(unit @ unit.T), axis=1)[:, 1:6]
    of = [next(t for t, ws in enumerate(words) if w in ws) for w in one.words]
    assert np.mean([of[j] == of[i] for i in range(48) for j in near[i]]) > 0.8  # 0.23 by chance
    grams = e.fit(docs, dim=12, rounds=8, shard_words=1500, buckets=500)
    unseen = {r.word: np.array(r.vector) for r in e.vectors(spark.createDataFrame([("redax1",), ("sunby",), (None,)], "word string"), grams).collect()}
    number = {w: i for i, w in enumerate(grams.words)}
    full = np.stack([grams.vector(w, number) for w in grams.words])
    full /= np.linalg.norm(full, axis=1)[:, None]
    assert set(unseen) == {"redax1", "sunby"} and all(of_word == grams.words[int(np.argmax(full @ v))][:3] for of_word, v in ((w[:3], v) for w, v in unseen.items()))
    assert e.vectors(spark.createDataFrame([("redax1",), ("redax",)], "word string"), one).count() == 1
    assert e.fit(docs.limit(0)).words == []


def test_sparse_hits_are_cut_where_they_arise(spark):
    import numpy as np

    from lexloom.operators import blocks

    r = np.random.default_rng(5)
    w = {i: {f"t{t}": round(float(x), 6) for t, x in zip(r.choice(40, 12, replace=False), r.random(12), strict=True)} for i in range(300)}
    v = spark.createDataFrame([(i, t, x) for i, ws in w.items() for t, x in ws.items()], "doc_id long, term string, w double")
    q = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "term", F.col("w").alias("qw"))
    want = []
    for i in range(0, 300, 20):
        s = [(-round(sum(x * w[j].get(t, 0) for t, x in w[i].items()), 4), j) for j in w if j != i and set(w[i]) & set(w[j])]
        want += [(i, j, -x, n + 1) for n, (x, j) in enumerate(sorted(s)[:7])]
    got = sorted(((x.query_id, x.doc_id, x.score, x.rank) for x in fusion.sparse_search(q, v, 7).collect()), key=lambda x: (x[0], x[3]))
    assert got == want
    assert blocks.sparse_best(q, v, 7).count() == 15 * 7  # not all pairs that share a term


def test_judgments_follow_from_counts(spark):
    from lexloom.plans.catalog import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    run, qrels = t.dense(10), t.qrels()
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(t.judged(run)) == rows(evalir.judged(run, qrels).select(*t.judged(run).columns))
    assert rows(t.grades()) == rows(evalir.grades(qrels))
    assert rows(t.metrics(run)) == rows(evalir.metrics(run, qrels))


def test_dbscan_of_many_neighbours_emits_no_pairs(spark):
    import numpy as np

    from lexloom.operators import blocks, density

    r = np.random.default_rng(3)
    x = np.concatenate((r.normal(size=(80, 2)), r.uniform(-6, 6, size=(60, 2)), np.full((30, 2), 2.5), np.arange(8.0).repeat(2).reshape(8, 2) * 0.5 + 9))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "doc_id long, v array<double>").repartition(3)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    for eps in (0.5, 0.5**0.5, 1.5):
        assert {r.doc_id: r.n for r in blocks.counts_within(df, eps).collect()} == {i: int(n) for i, n in enumerate((d2 <= eps * eps).sum(1))}
    assert np.allclose(blocks.gaps(x, x), np.sqrt(d2), atol=1e-9)
    assert sorted(map(tuple, ml.dbscan(df, 0.5**0.5).collect())) == sorted(map(tuple, density.dbscan(df, 0.5**0.5).collect()))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sets_and_signatures_are_not_broadcast(spark):
    from lexloom.session import stored

    docs = spark.createDataFrame([(i, f"some words that are in every text and one {i % 7} of seven") for i in range(40)], "doc_id long, text string")
    sig = stored(dedup.signatures(dedup.shingle_rows(docs)))  # a file, whose size the planner knows
    assert "BroadcastHashJoin" not in plan_of(dedup.estimated(dedup.candidates(dedup.bands(sig)), sig))
    assert "BroadcastHashJoin" not in plan_of(dedup.exact_pairs(dedup.shingle_rows(docs)))


def test_exact_pairs_expand_copies(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(i, long) for i in range(30)] + [(99, long + " more"), (50, "a b"), (51, "b a"), (52, "")], "doc_id long, text string")
    got = {(r.a, r.b): r.similarity for r in dedup.exact_pairs(dedup.shingle_rows(docs)).collect()}
    assert got == {(a, b): 1.0 for a in range(30) for b in range(a + 1, 30)} | {(a, 99): round(119 / 120, 6) for a in range(30)}


def test_quality_test_takes_no_sets_through_a_window(spark):
    docs = spark.createDataFrame([(i, f"a b c d {i // 2}") for i in range(20)], "doc_id long, text string")
    rows = dedup.shingle_rows(docs)
    out = dedup.quality_test(dedup.exact_pairs(rows, unrounded=True), rows)
    assert "Window" not in plan_of(out) and tuple(out.first()) == (10, 1.0)


def test_hits_of_queries_stay_with_their_documents(spark):
    docs = spark.createDataFrame([(i, f"the word {i % 5} of {i % 3}") for i in range(60)], "doc_id long, text string")
    q = rank.query_terms(spark.createDataFrame([(1, "the word 3"), (2, "of 1")], "query_id long, text string"), "query_id", "text")
    p = index.postings(docs, terms=q).drop("field")
    n = spark.createDataFrame([(60, 5.0)], "n long, avg_dl double")
    plan = plan_of(rank.vsm(p, q, n, "ltn.lnn"))
    assert "hashpartitioning(query_id" not in plan and "SortMergeJoin" not in plan


def test_missing_words_tokenises_the_named_documents_only(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(50)], "doc_id long, text string")
    out = snippet.missing_words(spark.createDataFrame([(1, 7)], "query_id long, doc_id long"), docs, spark.createDataFrame([(1, "c d a")], "query_id long, text string"))
    assert [tuple(r) for r in out.collect()] == [(1, 7, "d")] and "LeftSemi" in plan_of(out)


def test_tiers_add_up_over_tiers(spark):
    s = {1: [(1, 10, 2.0), (1, 11, 1.0), (2, 10, 5.0)], 2: [(1, 11, 4.0), (1, 12, 0.5), (2, 12, 9.0)], 3: [(1, 10, 7.0)]}
    read = []

    def score(tier, active):
        read.append((tier, sorted(r.query_id for r in active.collect())))
        return spark.createDataFrame(s[tier], "query_id long, doc_id long, s double").join(active.select("query_id").distinct(), "query_id", "left_semi")

    out = rank.by_tier(score, spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, term string"), 2)
    assert sorted(map(tuple, out.collect())) == [(1, 10, 2.0, 1), (1, 11, 1.0, 2), (2, 10, 5.0, 2), (2, 12, 9.0, 1)] and read == [(1, [1, 2]), (2, [2])]


def test_block_trees_hold_the_tree_whatever_the_ties(spark):
    import numpy as np
    from lexloom.operators import blocks, linkage

    v = np.array([[float(i % 4), float(i // 4)] for i in range(16)])  # a grid: all short edges are alike
    one = lambda at: blocks.Block(np.array(at), v[at], np.array(at))
    whole = sorted(zip(*linkage._tree(one(list(range(16))), one(list(range(16))))))
    parts = [[0, 5, 10, 15, 3], [1, 2, 4, 6, 7], [8, 9, 11, 12, 13, 14]]
    some = {e for p in parts for q in parts for e in zip(*linkage._tree(one(p), one(q)))}
    assert set(whole) <= some and len(whole) == 15 and all(d == 1.0 for _, _, d in whole)


def test_units_of_a_word_are_added_up_once_a_batch(monkeypatch):
    import numpy as np
    from lexloom.operators import embeddings

    r = np.random.default_rng(3)
    m = embeddings.Model(["alpha", "beta", "gamma"], 16, r.normal(size=(19, 4)), r.normal(size=(3, 4)))
    centre, context, negatives = np.array([0, 2, 0, 0, 1, 2]), np.array([1, 0, 2, 1, 0, 1]), r.integers(0, 3, (6, 2))
    taken, take = [], np.take
    monkeypatch.setattr(embeddings.np, "take", lambda x, i, **k: (taken.append((x is m.vin, len(i))), take(x, i, **k))[1])
    loss, (units, du), _ = embeddings.gradients(m, centre, context, negatives)
    assert [n for own, n in taken if own] == [len(m.units)]
    for row in (int(units[0]), int(units[-1])):  # against differences of the loss
        for sign in (1, -1):
            m.vin[row, 0] += sign * 1e-6
            up = embeddings.gradients(m, centre, context, negatives)[0]
            m.vin[row, 0] -= sign * 1e-6
            assert abs((up - loss) / (sign * 1e-6) - du[list(units).index(row), 0]) < 1e-4


def test_blocks_and_candidates_are_not_broadcast(spark):
    from lexloom.operators import blocks
    from lexloom.session import stored

    terms = stored(spark.createDataFrame([(i, f"t{(i + j) % 9}", 0.5) for i in range(60) for j in range(4)], "doc_id long, term string, w double"))  # files, whose size the planner knows
    q = terms.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "term", F.col("w").alias("qw"))
    v = stored(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "doc_id long, v array<double>"))
    pairs = stored(spark.createDataFrame([(0, i) for i in range(1, 30)], "query_id long, doc_id long"))
    for df in (blocks.sparse_best(q, terms, 7), blocks.best(v.where("doc_id = 20").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q")), v, 7, False), fusion.overlap_scores(pairs, terms.select("doc_id", "term"))):
        assert "BroadcastHashJoin" not in plan_of(df)
    assert "BroadcastHashJoin" not in plan_of(fusion.sparse_vectors(terms.select("doc_id", "term", F.lit(1).alias("tf")), spark.createDataFrame([(60,)], "n long")))


def test_points_meet_once_in_cells_of_groups(spark, monkeypatch):
    import numpy as np

    from lexloom.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_BYTES", 16 * 9)  # nine points of two dimensions a block
    r = np.random.default_rng(8)
    x = np.concatenate((r.integers(-3, 4, (150, 2)).astype(float), r.normal(size=(60, 2)) * 1e-3, [[1e20, 0.0], [1e20, 1.0]]))
    label = r.integers(0, 3, len(x))
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "doc_id long, v array<double>, label int").repartition(3)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    for eps in (1.0, 2**0.5, 1e-3):
        assert sorted((r.a, r.b) for r in blocks.within(df, eps).collect()) == sorted(zip(*(c.tolist() for c in np.nonzero(d2 <= eps * eps)), strict=True))
        assert {r.doc_id: r.n for r in blocks.counts_within(df, eps).collect()} == {i: int(n) for i, n in enumerate((d2 <= eps * eps).sum(1))}
    small = df.where("doc_id < 210")
    got = {(r.x, r.label): (r.d, r.n) for r in blocks.distance_sums(small).groupBy("x", "label").agg(F.sum("total").alias("d"), F.sum("n").alias("n")).collect()}
    for i in range(210):
        for k in range(3):
            others = [j for j in range(210) if j != i and label[j] == k]
            assert got[i, k][1] == len(others) and got[i, k][0] == pytest.approx(np.sqrt(d2[i, others]).sum(), abs=1e-6)
    pairs = blocks.scan_once(small, lambda q, m, same: (q.ids[:1], m.ids[:1]), blocks._PAIRS, "a long, b long").collect()
    n = len({r.a for r in pairs} | {r.b for r in pairs})
    assert n > 20 and len(pairs) == n * (n + 1) // 2  # each pair of blocks once


def test_a_pivot_holds_its_own_blocks_only(spark, monkeypatch):
    from lexloom.operators import density

    plans, met = [], density.met
    monkeypatch.setattr(density, "met", lambda *a: (plans.append(out := met(*a)), out)[1])
    df = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(60)], "doc_id long, v array<double>")
    assert density.dbscan(df, 3.0, pivots=4).count() == 60
    for out in plans:
        join = out._jdf.queryExecution().sparkPlan().toString().split("Join", 1)[1]
        assert join.index("AS sent") < join.index("AS own") and "SortMergeJoin" in plan_of(out)
