"""Vectors, labels and clusters: neighbours, odd one out, pairs, silhouettes, cluster measures, models."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, StandardScaler, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.operators import blocks, density
from lexloom.operators.fusion import dot
from lexloom.operators.index import top


def cosine(a: str, b: str) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine of (query_id, q) against (doc_id, v), itself excluded."""
    return top(blocks.best(queries, vectors, k, cosine=True), k)


def odd_one_out(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """(g, odd) of groups (g, doc_id): the member with the lowest mean cosine to the others; members without a vector are left out
    (see `odd_answers` for questions that must not lack any)."""
    rows = groups.join(vectors, "doc_id")
    a, b = rows.select("g", F.col("doc_id").alias("x"), F.col("v").alias("vx")), rows.select("g", F.col("doc_id").alias("y"), F.col("v").alias("vy"))
    mean = a.join(b, "g").where("x <> y").groupBy("g", "x").agg(F.round(F.avg(cosine("vx", "vy")), 5).alias("m"))
    return mean.groupBy("g").agg(F.min_by("x", F.struct("m", "x")).alias("odd"))


def odd_answers(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(g, odd, error) of (g, words array) over (word, v): a question with an unknown word has no answer but names the words."""
    rows = questions.select("g", F.explode("words").alias("word")).join(vectors.select("word", "v"), "word", "left")
    lacking = rows.where("v is null").groupBy("g").agg(F.array_join(F.array_sort(F.collect_set("word")), ", ").alias("error"))
    known = rows.join(lacking, "g", "left_anti")
    odd = odd_one_out(known.select("g", F.col("word").alias("doc_id")), known.select(F.col("word").alias("doc_id"), "v").dropDuplicates(["doc_id"]))
    return questions.select("g").join(odd, "g", "left").join(lacking, "g", "left").select("g", "odd", "error")


def odd_accuracy(answers: DataFrame, key: DataFrame) -> DataFrame:
    """Right answers, questions without unknown words, and their ratio, of (g, odd, error) and (g, right)."""
    x = answers.where("error is null").join(key, "g")
    return x.agg(F.coalesce(F.sum(F.when(F.col("odd") == F.col("right"), 1).otherwise(0)), F.lit(0)).alias("correct"), F.count(F.lit(1)).alias("total")).withColumn("accuracy", F.when(F.col("total") > 0, F.round(F.col("correct") / F.col("total"), 6)).otherwise(0.0))


def skipgram_pairs(words: DataFrame, window: int = 2) -> DataFrame:
    """(center, context, n) of (doc_id, w array), windows cut at the ends; texts of one word give none."""
    size = F.size("w")
    shifts = [F.zip_with(F.slice("w", 1, F.greatest(size - d, F.lit(0))), F.slice("w", d + 1, F.greatest(size - d, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))) for d in range(1, window + 1)]
    one = words.select(F.explode(F.concat(*shifts)).alias("p")).select("p.a", "p.b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = one.select(F.col("a").alias("center"), F.col("b").alias("context"), "n").unionByName(one.select(F.col("b").alias("center"), F.col("a").alias("context"), "n"))
    return both.groupBy("center", "context").agg(F.sum("n").alias("n"))


def label_encode(rows: DataFrame, c: str) -> DataFrame:
    """(label, code): codes from 0 in sorted order. Labels are classes: one aggregate holds the distinct ones."""
    return rows.agg(F.array_sort(F.collect_set(c)).alias("all")).select(F.posexplode("all").alias("code", "label")).select("label", "code")


def label_decode(rows: DataFrame, codes: DataFrame, c: str = "code") -> DataFrame:
    """The rows with the label of their code; unknown codes have none."""
    return rows.join(codes.select(F.col("code").alias(c), "label"), c, "left")


def of_top_classes(rows: DataFrame, c: str, k: int = 10) -> DataFrame:
    """The rows of the k most frequent classes."""
    return rows.join(top_classes(rows, c, k).select(F.col("label").alias(c)), c, "left_semi").select(*rows.columns)


def split(rows: DataFrame, key: str, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, held out): rows of a hash of the key and the seed under `share` go to training, whatever the partitions."""
    x = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < round(share * 10_000)
    return rows.where(x), rows.where(~x)


BUCKETS = 1 << 16


def split_exact(rows: DataFrame, key: str, share: float, seed: int = 42, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, held out) with exactly int(share * n) rows in training, of each class of `by` if it is given.

    Rows go in the order of a hash of seed and key, then the key (unique). Counts of BUCKETS ranges of the hash find the range that
    holds the last training row; only the rows of that range are ordered. A null class is a class of its own.
    """
    own = rows.columns
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    x = rows.withColumns({"_class": (F.col(by) if by else F.lit(0)).cast("string"), "_h": h}).withColumn("_b", (F.col("_h") * BUCKETS / F.lit(1 << 32)).cast("int"))
    counts = x.groupBy("_class", "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_class")
    counts = counts.withColumns({"_want": F.floor(F.lit(share) * F.sum("_n").over(w)), "_sofar": F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))})
    cut = counts.select(F.col("_class").alias("_c"), F.col("_b").alias("_at"), (F.col("_want") - (F.col("_sofar") - F.col("_n"))).alias("_left"), "_n")
    marked = x.join(cut, F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_at")), "left")
    edge = marked.where("_left > 0 and _left < _n").withColumn("_i", F.row_number().over(Window.partitionBy("_class", "_b").orderBy("_h", key)))
    train = marked.where("_left >= _n").select(*own).unionByName(edge.where("_i <= _left").select(*own))
    return train, marked.where("_left <= 0").select(*own).unionByName(edge.where("_i > _left").select(*own))


def pooled(rows: DataFrame, layers: str = "layers", mask: str = "mask") -> DataFrame:
    """(doc_id, layer, cls, mean): a text's first token vector and the mean over unmasked tokens, for each layer of
    token vectors (array of layers of tokens of numbers)."""
    x = rows.select("doc_id", mask, F.posexplode(layers).alias("layer", "t"))
    kept = F.filter(F.zip_with("t", mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda p: p["m"] > 0)
    total = F.aggregate(kept, F.transform(F.col("t")[0], lambda _: F.lit(0.0)), lambda s, p: F.zip_with(s, p["v"], lambda a, b: a + b.cast("double")))
    return x.select("doc_id", "layer", F.transform(F.col("t")[0], lambda v: v.cast("double")).alias("cls"), F.transform(total, lambda v: v / F.greatest(F.size(kept), F.lit(1))).alias("mean"))


def top_classes(rows: DataFrame, c: str, k: int = 10) -> DataFrame:
    return rows.groupBy(F.col(c).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(k)


def silhouette(points: DataFrame) -> DataFrame:
    """Mean Euclidean silhouette of (doc_id, v, label), exact over all pairs in blocks; single-member clusters count 0.
    Only sums by point and label leave the blocks. With fewer than two labels there is none (null)."""
    labels = points.select("doc_id", F.col("label").cast("long").alias("own"))
    d = blocks.distance_sums(points).groupBy("x", "label").agg((F.sum("total") / F.sum("n")).alias("d"), F.sum("n").alias("n")).where("n > 0")
    s = d.join(labels.withColumnRenamed("doc_id", "x"), "x").groupBy("x").agg(F.max(F.when(F.col("label") == F.col("own"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("own"), F.col("d"))).alias("b"))
    return s.agg(F.round(F.avg(F.when(F.col("b").isNull(), None).when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))), 5).alias("silhouette"))


def layer_silhouettes(points: DataFrame) -> DataFrame:
    """(layer, silhouette) of (layer, doc_id, v, label), one scan for each layer; null where a layer has one label only."""
    out = None
    for r in points.select("layer").distinct().orderBy("layer").collect():  # a model has a few dozen layers
        s = silhouette(points.where(F.col("layer") == r.layer)).select(F.lit(r.layer).alias("layer"), "silhouette")
        out = s if out is None else out.unionByName(s)
    return points.sparkSession.createDataFrame([], "layer int, silhouette double") if out is None else out


def noise_ratio(clusters: DataFrame) -> DataFrame:
    """Share of points in no cluster (-1), and the number of clusters, of (doc_id, cluster)."""
    return clusters.agg(F.round(F.avg(F.when(F.col("cluster") == -1, 1.0).otherwise(0.0)), 6).alias("noise_ratio"), F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("clusters"))


def inertia(points: DataFrame) -> DataFrame:
    """Sum of squared distances to the mean of the own cluster, from one pass of sums: for each cluster and coordinate
    the sum of squares less the squared sum by the count. Of (doc_id, v, cluster)."""
    x = points.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"))
    return x.agg(F.round(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")), 4).alias("inertia"))


def cluster_terms(members: DataFrame, words: DataFrame, labels: DataFrame, terms: int = 12, genres: int = 5, titles: int = 3) -> DataFrame:
    """By cluster of (doc_id, cluster): its size, top labels with counts, top terms by number of documents, and first members.

    words is (doc_id, term), labels (doc_id, label); ties go by name."""
    n = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    ranked = lambda rows, c, k: index_top(rows.groupBy("cluster", c).agg(F.count(F.lit(1)).alias("n")), c, k)
    t = ranked(members.join(words.distinct(), "doc_id"), "term", terms).groupBy("cluster").agg(_listed("term").alias("terms"))
    g = ranked(members.join(labels, "doc_id"), "label", genres).groupBy("cluster").agg(_listed("label").alias("labels"))
    first = members.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("doc_id"))).where(F.col("rank") <= titles).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("members"))
    return n.join(t, "cluster", "left").join(g, "cluster", "left").join(first, "cluster")


def index_top(rows: DataFrame, c: str, k: int) -> DataFrame:
    return top(rows, k, "cluster", "n", c)


def _listed(c: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(c).cast("string").alias("c"), F.col("n").cast("string").alias("n")))), lambda x: F.concat(x["c"], F.lit(":"), x["n"])), ",")


def cluster_measures(rows: DataFrame) -> DataFrame:
    """purity, NMI (arithmetic mean) and the Rand index over all ordered pairs, from the contingency of (cluster, label)."""
    t = rows.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    a = t.groupBy("cluster").agg(F.sum("n").alias("a"), F.max("n").alias("best"))
    b = t.groupBy("label").agg(F.sum("n").alias("b"))
    n = t.agg(F.sum("n").alias("t"))
    x = t.join(a, "cluster").join(b, "label").crossJoin(F.broadcast(n))
    mi = x.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"), F.sum(F.col("n") * F.col("n")).alias("s"))
    h = lambda d, c: d.crossJoin(F.broadcast(n)).agg((-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))).alias(f"h{c}"), F.sum(F.col(c) * F.col(c)).alias(f"s{c}"))
    pure = a.agg(F.sum("best").alias("pure"))
    every = mi.crossJoin(h(a, "a")).crossJoin(h(b, "b")).crossJoin(pure).crossJoin(n)
    nmi = F.when(F.col("ha") + F.col("hb") > 0, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).otherwise(1.0)
    return every.select(F.round(F.col("pure") / F.col("t"), 6).alias("purity"), F.round(nmi, 6).alias("nmi"), F.round((F.col("t") * F.col("t") - F.col("sa") - F.col("sb") + 2 * F.col("s")) / (F.col("t") * F.col("t")), 6).alias("rand"))


def knn(queries: DataFrame, train: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, predicted): majority of the k nearest by cosine; ties by label."""
    near = nearest(queries, train.select("doc_id", "v"), k).join(train.select("doc_id", "label"), "doc_id")
    votes = near.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("query_id").agg(F.min_by("label", F.struct((-F.col("n")).alias("m"), "label")).alias("predicted"))


def classification_report(rows: DataFrame) -> DataFrame:
    """Accuracy, macro and micro precision, recall and F1 of (label, predicted); micro ones pool all classes, so with one
    label a row they equal the accuracy."""
    t = rows.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    own = t.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    out = own.join(t.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said")), "label", "left")
    p, r = F.coalesce(F.col("tp") / F.col("said"), F.lit(0.0)), F.col("tp") / F.col("support")
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return out.agg(F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg(p), 6).alias("macro_precision"), F.round(F.avg(r), 6).alias("macro_recall"), F.round(F.avg(f), 6).alias("macro_f1"), F.round(F.sum("tp") / F.sum("support"), 6).alias("micro_f1"))


def oversample(rows: DataFrame, c: str, key: str) -> DataFrame:
    """Rows repeated in turn until every class has as many as the largest: (key, label, copy)."""
    n = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    most = n.agg(F.max("n").alias("m"))
    w = Window.partitionBy(c).orderBy(key)
    x = rows.join(n, c).crossJoin(F.broadcast(most)).withColumn("i", F.row_number().over(w) - 1)
    return x.select(key, F.col(c).alias("label"), F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1 - F.col("i")) / F.col("n")).cast("int"))).alias("copy"))


def vectors(rows: DataFrame, c: str = "v") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.transform(c, lambda x: x.cast("double"))))


def kmeans(points: DataFrame, k: int, seed: int = 42, spherical: bool = False) -> DataFrame:
    """(doc_id, cluster)"""
    x = vectors(points)
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine" if spherical else "euclidean").fit(x)
    return model.transform(x).select("doc_id", F.col("prediction").alias("cluster"))


def pca_2d(points: DataFrame) -> DataFrame:
    """(doc_id, x, y): centred points on their first two principal axes, each turned so that its largest weight is positive."""
    x = vectors(points)
    x = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False).fit(x).transform(x)
    model = PCA(k=2, inputCol="centred", outputCol="p").fit(x)
    axes = model.pc.toArray()
    sign = [1.0 if axes[abs(axes[:, i]).argmax(), i] > 0 else -1.0 for i in (0, 1)]
    y = model.transform(x).select("doc_id", vector_to_array("p").alias("p"))
    return y.select("doc_id", (F.col("p")[0] * sign[0]).alias("x"), (F.col("p")[1] * sign[1]).alias("y"))


def neighbours_within(points: DataFrame, eps: float) -> DataFrame:
    """(a, b) of points with Euclidean distance at most eps, itself included."""
    return blocks.within(points, eps)


def dbscan(points: DataFrame, eps: float, min_points: int = 5) -> DataFrame:
    """(doc_id, cluster): the smallest core point of the cluster, -1 for noise; a border point joins its smallest core's cluster.
    No table of pairs is made, and rounds grow with the logarithm of the points (see density)."""
    return density.dbscan_scanned(points, eps, min_points)


HAC_ROWS = 5000


def hac(points: DataFrame, k: int, linkage: str = "average", limit: int = HAC_ROWS) -> DataFrame:
    """(doc_id, cluster): agglomerative clustering of a bounded sample of (doc_id, v) by single, complete or average Euclidean linkage.

    The dendrogram is quadratic in its points, so at most `limit` are taken (the documented bound; more are refused, none
    dropped). Ties merge the clusters with the smallest members; a cluster is named by its smallest member."""
    rows = points.select("doc_id", "v").orderBy("doc_id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"agglomerative clustering takes at most {limit} points")
    ids = np.array([r.doc_id for r in rows], np.int64)
    if not len(ids):
        return points.select("doc_id", F.lit(0).cast("long").alias("cluster")).limit(0)
    x = np.array([r.v for r in rows], np.float64)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2)) if len(x) < 600 else np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    size, owner = np.ones(len(x)), np.arange(len(x))
    for _ in range(max(len(x) - k, 0)):
        i, j = divmod(int(d.argmin()), len(x))
        i, j = min(i, j), max(i, j)
        new = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])}[linkage]
        new[[i, j]] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        owner[owner == j] = i
    return points.sparkSession.createDataFrame([(int(a), int(ids[o])) for a, o in zip(ids, owner, strict=True)], "doc_id long, cluster long")


PART_WORDS = 2_000_000


def word2vec(words: DataFrame, size: int = 32, seed: int = 42, save_to: str | None = None) -> DataFrame:
    """(word, vector) of a skip-gram model over (doc_id, w array), which can be saved and loaded again. Each PART_WORDS words are a
    partition of their own, whose vectors Spark merges; all words are used."""
    parts = (words.agg(F.sum(F.size("w"))).first()[0] or 0) // PART_WORDS + 1
    model = Word2Vec(vectorSize=size, minCount=5, numPartitions=parts, seed=seed, inputCol="w", outputCol="o").fit(words)
    if save_to:
        model.write().overwrite().save(save_to)
    return word_vectors(model)


def word_vectors(model: Word2VecModel | str) -> DataFrame:
    """(word, vector) of a model or of the folder that it was saved in."""
    model = Word2VecModel.load(model) if isinstance(model, str) else model
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a text file with a word and its numbers in each line; a first line with two counts is skipped."""
    x = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("p")).where(F.size("p") > 2)
    return x.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda v: v.cast("double")).alias("vector"))


def subword_grams(word: Column, low: int = 3, high: int = 5) -> Column:
    """Character grams of <word>, of each length."""
    w = F.concat(F.lit("<"), word, F.lit(">"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: w.substr(i, F.lit(n)))
    return F.array_distinct(F.concat(*(of(n) for n in range(low, high + 1))))


def subword_vectors(words: DataFrame, unknown: DataFrame) -> DataFrame:
    """(word, vector) of words outside a vocabulary (word, vector): the mean over their character grams of the mean vector
    of the vocabulary's words with that gram; words without a known gram have none."""
    wanted = unknown.select(F.explode(subword_grams(F.col("word"))).alias("gram")).distinct()
    parts = words.select("vector", F.explode(subword_grams(F.col("word"))).alias("gram")).join(wanted, "gram", "left_semi").select("gram", F.posexplode("vector").alias("i", "x"))
    grams = parts.groupBy("gram", "i").agg(F.avg("x").alias("x"))
    mean = unknown.select("word", F.explode(subword_grams(F.col("word"))).alias("gram")).join(grams, "gram").groupBy("word", "i").agg(F.avg("x").alias("x"))
    return mean.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))


def classify(train: DataFrame, test: DataFrame, kind: str) -> DataFrame:
    """(doc_id, label, predicted) by logistic regression, Gaussian or multinomial naive Bayes or a perceptron, on (doc_id, v, label)
    or, where there is a column of ready `features`, on that."""
    n = train.agg(F.max("label")).first()[0] + 1
    ready = lambda rows: rows if "features" in rows.columns else vectors(rows)
    est = {"logreg": lambda: LogisticRegression(maxIter=30), "bayes": lambda: NaiveBayes(modelType="gaussian"), "multinomial": lambda: NaiveBayes(modelType="multinomial"), "mlp": lambda: MultilayerPerceptronClassifier(layers=[train.select(F.size("v")).first()[0], 32, n], seed=42, maxIter=50)}[kind]()
    return est.fit(ready(train)).transform(ready(test)).select("doc_id", "label", F.col("prediction").cast("int").alias("predicted"))


def tfidf(words: DataFrame, size: int = 1 << 12) -> DataFrame:
    """Adds features: hashed term counts of the array `w`, weighted by inverse document frequency over the rows."""
    counted = HashingTF(numFeatures=size, inputCol="w", outputCol="_tf").transform(words)
    return IDF(inputCol="_tf", outputCol="features").fit(counted).transform(counted).drop("_tf")
