"""Quality rules: rule statistics of each document and an isolation forest over them.

The rules reject a document outright (`base_failed`). For the others an isolation forest scores how few random
splits isolate the document's statistics from the rest; the score above which a document is rejected is calibrated
on labelled rows, so that at most `max_good_rejected` of the good ones would go. Every labelled row that the rules leave
takes part: each tree draws its SUBSAMPLE rows, as the method has it, by a hash over all of them, trees are grown in tasks of
their own, and the threshold is the exact order statistic of the scores of all good rows.

Defined results: a null or empty text has no words and fails the base rule; a null id is kept as it is; repeated
rows each get their row; with no labelled row the forest rejects nothing; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import SPACES, RunHash, Words, as_bytes, batch, chunks, covered, ship, stored

RANGES = 1 << 16
TREES, SUBSAMPLE, MAX_GOOD_REJECTED, SEED = 100, 256, 0.002, 7
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
USUAL_LENGTH = (2.0, 16.0)

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LEAD = (np.arange(256) & 0xC0) != 0x80
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FIELDS = [("doc_id", pa.int64()), *((n, pa.int64()) for n in STATS), ("base_failed", pa.bool_())]
_SQL = "doc_id long, " + ", ".join(f"{n} long" for n in STATS) + ", base_failed boolean"


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The rule statistics of each text, as int64 arrays."""
    w = Words(texts, SPACES, lower=False)
    n_words = np.diff(w.first)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[w.text_start[1:] - 1] - total[w.text_start[:-1]]

    chars = per_text(_LEAD[w.bytes] & ~SPACES[w.bytes])
    symbols = per_text(_SYMBOL[w.bytes])
    first, text = w.windows(WINDOW)
    repeat = np.zeros(len(texts), np.int64)
    if len(first):
        key = RunHash(w.hash, (WINDOW, WINDOW))(first, first + WINDOW)
        order = np.lexsort((key, text))
        same = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
        twice = np.zeros(len(first), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = first[twice]
        if len(hit):
            inside = np.concatenate(([0], np.cumsum(covered(len(w), hit, hit + WINDOW))))
            repeat = inside[w.first[1:]] - inside[w.first[:-1]]
    dup = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        lines = t.split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            full = [x for x in lines if x.split()]
            dup[i] = len(full) - len(set(full))
    return dict(zip(STATS, (n_words, chars, symbols, dup, repeat), strict=True))


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Symbols for each word, for each character and in all, and how far the mean word length is outside the usual.

    Repetition is left to the base rule, which has its own limit.
    """
    n, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    length = s["word_chars"] / n
    return np.column_stack((s["n_symbols"] / n, s["n_symbols"] / chars, np.log1p(s["n_symbols"]), np.maximum(length - USUAL_LENGTH[1], 0) + np.maximum(USUAL_LENGTH[0] - length, 0)))


def _depth_left(n: float) -> float:
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _tree(x: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """Random splits of the rows: (feature or -1, cut, left, right, depth) of each node."""
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + _depth_left(len(rows))])
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        wide = np.flatnonzero(high > low)
        if depth < limit and len(wide):
            f = int(rng.choice(wide))
            cut = rng.uniform(low[f], high[f])
            left = rows[:, f] < cut
            nodes[at][:2] = [f, cut]
            nodes[at][2], nodes[at][3] = grow(rows[left], depth + 1), grow(rows[~left], depth + 1)
        return at

    grow(x, 0)
    return np.array(nodes)


def fit_forest(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> dict:
    """Random axis-parallel splits of random subsamples; each tree is a flat array of nodes."""
    rng, forest = np.random.default_rng(seed), []
    size = min(subsample, len(x))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    for _ in range(trees):
        forest.append(_tree(x[rng.choice(len(x), size, replace=False)], limit, rng))
    return {"trees": forest, "limit": limit, "norm": _depth_left(size) or 1.0}


def anomaly(forest: dict, x: np.ndarray) -> np.ndarray:
    """2 ** -(mean path length / its expectation): near 1 for rows that few splits isolate."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for t in forest["trees"]:
        at = np.zeros(len(x), np.int64)
        for _ in range(forest["limit"]):
            f = t[at, 0].astype(np.int64)
            inner = f >= 0
            if not inner.any():
                break
            left = x[rows, np.maximum(f, 0)] < t[at, 1]
            at = np.where(inner, np.where(left, t[at, 2], t[at, 3]).astype(np.int64), at)
        total += t[at, 4]
    return np.exp2(-total / max(len(forest["trees"]), 1) / forest["norm"])


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_FIELDS)
    for ids, texts in chunks(batches):
        s = statistics(texts)
        yield batch(schema, ids, *(s[n] for n in STATS), base_failed(s))


def _hashes(ids: np.ndarray, tree: int) -> np.ndarray:
    h = ids.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _first(h: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.lexsort((*x.T, h))[:n]
    return h[at], x[at]


def _columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: b.column(n).to_numpy() for n in STATS}


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SUBSAMPLE rows of a task with the smallest hashes, for each tree."""
    held = [(np.zeros(0, np.uint64), np.zeros((0, 4)))] * TREES
    for b in batches:
        x, ids = features(_columns(b)), b.column("doc_id").to_numpy()
        for t, (h, old) in enumerate(held):
            new = _hashes(ids, t)
            some = new <= h[-1] if len(h) == SUBSAMPLE else slice(None)
            held[t] = _first(np.concatenate((h, new[some])), np.concatenate((old, x[some])), SUBSAMPLE)
    for t, (h, x) in enumerate(held):
        yield pa.RecordBatch.from_arrays([pa.array([t] * len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array([r.tobytes() for r in x], pa.binary())], names=["tree", "h", "x"])


def _grown(limit: int):
    def run(table: pa.Table) -> pa.Table:
        t = table.column("tree")[0].as_py()
        x = np.frombuffer(b"".join(table.column("x").to_pylist())).reshape(table.num_rows, -1)
        x = _first(table.column("h").to_numpy().view(np.uint64), x, SUBSAMPLE)[1]
        return pa.table({"tree": pa.array([t], pa.int32()), "nodes": pa.array([_tree(x, limit, np.random.default_rng([SEED, t])).tobytes()], pa.binary())})

    return run


def measured(docs: DataFrame) -> DataFrame:
    """The statistics and base verdict of every document, stored."""
    ship(docs.sparkSession)
    return stored(as_bytes(docs).mapInArrow(_stats_batches, _SQL))


def fit(stats: DataFrame, labels: DataFrame, max_good_rejected: float = MAX_GOOD_REJECTED) -> dict | None:
    """Forest and threshold from all labelled documents of `measured` that the base rules leave; None if there are none."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("_quality")).where("doc_id is not null and _quality is not null").groupBy("doc_id").agg(F.min("_quality").alias("_quality"))
    rows = stored(stats.where("not base_failed").join(marked, "doc_id"))
    n, n_good = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("_quality") > 0, 1))).first()
    if not n:
        return None
    size = min(SUBSAMPLE, n)
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    grown = rows.mapInArrow(_drawn, "tree int, h long, x binary").groupBy("tree").applyInArrow(_grown(limit), "tree int, nodes binary")
    forest = {"trees": [np.frombuffer(bytes(r.nodes)).reshape(-1, 5) for r in grown.orderBy("tree").collect()], "limit": limit, "norm": _depth_left(size) or 1.0, "threshold": 2.0}
    if not n_good:
        return forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(anomaly(forest, features(_columns(b))))], names=["score"])

    # the score at place `at` of all good ones: the range of scores that holds it, then the scores of that range
    at = min(n_good - 1, math.ceil(n_good * (1 - max_good_rejected)))
    counts = stored(rows.where("_quality > 0").mapInArrow(run, "score double").groupBy("score").agg(F.count(F.lit(1)).alias("n"))).withColumn("range", F.floor(F.col("score") * RANGES))
    for r in counts.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # RANGES + 1 rows at most
        if at < r.n:
            break
        at -= r.n
    for s in counts.where(F.col("range") == r.range).orderBy("score").toLocalIterator():
        if at < s.n:
            break
        at -= s.n
    forest["threshold"] = float(s.score)
    return forest


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: the statistics, base_failed, the anomaly score and the verdict `kept`."""
    stats = measured(docs)
    model = fit(stats, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            failed = b.column("base_failed").to_numpy(zero_copy_only=False)
            score = anomaly(model, features(_columns(b))) if model else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(~failed & (score <= (model["threshold"] if model else 1))), pa.array(score)], names=[*b.schema.names, "kept", "anomaly"])

    return stats.mapInArrow(run, f"{_SQL}, kept boolean, anomaly double")


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the verdict keeps, with all their columns."""
    model = fit(measured(docs), labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows), b.column("text").cast(pa.binary())], names=["doc_id", "text"])
            kept = [np.zeros(0, bool)]
            for _, texts in chunks(iter([pair])):
                s = statistics(texts)
                kept.append(~base_failed(s) & ((anomaly(model, features(s)) if model else np.zeros(len(texts))) <= (model["threshold"] if model else 1)))
            yield b.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
