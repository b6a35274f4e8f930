"""BM25 top k with early termination: postings in shards of documents, with the largest impact of each range of a shard.

An index is built once and kept: documents are dealt into shards of about SHARD_DOCS by a hash, ordered in a shard by length, and cut
into ranges of RANGE documents. A term's postings in a shard are one packed row with the impact of each posting (its BM25 part
without the query's share) and the largest impact of each range that has any.

A search goes over the shards twice. First each shard scores its most promising ranges for each query, the PRIME ranges with the
largest sums of maxima; the k-th best of all those scores, over all shards, is a threshold that every result reaches. Then each shard goes term
by term, the largest impacts first, and reads a term's postings only in ranges where some document's sum so far and the range's
maxima of the remaining terms together can still reach the threshold (or the shard's own k-th best). What is left out cannot be among
the k best, so the results are those of a full scan.

A group of the two joins is the postings of one block of queries in one shard, bounded by both; the driver sees no postings.
Queries without known words have no rows; ties of rounded scores go to the smaller id; documents without words are in no postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.operators.index import postings, top
from lexloom.operators.rank import K1, B
from lexloom.session import ship, stored

SHARD_DOCS, RANGE, PRIME, QUERIES, MARGIN = 8192, 8, 16, 256, 1e-5


@dataclass
class Index:
    docs: DataFrame  # shard, place, doc_id
    terms: DataFrame  # shard, term, idf, n, places, impacts, ranges, tops: packed

    def write(self, path: str) -> None:
        self.docs.write.parquet(f"{path}/docs")
        self.terms.write.parquet(f"{path}/terms")


def read(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/terms"))


_TERMS = "shard int, term string, idf double, n int, places binary, impacts binary, ranges binary, tops binary"


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns: list[list] = [[] for _ in range(5)]
        for places, impacts in zip(b.column(3), b.column(4), strict=True):
            at, w = places.values.to_numpy(), impacts.values.to_numpy()
            order = np.argsort(at, kind="stable")
            at, w = at[order].astype(np.int32), w[order]
            head = np.flatnonzero(np.append(True, at[1:] // width != at[:-1] // width))
            for c, x in zip(columns, (len(at), at.tobytes(), w.tobytes(), (at[head] // width).tobytes(), np.maximum.reduceat(w, head).tobytes()), strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["shard", "term", "idf", "n", "places", "impacts", "ranges", "tops"])


def build(docs: DataFrame, shard_docs: int = SHARD_DOCS, width: int = RANGE) -> Index:
    """An index of (doc_id, text) with unique ids."""
    ship(docs.sparkSession)
    sizes = stored(docs.select("doc_id", F.size(tokens(F.col("text"))).alias("dl")))
    n, mean = sizes.agg(F.count(F.lit(1)), F.avg("dl")).first()
    shards = n // shard_docs + 1
    order = Window.partitionBy("shard").orderBy("dl", "doc_id")
    placed = stored(sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).withColumn("place", F.row_number().over(order) - 1))
    p = stored(postings(docs).select("term", "doc_id", "tf"))
    idf = p.groupBy("term").agg(F.log10(F.lit(float(n)) / F.count(F.lit(1))).alias("idf"))
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean or 1.0)))
    lists = p.join(placed, "doc_id").select("shard", "term", "place", impact.alias("w")).groupBy("shard", "term").agg(F.collect_list(F.struct("place", "w")).alias("x"))
    rows = lists.join(idf, "term").select("shard", "term", "idf", F.col("x.place").alias("places"), F.col("x.w").alias("impacts"))
    return Index(placed.select("shard", "place", "doc_id"), stored(rows.mapInArrow(lambda b: _packed(b, width), _TERMS)))


class Shard:
    """The postings of some terms in one shard, and the scoring of queries over them."""

    def __init__(self, table: pa.Table, width: int):
        self.width, self.lists = width, {}
        top = 0
        for term, idf, places, w, ranges, tops in zip(*(table.column(c) for c in ("term", "idf", "places", "impacts", "ranges", "tops")), strict=True):
            at, of = np.frombuffer(places.as_buffer(), np.int32), np.frombuffer(ranges.as_buffer(), np.int32)
            self.lists[term.as_py()] = (idf.as_py(), at, np.frombuffer(w.as_buffer(), np.float64), of, np.frombuffer(tops.as_buffer(), np.float64))
            top = max(top, int(of[-1]) + 1)
        self.ranges, self.read = top, 0

    def bounds(self, terms: list[tuple[str, int]]) -> tuple[list[tuple], np.ndarray]:
        """(share, places, impacts, maxima by range) of the known terms, and the sums of the maxima."""
        known = [(qtf * self.lists[t][0], *self.lists[t][1:]) for t, qtf in terms if t in self.lists]
        out, total = [], np.zeros(self.ranges)
        for share, at, w, of, tops in known:
            own = np.zeros(self.ranges)
            own[of] = share * tops
            total += own
            out.append((share, at, w, own))
        return out, total

    def add(self, score: np.ndarray, share: float, at: np.ndarray, w: np.ndarray, use: np.ndarray) -> None:
        ok = use[at // self.width]
        self.read += int(np.count_nonzero(ok))
        score[at[ok]] += share * w[ok]

    def prime(self, terms: list[tuple[str, int]], k: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best documents of the most promising ranges."""
        lists, total = self.bounds(terms)
        use = np.zeros(self.ranges, bool)
        use[np.argsort(-total, kind="stable")[:count]] = True
        score = np.zeros(self.ranges * self.width)
        for share, at, w, _ in lists:
            self.add(score, share, at, w, use)
        return self._best(score, np.flatnonzero(score > 0), k)

    def search(self, terms: list[tuple[str, int]], k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of documents that may be among the k best of all: those that reach the threshold `least`."""
        lists, rest = self.bounds(terms)
        lists.sort(key=lambda x: -float(x[3].max()))
        score, open_ = np.zeros(self.ranges * self.width), np.ones(self.ranges, bool)
        for share, at, w, own in lists:
            limit = least
            if len(score) > k:
                limit = max(limit, float(np.partition(score, -k)[-k]))
            open_ &= (score.reshape(-1, self.width).max(1) + rest) >= limit - MARGIN
            self.add(score, share, at, w, open_)
            rest = rest - own
        open_ &= score.reshape(-1, self.width).max(1) >= least - MARGIN
        return self._best(score, np.flatnonzero((score > 0) & np.repeat(open_, self.width) & (score >= least - MARGIN)), k)

    def _best(self, score: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the given places that are among the k best, or as good to rounding."""
        if len(at) > k:
            at = at[score[at] >= np.partition(score[at], -k)[-k] - MARGIN]
        return at, score[at]


_HITS = pa.schema([("query_id", pa.int64()), ("shard", pa.int32()), ("place", pa.int32()), ("s", pa.float64()), ("read", pa.int64())])


def _visit(index: Index, queries: DataFrame, k: int, width: int, prime: int) -> DataFrame:
    """(query_id, shard, place, s, read) of (block, query_id, terms, least) in every shard: primed scores with prime > 0, else the search.
    A row without a place says how many postings a group read."""
    asked = queries.select("block", F.explode("terms.term").alias("term")).distinct()
    lists = index.terms.join(asked, "term").select("block", "shard", "term", "idf", "places", "impacts", "ranges", "tops")
    everywhere = queries.join(lists.select("block", "shard").distinct(), "block")
    everywhere = everywhere.select(*(F.col(c).alias(c) for c in ("block", "shard", "query_id", "terms", "least")))  # columns of its own, as both sides of the cogroup stem from the queries

    def run(lists: pa.Table, queries: pa.Table) -> pa.Table:
        rows = []
        if lists.num_rows:
            own, number = Shard(lists, width), lists.column("shard")[0].as_py()
            for q, terms, least in zip(*(queries.column(c).to_pylist() for c in ("query_id", "terms", "least")), strict=True):
                pairs = [(t["term"], t["qtf"]) for t in terms]
                at, s = own.prime(pairs, k, prime) if prime else own.search(pairs, k, least)
                rows += [(q, number, p, x, 0) for p, x in zip(at.tolist(), s.tolist(), strict=True)]
            rows.append((None, number, None, None, own.read))
        return pa.Table.from_pylist([dict(zip(_HITS.names, r, strict=True)) for r in rows], _HITS)

    return lists.groupBy("block", "shard").cogroup(everywhere.groupBy("block", "shard")).applyInArrow(run, "query_id long, shard int, place int, s double, read long")


def _blocks(terms: DataFrame, size: int) -> DataFrame:
    """(block, query_id, terms) of (query_id, term, qtf): queries dealt into blocks of about `size` by a hash."""
    q = stored(terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "qtf"))).alias("terms")))
    blocks = q.count() // size + 1
    return q.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "terms")


def _runs(index: Index, terms: DataFrame, k: int, width: int, prime: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The stored rows of both rounds."""
    queries = _blocks(terms, size)
    first = stored(_visit(index, queries.withColumn("least", F.lit(0.0)), k, width, prime))
    kth = top(first.where("place is not null").select("query_id", F.concat_ws(":", "shard", "place").alias("doc_id"), F.col("s").alias("score")), k).where(F.col("rank") == k)
    bounded = queries.join(kth.select("query_id", F.col("score").alias("least")), "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    return first, stored(_visit(index, bounded, k, width, 0))


def search(index: Index, terms: DataFrame, k: int = 10, width: int = RANGE, prime: int = PRIME, block: int = QUERIES) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best by BM25 for queries (query_id, term, qtf)."""
    hits = _runs(index, terms, k, width, prime, block)[1].where("place is not null")
    return top(hits.join(index.docs, ["shard", "place"]).select("query_id", "doc_id", F.round("s", 5).alias("score")), k)


def report(index: Index, terms: DataFrame, k: int = 10, width: int = RANGE, prime: int = PRIME, block: int = QUERIES) -> DataFrame:
    """One row: the postings of all queries' terms, and the share of them that both rounds together have read."""
    first, second = _runs(index, terms, k, width, prime, block)
    n = terms.join(index.terms.groupBy("term").agg(F.sum("n").alias("n")), "term").agg(F.sum("n").alias("postings"))
    read = first.unionByName(second).agg(F.sum("read").alias("read"))
    return n.crossJoin(read).select("postings", F.round(F.col("read") / F.col("postings"), 4).alias("share_read"))
