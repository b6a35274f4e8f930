"""Approximate and exact dense search over an inverted file with residual product quantisation.

`fit` learns coarse centroids and, for slices of the residuals, 256 code words each, on a bounded sample; `index` files every row under
its nearest centroid as one code byte a slice, with the length of what the code leaves out (err), beside its vector. A search makes two passes:
each query goes to the lists nearest to it, whose codes give the cut of its best `rerank` rows, and then to the blocks of
the rows, where those that are not below the cut are scored from their full vectors. Only cuts, and the k best of each part of the rows, leave
the tasks; no pairs are shuffled, and no vectors but once with their block. Copies of codes and queries are sent to a number of tasks that depends on the cores.

A row's product differs from its code's by |q| err at most (triangle inequality), and no row of a list exceeds
q c + |q| radius. `exact_search` uses both bounds: what a first, approximate round found sets each query's threshold, and every
row whose bound reaches it is scored in full, so that the result is that of a scan of all rows, whatever the data.

The model is bounded by its parameters (lists, slices, sample), never by the rows; a list of any size is many blocks.
Rows whose vector is null or holds nulls are in no list. Ties of rounded scores go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import blocks
from lexloom.operators.index import top
from lexloom.session import ship, stored

SAMPLE, CODES, STEPS, SEED = 65_536, 256, 12, 5
BLOCK = 4096
DIGITS = 5


@dataclass
class Model:
    centroids: np.ndarray  # lists x dimensions
    books: np.ndarray  # slices x CODES x dimensions of a slice


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gaps = (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)
    return gaps.argmin(1)


def lloyd(x: np.ndarray, k: int, steps: int = STEPS, seed: int = SEED) -> np.ndarray:
    """k centres of the sample; a centre that loses all its points stays where it was."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(steps):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(vectors: DataFrame, lists: int, slices: int, sample: int = SAMPLE) -> Model:
    """A model of at most `sample` rows, those with the smallest hashes of their ids; without rows it has one list and no dimensions."""
    some = blocks.usable(vectors, "v").orderBy(F.xxhash64("doc_id"), "doc_id").select("v").limit(sample).toArrow()
    if not some.num_rows:
        return Model(np.zeros((1, 0)), np.zeros((slices, CODES, 0)))
    x = blocks.matrix(some.column("v").combine_chunks())
    centroids = lloyd(x, lists)
    rest = x - centroids[_nearest(x, centroids)]
    width = -(-x.shape[1] // slices)
    rest = np.pad(rest, ((0, 0), (0, width * slices - x.shape[1])))
    return Model(centroids, np.stack([lloyd(np.pad(part, ((0, max(CODES - len(part), 0)), (0, 0))), CODES) for part in np.split(rest, slices, axis=1)]))


def encode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(list, codes, err, radius) of each row: its distance from the code's vector, and from the centroid."""
    own = _nearest(x, model.centroids)
    rest = x - model.centroids[own]
    slices, _, width = model.books.shape
    wide = np.pad(rest, ((0, 0), (0, slices * width - x.shape[1]))).reshape(len(x), slices, width)
    codes = np.stack([_nearest(wide[:, s], model.books[s]) for s in range(slices)], 1).astype(np.uint8)
    left = wide - model.books[np.arange(slices), codes]
    return own, codes, np.sqrt((left * left).sum((1, 2))), np.sqrt((rest * rest).sum(1))


@dataclass
class Index:
    model: Model
    codes: DataFrame  # list, n, radius, ids, codes, errs, vectors: a packed block of a list
    radius: np.ndarray  # of each list

    vectors: DataFrame  # doc_id, v
    size: int  # rows
    blocks: int

    def rows(self) -> int:
        return self.size


def build(vectors: DataFrame, lists: int, slices: int, sample: int = SAMPLE) -> Index:
    """An index of (doc_id, v) with a model of its own."""
    return index(vectors, fit(vectors, lists, slices, sample))


_BLOCK_SQL = "list int, n int, radius double, ids binary, codes binary, errs binary, vectors binary"


def index(vectors: DataFrame, model: Model) -> Index:
    """Every row under its list. Tasks pack what they read list by list; no rows are moved but the packed blocks, which are written in the order of lists."""
    spark = vectors.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, x, own, codes, err, radius = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(own, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(own[order]) != 0)).tolist() + [len(own)]
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            for lo in range(a, b, BLOCK):
                at = order[lo : min(lo + BLOCK, b)]
                out.append((int(own[at[0]]), len(at), float(radius[at].max()), ids[at].tobytes(), codes[at].tobytes(), err[at].tobytes(), x[at].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4), strict=True)], names=["list", "n", "radius", "ids", "codes", "errs", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                x = blocks.matrix(b.column(1))
                held.append((b.column(0).to_numpy(), x, *encode(shared.value, x)))
                size += b.num_rows
            if size >= 16 * BLOCK:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    packs = blocks.usable(vectors, "v").select("doc_id", "v").mapInArrow(run, _BLOCK_SQL)
    codes = stored(packs.repartition("list", F.pmod(F.xxhash64("ids"), F.lit(8))).sortWithinPartitions("list"))  # a hot list lies in eight places
    radius, size, n = np.zeros(len(model.centroids)), 0, 0
    for r in codes.groupBy("list").agg(F.max("radius").alias("radius"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("n")).collect():  # a row for each list
        radius[r.list], size, n = r.radius, size + r.size, n + r.n
    return Index(model, codes, radius, vectors, size, n)


PART_ROWS, PART_BYTES, QUERIES, CELLS = 1 << 22, 1 << 25, 256, 1 << 22


def _dealt(index: Index, queries: DataFrame, kept: list[str], parts: int, hands: int, run: Callable, sql: str) -> DataFrame:
    """What run(blocks, batches of (query_id, q, least, last)) gives in each of parts x hands tasks: a part of the blocks, with the columns named, and a hand of the queries.
    Blocks lie first in a task, which holds its part; queries stream past them."""
    model = queries.sparkSession.sparkContext.broadcast(index.model)
    number = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of_query, of_block = {"query_id": "long", "q": "array<double>", "least": "double", "last": "long"}, {"list": "int"} | {c: "binary" for c in kept}
    none = lambda of: (F.lit(None).cast(t).alias(c) for c, t in of.items())
    left = index.codes.select(number("ids", parts).alias("part"), every(hands).alias("hand"), F.lit(0).alias("kind"), *of_block, *none(of_query))
    asked = blocks.usable(queries, "q").select(every(parts).alias("part"), number("query_id", hands).alias("hand"), F.lit(1).alias("kind"), *none(of_block), *(F.col(c).cast(t).alias(c) for c, t in of_query.items()))
    dealt = left.unionByName(asked).repartitionById(parts * hands, F.col("part") * hands + F.col("hand")).sortWithinPartitions("kind", "list")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lists, m = [], {}, model.value
        for b in batches:
            kind = b.column("kind").to_numpy()
            n = int((kind == 0).sum())
            for of, *packs in zip(b.column("list")[:n].to_pylist(), *(b.column(c)[:n] for c in kept), strict=True):
                lists.setdefault(of, []).append(tuple(np.frombuffer(x.as_buffer(), _KINDS[c]) for c, x in zip(kept, packs, strict=True)))
            if n == len(kind):
                continue
            if lists:
                held, lists = [_Block(m, of, *(np.concatenate(c) for c in zip(*x, strict=True))) for of, x in lists.items()], {}
            for lo in range(n, len(kind), QUERIES):
                part = b.slice(lo, QUERIES)
                if held:
                    yield from run(m, held, part.column("query_id").to_numpy(), blocks.matrix(part.column("q")), *(part.column(c).to_numpy(zero_copy_only=False) for c in ("least", "last")))

    return dealt.select("kind", "list", *kept, *of_query).mapInArrow(task, sql)


_KINDS = {"ids": np.int64, "codes": np.uint8, "errs": np.float64, "vectors": np.float64}


class _Block:
    """The rows of a list in a task."""

    def __init__(self, model: Model, of: int, ids: np.ndarray, codes: np.ndarray, *more: np.ndarray) -> None:
        self.list, self.ids, self.codes = of, ids, codes.reshape(len(ids), -1)
        self.errs, self.v = (more[0], more[1].reshape(len(ids), -1)) if more else (None, None)

    def made(self, model: Model, at: slice, unit: float) -> np.ndarray:
        """The vectors that codes stand for, in whole multiples of `unit`."""
        width = model.centroids.shape[1]
        return np.rint((model.centroids[self.list] + np.concatenate([book[c] for book, c in zip(model.books, self.codes[at].T, strict=True)], 1)[:, :width]) / unit)


def _units(model: Model, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(whole multiples of a unit of each query, these units, a unit of codes), so that products are whole numbers which are
    the same in whatever blocks they are computed."""
    bits = (51 - int(np.ceil(np.log2(max(q.shape[1], 1))))) // 2
    power = lambda x: 2.0 ** (np.ceil(np.log2(np.maximum(x, 1e-150))) - bits)
    own = power(np.abs(q).max(1, initial=0))
    return np.rint(q / own[:, None]), own, float(power(np.abs(model.centroids).max(initial=0) + np.abs(model.books).max(initial=0)))


def _firsts(model: Model, q: np.ndarray, probes: int) -> np.ndarray:
    """Which lists each query goes to: the `probes` ones of the largest products with their centroids."""
    near = np.rint(q @ model.centroids.T * 1e9)
    some = np.argsort(-near, axis=1, kind="stable")[:, :probes]
    chosen = np.zeros(near.shape, bool)
    np.put_along_axis(chosen, some, True, 1)
    return chosen


_CUTS = pa.schema([("query_id", pa.int64()), ("least", pa.float64()), ("last", pa.int64()), ("seen", pa.int64()), ("read", pa.int64())])


def cuts(index: Index, queries: DataFrame, probes: int, rerank: int) -> DataFrame:
    """(query_id, least, last, seen, read): the product and id of the last of the `rerank` rows of each query whose codes score best in its lists, how many codes
    were scored, and how many rows are not below that cut. Every task meets the codes (not the vectors) of up to PART_ROWS rows."""

    parts = -(-max(index.size, 1) // PART_ROWS)
    hands = 2 * queries.sparkSession.sparkContext.defaultParallelism

    def run(model: Model, held: list[_Block], query_ids: np.ndarray, q: np.ndarray, *_: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole, own, unit = _units(model, q)
        chosen, ids = _firsts(model, q, probes), np.concatenate([b.ids for b in held])
        step, out = max(1, CELLS // len(ids)), []
        made = lambda b: ((at, b.made(model, at, unit)) for at in (slice(lo, lo + BLOCK) for lo in range(0, len(b.ids), BLOCK)))
        for lo in range(0, len(q), step):
            of, x, some = query_ids[lo : lo + step], whole[lo : lo + step], chosen[lo : lo + step]
            s, first = np.full((len(x), len(ids)), -np.inf), 0
            for b in held:
                ask = np.flatnonzero(some[:, b.list])
                for at, v in made(b) if len(ask) else ():
                    s[ask, first + at.start : first + at.start + len(v)] = x[ask] @ v.T
                first += len(b.ids)
            seen = (s > -np.inf).sum(1)
            s[of[:, None] == ids[None, :]] = -np.inf
            k = min(rerank, len(ids))
            least = np.partition(s, -k, axis=1)[:, -k]
            n = np.minimum((s > -np.inf).sum(1), k)
            for i in range(len(x)):
                if parts > 1:  # the best of a part, among which are those of all
                    at = np.flatnonzero((s[i] >= least[i]) & (s[i] > -np.inf))
                    at = at[np.lexsort((ids[at], -s[i][at]))][:k]
                    out.append((np.full(len(at), of[i]), s[i][at], ids[at], np.zeros(len(at), np.int64), np.ones(len(at), np.int64)))
                    out.append((of[i : i + 1], np.array([-np.inf]), np.array([-1]), seen[i : i + 1], np.zeros(1, np.int64)))
                else:
                    ties = np.sort(ids[s[i] == least[i]]) if least[i] > -np.inf else np.array([np.iinfo(np.int64).max])
                    above = int((s[i] > least[i]).sum())
                    out.append((of[i : i + 1], least[i : i + 1], ties[min(k - above, len(ties)) - 1 :][:1], seen[i : i + 1], n[i : i + 1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out, strict=True), _CUTS, strict=True)], schema=_CUTS)

    found = _dealt(index, _open(queries), ["ids", "codes"], parts, hands, run, "query_id long, least double, last long, seen long, read long")
    if parts == 1:
        return found
    found = stored(found)
    last = top(found.where("read = 1"), rerank, score="least", item="last").groupBy("query_id").agg(F.max_by(F.struct("least", "last"), "rank").alias("x"), F.count(F.lit(1)).alias("read"))
    last = last.select("query_id", "x.least", "x.last", "read")
    return found.groupBy("query_id").agg(F.sum("seen").alias("seen")).join(last, "query_id", "left").select("query_id", F.coalesce("least", F.lit(float("-inf"))).alias("least"), F.coalesce("last", F.lit((1 << 63) - 1)).alias("last"), "seen", F.coalesce("read", F.lit(0)).alias("read"))


_HITS = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


def _scored(index: Index, queries: DataFrame, k: int, choose: Callable) -> DataFrame:
    """(query_id, doc_id, score): the k best of each part of the rows by full vectors, of those (row of q, row of block) that choose(model, q, least, last, block, slice) names.
    Vectors stay where their codes are; queries come to every part."""
    parts = max(1, min(index.blocks, max(3 * queries.sparkSession.sparkContext.defaultParallelism, 8 * index.size * index.model.centroids.shape[1] // PART_BYTES)))
    scale = 10.0**DIGITS

    def run(model: Model, held: list[_Block], query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # row of q, doc_id, score
        for b in held:
            for at in (slice(lo, lo + BLOCK) for lo in range(0, len(b.ids), BLOCK)):
                ids, v = b.ids[at], b.v[at]
                r, c = choose(model, q, least, last, b, at)
                other = query_ids[r] != ids[c]
                r, c = r[other], c[other]
                if 8 * len(r) > len(q) * len(ids):
                    s = (q @ v.T)[r, c]
                else:
                    s = np.concatenate([np.einsum("ij,ij->i", q[r[lo : lo + EXACT]], v[c[lo : lo + EXACT]]) for lo in range(0, len(r), EXACT)] or [np.zeros(0)])
                r, c, s = (np.concatenate(x) for x in zip(best, (r, ids[c], np.rint(s * scale).astype(np.int64)), strict=True))
                order = np.lexsort((c, -s, r))
                r, c, s = r[order], c[order], s[order]
                keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(q)))[r] < k
                best = [r[keep], c[keep], s[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[best[0]]), pa.array(best[1]), pa.array(best[2] / scale)], schema=_HITS)

    return _dealt(index, queries, ["ids", "codes", "errs", "vectors"], parts, 1, run, "query_id long, doc_id long, score double")


EXACT = 1 << 15


def _open(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "q", F.lit(None).cast("double").alias("least"), F.lit(None).cast("long").alias("last"))


def _reranked(index: Index, queries: DataFrame, cut: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k by full vectors of the rows that are not below the cuts."""

    def choose(model: Model, q: np.ndarray, least: np.ndarray, last: np.ndarray, b: _Block, at: slice) -> tuple[np.ndarray, np.ndarray]:
        ask = np.flatnonzero(_firsts(model, q, probes)[:, b.list])
        whole, _, unit = _units(model, q[ask])
        s, ids, least, last = whole @ b.made(model, at, unit).T, b.ids[at][None, :], least[ask][:, None], last[ask][:, None]
        r, c = np.nonzero((s > least) | ((s == least) & (ids <= last)))
        return ask[r], c

    return top(_scored(index, queries.select("query_id", "q").join(cut.select("query_id", "least", "last"), "query_id"), k, choose), k)


def search(index: Index, queries: DataFrame, k: int, probes: int, rerank: int) -> DataFrame:
    """(query_id, doc_id, score, rank): approximate best k by inner product, itself excluded, from `rerank` full vectors a query."""
    return _reranked(index, queries, stored(cuts(index, queries, probes, rerank)), k, probes)


def exact_search(index: Index, queries: DataFrame, k: int, probes: int = 1) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k of all rows. Queries with fewer than k rows in their first lists take every row."""
    first = stored(search(index, queries, k, probes, 4 * k))
    least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    bounded = queries.select("query_id", "q").join(least, "query_id", "left").select("query_id", "q", F.coalesce("least", F.lit(float("-inf"))).alias("least"), F.lit(0).cast("long").alias("last"))
    radius = index.radius

    def choose(model: Model, q: np.ndarray, least: np.ndarray, last: np.ndarray, b: _Block, at: slice) -> tuple[np.ndarray, np.ndarray]:
        length, least = np.sqrt((q * q).sum(1)), least - 10.0**-DIGITS
        ask = np.flatnonzero(q @ model.centroids[b.list] + length * radius[b.list] >= least)
        reach = q[ask] @ b.made(model, at, 1e-12).T
        reach *= 1e-12
        reach += length[ask][:, None] * b.errs[at][None, :]
        r, c = np.nonzero(reach >= least[ask][:, None])
        return ask[r], c

    return top(_scored(index, bounded, k, choose), k)


def report(index: Index, queries: DataFrame, k: int, probes: int, rerank: int) -> DataFrame:
    """One row: recall at k against the scan of all rows, and the shares of all rows whose codes, and whose vectors, a query reads."""
    cut = stored(cuts(index, queries, probes, rerank))
    hits = _reranked(index, queries, cut, k, probes)
    true = top(blocks.best(queries, index.vectors, k, cosine=False), k)
    right = true.join(hits.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    x = right.crossJoin(cut.agg(F.sum("seen").alias("codes"), F.sum("read").alias("read"))).crossJoin(blocks.usable(queries, "q").agg(F.count(F.lit(1)).alias("queries")))
    share = lambda c: F.round(F.col(c) / F.col("queries") / F.lit(index.size), 4)
    return x.select(F.round("recall", 4).alias("recall"), share("codes").alias("codes_read"), share("read").alias("vectors_read"))
