"""Exact scans of a stated set of query vectors against all vectors, as a join of packed blocks.

Each task packs its vectors into blocks of at most BLOCK_BYTES. Blocks of vectors are dealt into as many hands as there are shuffle partitions,
blocks of queries go to each hand, and a join brings them together; every pair of blocks meets once, in one matrix
product, and Spark aggregates what the pairs give. The driver sees no rows, and a task holds one pair of blocks at a time. Joins of blocks are
merge joins by hint: the size of a block can't be told from its columns, and a broadcast would bring all copies of the queries to the driver.
Vectors that are null or hold nulls match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import ship, stored

BLOCK_BYTES = 1 << 20
_PACK = pa.schema([("hand", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("labels", pa.binary())])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(rows: DataFrame, v: str) -> DataFrame:
    return rows.where(F.col(v).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()))


def packed(rows: DataFrame, key: str, v: str, hands: int, label: str | None = None) -> DataFrame:
    """(hand, ids, vectors, labels): blocks of int64 ids, float64 vectors row by row, and int64 labels (the ids, if there are none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            m = matrix(b.column(1))
            step = max(1, BLOCK_BYTES // (8 * m.shape[1]))
            for lo in range(0, len(m), step):
                part = tuple(np.ascontiguousarray(x[lo : lo + step]) for x in (b.column(0).to_numpy(), m, b.column(2).to_numpy()))
                if size and size + len(part[0]) > step:
                    yield one(held, number % hands)
                    held, size, number = [], 0, number + 1
                held.append(part)
                size += len(part[0])
        if size:
            yield one(held, number % hands)

    def one(held: list, hand: int) -> pa.RecordBatch:
        parts = [np.concatenate(x) for x in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([hand], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], schema=_PACK)

    own = usable(rows, v).select(F.col(key).cast("long").alias("id"), F.col(v).alias("v"), F.col(label or key).cast("long").alias("label"))
    return own.mapInArrow(run, "hand int, ids binary, vectors binary, labels binary")


def unpacked(ids: pa.Scalar, vectors: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids.as_buffer(), np.int64)
    return own, np.frombuffer(vectors.as_buffer(), np.float64).reshape(len(own), -1)


@dataclass
class Block:
    ids: np.ndarray
    v: np.ndarray
    labels: np.ndarray


def scan(queries: DataFrame, rows: DataFrame, meet: Callable[[Block, Block], tuple], schema: pa.Schema, sql: str, key: str = "query_id", v: str = "q", label: str | None = None) -> DataFrame:
    """The rows that meet(queries, rows) gives as columns, for every pair of blocks; queries have labels if they come from the rows."""
    ship(rows.sparkSession)
    hands = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ("ids", "vectors", "labels")
    left = packed(queries, key, v, hands, label if label in queries.columns else None)
    left = left.select(F.explode(F.sequence(F.lit(0), F.lit(hands - 1))).alias("hand"), *(F.col(c).alias(f"query_{c}") for c in names))
    both = left.join(packed(rows, "doc_id", "v", hands, label).hint("merge"), "hand").select(*(f"query_{c}" for c in names), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, qv, ql, r, rv, rl in zip(*b.columns, strict=True):
                columns = meet(*(Block(*unpacked(i, x), np.frombuffer(y.as_buffer(), np.int64)) for i, x, y in ((q, qv, ql), (r, rv, rl))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return both.mapInArrow(run, sql)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


_HITS = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


def best_of(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest whole numbers of each row, ties by id; the least number is no hit."""
    none = np.iinfo(np.int64).min
    k = min(k, s.shape[1])
    least = np.partition(s, -k, axis=1)[:, -k]
    r, c = np.nonzero((s >= least[:, None]) & (s > none))
    order = np.lexsort((ids[c], -s[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(len(s)))[r] < k
    return r[keep], c[keep]


def best(queries: DataFrame, vectors: DataFrame, k: int, cosine: bool, digits: int = 5) -> DataFrame:
    """(query_id, doc_id, score): of each pair of blocks the k best of each query by rounded product (or cosine), then id, itself excluded."""
    scale = 10.0**digits

    def meet(q: Block, m: Block) -> tuple:
        s = np.rint((unit(q.v) @ unit(m.v).T if cosine else q.v @ m.v.T) * scale).astype(np.int64)
        s[q.ids[:, None] == m.ids[None, :]] = np.iinfo(np.int64).min
        r, c = best_of(s, m.ids, k)
        return q.ids[r], m.ids[c], s[r, c] / scale

    return scan(queries, vectors.select("doc_id", "v"), meet, _HITS, "query_id long, doc_id long, score double")


EXACT_ROWS = 1 << 15


def squares(q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, float]:
    """(squared Euclidean distances from one matrix product, a bound of their rounding with room to spare)."""
    qq, mm = (q * q).sum(1), (m * m).sum(1)
    d = q @ m.T
    d *= -2
    d += qq[:, None]
    d += mm[None, :]
    return d, 1e-9 * (1 + float(qq.max(initial=0)) + float(mm.max(initial=0)))


def exactly(q: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (i, j), summed from differences, EXACT_ROWS at a time."""
    out = np.empty(len(i))
    for lo in range(0, len(i), EXACT_ROWS):
        at = slice(lo, lo + EXACT_ROWS)
        out[at] = ((q[i[at]] - m[j[at]]) ** 2).sum(1)
    return out


def gaps(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Euclidean distances; near points, which would lose digits in the product, are summed from differences."""
    d, slack = squares(q, m)
    i, j = np.nonzero(d <= 1000 * slack)
    d[i, j] = exactly(q, m, i, j)
    return np.sqrt(d, out=d)


def scan_once(points: DataFrame, meet: Callable[[Block, Block, bool], tuple], schema: pa.Schema, sql: str, label: str | None = None) -> DataFrame:
    """The rows that meet(one, other, whether they are one block) gives for every unordered pair of blocks of (doc_id, v). Blocks are stored, so that
    both sides of the join have the same ones. They are dealt into groups, and each pair of groups is a cell of its own: a block is copied
    once for each group, about twice the root of the shuffle partitions, not once for each of these."""
    spark = points.sparkSession
    ship(spark)
    groups = int(np.ceil(2 * np.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    names = ("number", "ids", "vectors", "labels")
    own = stored(packed(points, "doc_id", "v", groups, label).withColumn("number", F.monotonically_increasing_id()))
    hand = F.col("hand")
    left = own.select(F.explode(F.sequence(hand * groups + hand, hand * groups + groups - 1)).alias("cell"), hand.alias("one_hand"), *(F.col(c).alias(f"one_{c}") for c in names))
    right = own.select(F.explode(F.sequence(hand, hand * groups + hand, F.lit(groups))).alias("cell"), "hand", *names)
    both = left.join(right.hint("merge"), "cell").where("one_hand < hand or one_number <= number").select(*(f"one_{c}" for c in names), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, a, av, al, q, r, rv, rl in zip(*b.columns, strict=True):
                columns = meet(*(Block(*unpacked(i, x), np.frombuffer(y.as_buffer(), np.int64)) for i, x, y in ((a, av, al), (r, rv, rl))), p.as_py() == q.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return both.mapInArrow(run, sql)


def joined(*parts: tuple) -> tuple:
    """Columns of several results of a pair of blocks, one after the other."""
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


_SUMS = pa.schema([("x", pa.int64()), ("label", pa.int64()), ("total", pa.float64()), ("n", pa.int64())])


def distance_sums(points: DataFrame) -> DataFrame:
    """(x, label, total, n): sums of the distances of each point to the other points of each label, one row for each pair of blocks."""

    def side(q: Block, m: Block, d: np.ndarray, other: np.ndarray) -> tuple:
        of, place = np.unique(m.labels, return_inverse=True)
        own = np.zeros((len(m.ids), len(of)))
        own[np.arange(len(m.ids)), place] = 1
        total, n = d @ own, other @ own
        return np.repeat(q.ids, len(of)), np.tile(of, len(q.ids)), total.ravel(), np.rint(n.ravel()).astype(np.int64)

    def meet(q: Block, m: Block, same: bool) -> tuple:
        d, other = gaps(q.v, m.v), (q.ids[:, None] != m.ids[None, :]).astype(np.float64)
        d *= other
        return side(q, m, d, other) if same else joined(side(q, m, d, other), side(m, q, d.T, other.T))

    return scan_once(points, meet, _SUMS, "x long, label long, total double, n long", "label")


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
TILE, SINGLE = 128, 1e30


def near_masks(q: np.ndarray, m: np.ndarray, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whether each point of m lies within eps of it) for TILE rows of q at a time, which stay in the cache. Products are of single
    precision; pairs closer to eps than their rounding, with room to spare, are summed from differences."""
    qq, mm = (q * q).sum(1), (m * m).sum(1)
    most = float(qq.max(initial=0)) + float(mm.max(initial=0)) + eps * eps
    kind = np.float32 if most < SINGLE else np.float64
    slack = 2 * float(np.finfo(kind).eps) * (q.shape[1] + 16) * most + 1e-36
    left, right, mm, qq = q.astype(kind), np.ascontiguousarray((-2 * m).astype(kind).T), mm.astype(kind), (qq - eps * eps).astype(kind)
    for lo in range(0, len(q), TILE):
        d = left[lo : lo + TILE] @ right
        d += mm
        d += qq[lo : lo + TILE, None]
        mask = d <= slack
        open_ = np.flatnonzero(mask.ravel() & (d.ravel() > -slack))
        if len(open_):
            i, j = np.divmod(open_, len(m))
            mask[i, j] = exactly(q, m, i + lo, j) <= eps * eps
        yield lo, mask


def near(q: np.ndarray, m: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, row of m) at a Euclidean distance of at most eps."""
    found = [(i + lo, j) for lo, mask in near_masks(q, m, eps) for i, j in (np.nonzero(mask),)]
    return joined(*found) if found else (np.zeros(0, np.int64),) * 2


_NEAR = pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])


def counts_within(points: DataFrame, eps: float) -> DataFrame:
    """(doc_id, n): how many points lie within eps of each, itself included. Blocks give counts, no pairs."""

    def meet(q: Block, m: Block, same: bool) -> tuple:
        mine, theirs = np.zeros(len(q.ids), np.int64), np.zeros(len(m.ids), np.int64)
        for lo, mask in near_masks(q.v, m.v, eps):
            mine[lo : lo + TILE] = np.count_nonzero(mask, axis=1)
            theirs += np.count_nonzero(mask, axis=0)
        some = (q.ids[mine > 0], mine[mine > 0])
        return some if same else joined(some, (m.ids[theirs > 0], theirs[theirs > 0]))

    return scan_once(points, meet, _NEAR, "doc_id long, n long").groupBy("doc_id").agg(F.sum("n").alias("n"))


def within(points: DataFrame, eps: float) -> DataFrame:
    """(a, b) of points with Euclidean distance at most eps, itself included, from all pairs of blocks."""

    def meet(q: Block, m: Block, same: bool) -> tuple:
        i, j = near(q.v, m.v, eps)
        return (q.ids[i], m.ids[j]) if same else joined((q.ids[i], m.ids[j]), (m.ids[j], q.ids[i]))

    return scan_once(points, meet, _PAIRS, "a long, b long")


SPARSE_QUERIES, SPARSE_ROWS, SPARSE_STEP = 256, 8192, 1 << 22
_SPARSE = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("terms", pa.binary()), ("places", pa.binary()), ("weights", pa.binary())])


def _sparse_block(table: pa.Table) -> pa.Table:
    """One block of (block, id, t, w): its ids, and its weights in the order of terms."""
    ids, place = np.unique(table.column("id").to_numpy(), return_inverse=True)
    t, w = table.column("t").to_numpy(), table.column("w").to_numpy()
    order = np.lexsort((place, t))
    columns = (ids, t[order], place[order].astype(np.int64), w[order])
    return pa.Table.from_arrays([pa.array([table.column("block")[0].as_py()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], schema=_SPARSE)


def _sparse_packed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(id, t, w) in blocks of about `size` ids, and the number of blocks."""
    n = int(rows.agg(F.approx_count_distinct("id")).first()[0]) // size + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
    return dealt.groupBy("block").applyInArrow(_sparse_block, "block long, ids binary, terms binary, places binary, weights binary"), n


def _sparse_scores(q: list[np.ndarray], m: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(products, whether they share a term) of all ids of two blocks; pairs of weights are met SPARSE_STEP at a time."""
    (qi, qt, qp, qw), (mi, mt, mp, mw) = q, m
    cells = len(qi) * len(mi)
    total, hit, signed = np.zeros(cells), np.zeros(cells, bool), (qw <= 0).any() or (mw <= 0).any()
    first = np.searchsorted(mt, qt, "left")
    n = np.searchsorted(mt, qt, "right") - first
    some = np.flatnonzero(n)
    first, n, qp, qw = first[some], n[some], qp[some], qw[some]
    part = np.cumsum(n) // SPARSE_STEP
    edges = np.concatenate((np.flatnonzero(np.append(True, np.diff(part) > 0)), [len(n)])) if len(n) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        k = n[a:b]
        row = np.repeat(np.arange(a, b), k)
        at = np.arange(len(row)) + np.repeat(first[a:b] - (np.cumsum(k) - k), k)
        cell = qp[row] * len(mi) + mp[at]
        total += np.bincount(cell, qw[row] * mw[at], cells)
        if signed:
            hit[cell] = True
    return total.reshape(len(qi), -1), (hit if signed else total > 0).reshape(len(qi), -1)


def sparse_best(queries: DataFrame, rows: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """(query_id, doc_id, score): of each pair of blocks the k best of each query (query_id, term, qw) by its rounded product with
    (doc_id, term, w), then id, itself excluded; rows that share no term are no hits. Only the k best of a pair leave it."""
    spark = rows.sparkSession
    ship(spark)
    terms = stored(queries.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))  # numbers, fixed by storing
    sides = ((queries, "query_id", "qw"), (rows, "doc_id", "w"))
    left, right = (stored(x.join(terms.hint("merge"), "term").select(F.col(key).cast("long").alias("id"), "t", F.col(w).cast("double").alias("w"))) for x, key, w in sides)
    (left, _), (right, n) = _sparse_packed(left, SPARSE_QUERIES), _sparse_packed(right, SPARSE_ROWS)
    hands = min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names, scale, none = _SPARSE.names[1:], 10.0**digits, np.iinfo(np.int64).min
    left = left.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hands - 1).cast("long"))).alias("hand"), *(F.col(c).alias(f"query_{c}") for c in names))
    both = left.join(right.withColumn("hand", F.col("block") % hands).hint("merge"), "hand").select(*(f"query_{c}" for c in names), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int64, np.int64, np.float64) * 2
        for b in batches:
            for row in zip(*b.columns, strict=True):
                x = [np.frombuffer(c.as_buffer(), kind) for c, kind in zip(row, kinds, strict=True)]
                total, hit = _sparse_scores(x[:4], x[4:])
                s = np.where(hit, np.trunc(total * scale + np.copysign(0.5, total)), none).astype(np.int64)
                s[~hit | (x[0][:, None] == x[4][None, :])] = none
                r, c = best_of(s, x[4], k)
                yield pa.RecordBatch.from_arrays([pa.array(x[0][r]), pa.array(x[4][c]), pa.array(s[r, c] / scale)], schema=_HITS)

    return both.mapInArrow(run, "query_id long, doc_id long, score double")
