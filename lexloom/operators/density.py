"""DBSCAN as a metric-space join: pivot partitions with a halo, local core tests, clusters merged as components.

Every point belongs to its nearest pivot. A pair at a distance of eps at most meets in the partition of either point, because a point
is also sent, as halo, to every pivot that is no more than 2 eps further than its own and whose partition (radius, by the
triangle inequality) comes within eps of it. Partitions are packed into blocks; a pivot with many points is dealt into several hands, so
that no partition has to fit one task. Blocks never emit pairs: the first join emits neighbour counts, which make core points; the
second ties the core points of two blocks to the smallest one they reach there, and border points to their smallest core
neighbour. Components over these ties, no more than the points of the blocks, merge the clusters.

Pivots are a bounded number of rows. The results do not depend on them, only the work does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import blocks
from lexloom.operators.graph import components
from lexloom.session import ship, stored

PIVOTS, HAND_ROWS, FLUSH = 64, 65_536, 65_536


@dataclass
class Parts:
    pivots: np.ndarray
    radius: np.ndarray
    hands: np.ndarray
    eps: float


def _gaps(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T), 0))


def partition(points: DataFrame, eps: float, pivots: int, hand_rows: int) -> tuple[DataFrame, Parts | None]:
    """((doc_id, v, pivot, gap) of usable points, the pivots with the radius of each and the hands it is dealt into)."""
    rows = blocks.usable(points, "v").select("doc_id", F.col("v").cast("array<double>").alias("v"))
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pivots).toArrow()
    if not some.num_rows:
        return rows, None
    centres = rows.sparkSession.sparkContext.broadcast(blocks.matrix(some.column("v").combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _gaps(blocks.matrix(b.column(1)), centres.value)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(d[np.arange(len(d)), own])], names=["doc_id", "v", "pivot", "gap"])

    own = stored(rows.mapInArrow(run, "doc_id long, v array<double>, pivot int, gap double"))
    radius, hands = np.full(len(centres.value), -np.inf), np.ones(len(centres.value), np.int64)
    for r in own.groupBy("pivot").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # a row for each pivot
        radius[r.pivot], hands[r.pivot] = r.radius, -(-r.n // hand_rows)
    return own, Parts(centres.value, radius, hands, eps)


_PACKS = pa.schema([("pivot", pa.int32()), ("hands", pa.array([0]).type), ("number", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("marks", pa.binary())])


def packs(rows: DataFrame, parts: Parts, halo: bool) -> DataFrame:
    """Blocks of (doc_id, v, pivot, gap, core) by pivot: of the points that belong to it, or of all that are sent to it."""
    shared = rows.sparkSession.sparkContext.broadcast(parts)

    def flush(held: list[tuple], number: int) -> pa.RecordBatch:
        of, ids, x, marks = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(of[order]) != 0)).tolist() + [len(of)]
        step, out = max(1, blocks.BLOCK_BYTES // (8 * x.shape[1])), []
        for a, b in zip(edges, edges[1:], strict=False):
            for lo in range(a, b, step):
                at = order[lo : min(lo + step, b)]
                out.append((int(of[at[0]]), int(shared.value.hands[of[at[0]]]), number + len(out), ids[at].tobytes(), x[at].tobytes(), marks[at].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PACKS, strict=True)], schema=_PACKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held, size, number = shared.value, [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, x, own, gap, marks = b.column(0).to_numpy(), blocks.matrix(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy(zero_copy_only=False)
            row, of = np.arange(len(ids)), own
            if halo:
                slack = 1e-6 * (1 + gap)[:, None]  # for the rounding of distances
                row, of = np.nonzero(_gaps(x, p.pivots) <= np.minimum(gap[:, None] + 2 * p.eps, p.radius[None, :] + p.eps) + slack)
            held.append((of, ids[row], x[row], marks[row]))
            size += len(row)
            if size >= FLUSH:
                yield flush(held, number)
                held, size, number = [], 0, number + 1
        if size:
            yield flush(held, number)

    return rows.select("doc_id", "v", "pivot", "gap", "core").mapInArrow(run, "pivot int, hands long, number long, ids binary, vectors binary, marks binary")


def met(rows: DataFrame, parts: Parts, meet: Callable, schema: pa.Schema, sql: str) -> DataFrame:
    """The columns of meet(ids, core marks of a pivot's own block, ids, marks of a block sent there, row and column of each
    pair within eps), for every two blocks of a pivot."""
    own = packs(rows, parts, False).select("pivot", F.pmod(F.xxhash64("ids"), F.col("hands")).alias("hand"), F.struct("ids", "vectors", "marks").alias("own"))
    sent = packs(rows, parts, True).select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hands") - 1)).alias("hand"), F.struct("ids", "vectors", "marks").alias("sent"))
    eps = parts.eps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, av, am, s, sv, sm in zip(*b.columns, strict=True):
                (ids, x), (others, y) = blocks.unpacked(a, av), blocks.unpacked(s, sv)
                columns = meet(ids, np.frombuffer(am.as_buffer(), bool), others, np.frombuffer(sm.as_buffer(), bool), *blocks.near(x, y, eps))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    pairs = sent.join(own.hint("merge"), ["pivot", "hand"])  # a merge join holds the right side of a key: a hand's own blocks, not all that is sent
    return pairs.select("own.ids", "own.vectors", "own.marks", *(F.col(f"sent.{c}").alias(f"sent_{c}") for c in ("ids", "vectors", "marks"))).mapInArrow(run, sql)


def tied(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) of the edges a[i] - b[i], for nodes that reach a smaller one."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        for side in (left, right):
            np.minimum.at(new, side, least)
            np.minimum.at(new, root[side], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root < np.arange(len(names))
    return names[moved], names[root[moved]]


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])
_TIES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("border", pa.bool_())])


def _count(ids: np.ndarray, _: np.ndarray, others: np.ndarray, __: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple:
    n = np.bincount(i, minlength=len(ids))
    return ids[n > 0], n[n > 0]


def _tie(ids: np.ndarray, core: np.ndarray, others: np.ndarray, other_core: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple:
    i, j = i[other_core[j]], j[other_core[j]]
    both = core[i]
    a, b = tied(ids[i[both]], others[j[both]])
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, i[~both], others[j[~both]])
    edge = np.flatnonzero(least < np.iinfo(np.int64).max)
    return np.concatenate((a, ids[edge])), np.concatenate((b, least[edge])), np.arange(len(a) + len(edge)) >= len(a)


def dbscan(points: DataFrame, eps: float, min_points: int = 5, pivots: int = PIVOTS, hand_rows: int = HAND_ROWS) -> DataFrame:
    """(doc_id, cluster) of (doc_id, v) with unique ids: the smallest core point of the cluster, -1 for noise and points without
    a vector; a border point joins its smallest core neighbour's cluster."""
    ship(points.sparkSession)
    rows, parts = partition(points, eps, pivots, hand_rows)
    if parts is None:
        return points.select("doc_id", F.lit(-1).cast("long").alias("cluster"))
    n = met(rows.withColumn("core", F.lit(False)), parts, _count, _COUNTS, "doc_id long, n long").groupBy("doc_id").agg(F.sum("n").alias("n"))
    core = stored(n.where(F.col("n") >= min_points).select("doc_id"))
    marked = stored(rows.join(core.withColumn("core", F.lit(True)), "doc_id", "left").withColumn("core", F.coalesce("core", F.lit(False))))
    ties = stored(met(marked, parts, _tie, _TIES, "a long, b long, border boolean").distinct())
    return _clusters(points, core, ties)


def _clusters(points: DataFrame, core: DataFrame, ties: DataFrame) -> DataFrame:
    found = components(ties.where("not border").unionByName(core.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), F.lit(False).alias("border"))).select("a", "b"))
    inner = stored(found.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")))
    edge = ties.where("border").groupBy("a").agg(F.min("b").alias("core")).join(inner.withColumnRenamed("doc_id", "core"), "core").select(F.col("a").alias("doc_id"), "cluster")
    return points.select("doc_id").join(inner.unionByName(edge), "doc_id", "left").select("doc_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def dbscan_scanned(points: DataFrame, eps: float, min_points: int = 5) -> DataFrame:
    """dbscan without pivots, by two scans of all pairs of blocks: for many dimensions, where halos reach every pivot. Blocks emit
    counts and ties, no pairs."""
    ship(points.sparkSession)
    rows = blocks.usable(points, "v").select("doc_id", F.col("v").cast("array<double>").alias("v"))
    core = stored(blocks.counts_within(rows, eps).where(F.col("n") >= min_points).select("doc_id"))
    if core.isEmpty():
        return points.select("doc_id", F.lit(-1).cast("long").alias("cluster"))
    marked = stored(rows.join(core.withColumn("core", F.lit(1)), "doc_id", "left").withColumn("core", F.coalesce("core", F.lit(0)).cast("long")))

    def meet(q: blocks.Block, m: blocks.Block, same: bool) -> tuple:
        i, j = blocks.near(q.v, m.v, eps)
        out = _tie(q.ids, q.labels > 0, m.ids, m.labels > 0, i, j)
        return out if same else blocks.joined(out, _tie(m.ids, m.labels > 0, q.ids, q.labels > 0, j, i))

    ties = stored(blocks.scan_once(marked, meet, _TIES, "a long, b long, border boolean", "core").distinct())
    return _clusters(points, core, ties)
