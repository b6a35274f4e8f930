"""K-means over many numbers of clusters, seeds and kinds at once: each iteration is one scan for all of them.

A set of centres is one (k, seed, spherical). Its first centres are the k points with the smallest hashes of seed and id. A scan
holds all centres that still move, k x dimensions numbers each and no more, and a task adds up, for each centre, the
points nearest to it; Spark adds the tasks' sums. The last scan also counts clusters against labels. Spherical sets compare
directions: points and centres have length 1, and so has the mean.

A centre that loses all points stays. Points without a vector are left out; equal distances go to the first centre.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import blocks
from lexloom.session import ship, stored

STEPS, TOLERANCE = 20, 1e-6


@dataclass
class Centres:
    k: int
    seed: int
    spherical: bool
    v: np.ndarray
    steps: int = 0
    moving: bool = True


def nearest(x: np.ndarray, c: Centres) -> tuple[np.ndarray, np.ndarray]:
    """(centre, squared distance) of each point; the distance from the point's direction for spherical sets."""
    x = blocks.unit(x) if c.spherical else x
    d = (x * x).sum(1)[:, None] + (c.v * c.v).sum(1)[None, :] - 2 * (x @ c.v.T)
    own = d.argmin(1)
    return own, ((x - c.v[own]) ** 2).sum(1)


def starts(points: DataFrame, sets: list[tuple[int, int, bool]]) -> list[Centres]:
    out = []
    for k, seed, spherical in sets:
        some = points.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").select("v").limit(k).toArrow()
        v = blocks.matrix(some.column("v").combine_chunks()) if some.num_rows else np.zeros((0, 0))
        out.append(Centres(k, seed, spherical, blocks.unit(v) if spherical else v, moving=len(v) > 0))
    return out


_SUMS_SQL = "which int, centre int, n long, gap double, total binary"


def _added(table: pa.Table) -> pa.Table:
    """The sum of the tasks' sums of one set, in an order of their own."""
    table = table.sort_by([("centre", "ascending"), ("n", "ascending"), ("gap", "ascending")])
    centre, n, gap = (table.column(c).to_numpy() for c in ("centre", "n", "gap"))
    total = np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in table.column("total")])
    head = np.flatnonzero(np.append(True, centre[1:] != centre[:-1]))
    sums = np.add.reduceat(total, head, axis=0)
    columns = [pa.array([table.column("which")[0].as_py()] * len(head), pa.int32()), pa.array(centre[head]), pa.array(np.add.reduceat(n, head)), pa.array(np.add.reduceat(gap, head)), pa.array([x.tobytes() for x in sums], pa.binary())]
    return pa.table(columns, names=["which", "centre", "n", "gap", "total"])


def step(points: DataFrame, sets: list[Centres]) -> None:
    """Move all centres that still move, in one scan."""
    shared = points.sparkSession.sparkContext.broadcast({i: c for i, c in enumerate(sets) if c.moving})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {i: [np.zeros(len(c.v), np.int64), np.zeros(len(c.v)), np.zeros(c.v.shape)] for i, c in shared.value.items()}
        for b in batches:
            if b.num_rows:
                x = blocks.matrix(b.column(0))
                for i, c in shared.value.items():
                    own, gap = nearest(x, c)
                    held[i][0] += np.bincount(own, minlength=len(c.v))
                    held[i][1] += np.bincount(own, gap, len(c.v))
                    np.add.at(held[i][2], own, blocks.unit(x) if c.spherical else x)
        rows = [(i, j, int(n), float(g), t.tobytes()) for i, (ns, gaps, totals) in held.items() for j, (n, g, t) in enumerate(zip(ns, gaps, totals, strict=True)) if n]
        if rows:
            types = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["which", "centre", "n", "gap", "total"])

    rows = points.select("v").mapInArrow(run, _SUMS_SQL).groupBy("which").applyInArrow(_added, _SUMS_SQL).collect()  # a row for each centre
    new = {i: c.v.copy() for i, c in enumerate(sets) if c.moving}
    for r in rows:
        new[r.which][r.centre] = np.frombuffer(bytes(r.total), np.float64) / r.n
    for i, v in new.items():
        c = sets[i]
        v = blocks.unit(v) if c.spherical else v
        c.moving, c.v, c.steps = bool(np.abs(v - c.v).max() > TOLERANCE), v, c.steps + 1


def fit(points: DataFrame, sets: list[tuple[int, int, bool]], steps: int = STEPS) -> list[Centres]:
    """The centres of all sets over (doc_id, v)."""
    ship(points.sparkSession)
    points = blocks.usable(points, "v")
    out = starts(points, sets)
    for _ in range(steps):
        if not any(c.moving for c in out):
            break
        step(points, out)
    return out


def assigned(points: DataFrame, sets: list[Centres]) -> DataFrame:
    """(which, doc_id, cluster, gap, label): each point's centre in each set, from one scan; label is the points' own, if they have one."""
    shared = points.sparkSession.sparkContext.broadcast(sets)
    rows = blocks.usable(points, "v")
    rows = rows.select("doc_id", "v", (F.col("label") if "label" in points.columns else F.lit(None)).cast("long").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = blocks.matrix(b.column(1))
                for i, c in enumerate(shared.value):
                    own, gap = nearest(x, c)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(x), pa.int32()), b.column(0), pa.array(own, pa.int32()), pa.array(gap), b.column(2)], names=["which", "doc_id", "cluster", "gap", "label"])

    return rows.mapInArrow(run, "which int, doc_id long, cluster int, gap double, label long")


def table(points: DataFrame, sets: list[tuple[int, int, bool]], steps: int = STEPS) -> DataFrame:
    """(k, seed, spherical, clusters, inertia, purity, nmi, rand) of each set over (doc_id, v, label): a row a set."""
    spark = points.sparkSession
    fitted = fit(points, sets, steps)
    t = stored(assigned(points, fitted).groupBy("which", "cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("gap").alias("gap")))
    a = t.groupBy("which", "cluster").agg(F.sum("n").alias("a"), F.max("n").alias("most"), F.sum("gap").alias("gap"))
    b = t.groupBy("which", "label").agg(F.sum("n").alias("b"))
    whole = a.groupBy("which").agg(F.sum("a").alias("t"), F.sum("most").alias("pure"), F.sum("gap").alias("inertia"), F.count(F.lit(1)).alias("clusters"), F.sum(F.col("a") * F.col("a")).alias("sa"), F.sum(F.col("a") * F.log("a")).alias("la"))
    sides = b.groupBy("which").agg(F.sum(F.col("b") * F.col("b")).alias("sb"), F.sum(F.col("b") * F.log("b")).alias("lb"))
    both = t.join(a.select("which", "cluster", "a"), ["which", "cluster"]).join(b, ["which", "label"]).groupBy("which").agg(F.sum(F.col("n") * F.col("n")).alias("sn"), F.sum(F.col("n") * F.log(F.col("n") / F.col("a") / F.col("b"))).alias("ln"))
    x = whole.join(sides, "which").join(both, "which")
    n, h = F.col("t"), lambda c: F.log("t") - F.col(c) / F.col("t")
    nmi = F.when(h("la") + h("lb") > 1e-12, 2 * (F.col("ln") / n + F.log("t")) / (h("la") + h("lb"))).otherwise(1.0)
    names = spark.createDataFrame([(i, c.k, c.seed, c.spherical) for i, c in enumerate(fitted)], "which int, k int, seed int, spherical boolean")
    return names.join(x, "which").select("k", "seed", "spherical", "clusters", F.round("inertia", 4).alias("inertia"), F.round(F.col("pure") / n, 6).alias("purity"), F.round(nmi, 6).alias("nmi"), F.round((n * n - F.col("sa") - F.col("sb") + 2 * F.col("sn")) / (n * n), 6).alias("rand"))
