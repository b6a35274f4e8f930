"""Incremental substring dedup with a log-structured index of window fingerprints.

Documents arrive in batches in the order of their ids. A batch's windows of `width` words are fingerprinted and
merge-joined, bucket by bucket, with the sorted immutable runs that earlier batches wrote. A word goes if a window over
it also starts in a document with a smaller id.

An entry of a run stands for a region: neighbouring windows that share a content-defined anchor. It holds two
64-bit hashes of the region's words that rest on independent hashes of the words' bytes, so that a match of the first is verified by
the second. A region equal to that of a smaller document is repeated as a whole. Where an anchor has several different
regions, the windows of the batch's and the history's regions are fingerprinted one by one from the stored documents and
compared (`resolve`). Each batch adds one sorted run with the regions that are new; when more than `max_runs` have gathered they are
merged into one (compaction), which keeps of each region the smallest document. Runs are stored in buckets, so that
neither a merge-join nor a compaction shuffles them.

Equal regions merge inside each task before the shuffle. Nothing but counts reaches the driver.

Defined results: a null text has no words; texts of fewer words than `width` stay; very long texts are hashed in stretches; rows that share an id count as
one document and each row has the removed ranges applied; a null id orders last; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.anchors import eights, regions
from lexloom.llm.common import SPACES, RunHash, Words, attach, batch, buckets_for, chunks, covered, ship, stored_by
from lexloom.llm.jaccard_join import packed, unpacked
from lexloom.llm.suffix_dedup import NULL_ID, apply_ranges, bucket_of, keyed, rows_with_ranges

WIDTH, GRAM = 50, 12
BATCHES, MAX_RUNS = 4, 2
HELD = 200_000
_U = np.uint64

_NAMES = ("anchor", "content", "check", "doc", "start", "more")
_TYPES = [_U, _U, _U, np.int64, np.int32, np.int32]
_RUN = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in _NAMES)])
_RUN_SQL = "bucket int, " + ", ".join(f"{n} binary" for n in _NAMES)


def _first_of_each(*keys: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    head = np.ones(len(keys[0]), bool)
    head[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return head


def _sorted(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Entries in the order of a run: anchor, content, check, document, place."""
    order = np.lexsort(cols[4::-1])
    return [c[order] for c in cols]


def fingerprints(docs: DataFrame, buckets: int, width: int, gram: int) -> DataFrame:
    """Packed region entries by anchor bucket. Of equal regions in one stretch of a task all of the smallest document's
    come as entries (more >= 0), and the others as ranges already known to be repeated (more < 0: minus the length)."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        columns = _sorted([np.concatenate(x) for x in zip(*held, strict=True)])
        anchor, content, check, doc, start, more = columns
        head = _first_of_each(anchor, content, check)
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = doc != doc[lead]
        spread = anchor.copy()
        spread[later] = doc[later].astype(_U) << _U(33)
        more = np.where(later, -(more + width), more)
        yield from packed(_RUN, bucket_of(spread, buckets), *(c.astype(t, copy=False) for c, t in zip((anchor, content, check, doc, start, more), _TYPES, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for ids, texts in chunks(batches):
            w = Words(texts, SPACES, lower=False, check=True)
            for r in regions(lambda lo, hi, w=w: (eights(w.hash[lo:hi]), eights(w.check[lo:hi])), w.first, width, gram):
                held.append([r.anchor, r.content, r.check, np.array(ids, np.int64)[r.text], r.start, r.more])
                size += len(r.anchor)
                if size > HELD:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return docs.mapInArrow(run, _RUN_SQL)


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Two sorted runs as one, by binary search of the shorter one's keys in the longer, and which rows are b's."""
    if len(a[0]) < len(b[0]):
        cols, of_b = _merged(b, a)
        return cols, ~of_b

    def keys(cols: list[np.ndarray]) -> np.ndarray:
        wide = np.column_stack([c.view(_U) if c.dtype == np.int64 else c.astype(_U) for c in cols[:5]])
        return np.ascontiguousarray(wide.astype(">u8")).view("S40").ravel() if len(wide) else np.zeros(0, "S40")

    low = np.searchsorted(a[0], b[0]), np.searchsorted(a[0], b[0], side="right")
    at = low[0].copy()
    clash = np.flatnonzero(low[1] > low[0])  # only keys whose anchor is in both runs are compared further
    if len(clash):
        rows = np.flatnonzero(covered(len(a[0]), low[0][clash], low[1][clash]))
        every = np.concatenate((keys([c[rows] for c in a]), keys([c[clash] for c in b])))
        order = np.argsort(every, kind="stable")
        from_a = order < len(rows)
        rank = np.empty(len(every), np.int64)
        rank[order] = np.cumsum(from_a)
        smaller = rank[len(rows) :]  # rows of a, among those compared, that come first
        at[clash] = np.where(smaller > 0, rows[np.maximum(smaller - 1, 0)] + 1, 0)
        at[clash] = np.maximum(at[clash], low[0][clash])
    spot = at + np.arange(len(at))
    of_b = np.zeros(len(a[0]) + len(at), bool)
    of_b[spot] = True
    out = []
    for x, y in zip(a, b, strict=True):
        c = np.empty(len(of_b), x.dtype)
        c[of_b], c[~of_b] = y, x
        out.append(c)
    return out, of_b


def _entries(table: pa.Table) -> list[list[np.ndarray]]:
    """The runs of a bucket: each row of a run's table is sorted in itself."""
    return [[np.frombuffer(table.column(n)[i].as_py(), t) for n, t in zip(_NAMES, _TYPES, strict=True)] for i in range(table.num_rows)]


def _one(runs: list[list[np.ndarray]]) -> list[np.ndarray]:
    runs = runs or [[np.zeros(0, t) for t in _TYPES]]
    while len(runs) > 1:
        runs = [_merged(runs[i], runs[i + 1])[0] if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


_KIND_NEW, _KIND_GONE, _KIND_ASK = 0, 1, 2
_MERGED = pa.schema([("kind", pa.int32()), *_RUN])


def merge_join(runs: DataFrame | None, fresh: DataFrame, width: int) -> DataFrame:
    """Merge the sorted runs of each bucket with the batch's entries.

    Gives by kind: entries for the batch's run, ranges of the batch that are repeated, and the regions (of batch and
    history) whose windows have to be compared one by one.
    """
    history = fresh.sparkSession.createDataFrame([], _RUN_SQL) if runs is None else runs

    def run(old: pa.Table, young: pa.Table) -> pa.Table:
        if not young.num_rows:
            return pa.Table.from_batches([], _MERGED)
        number = young.column("bucket")[0].as_py()
        cols = unpacked(young, _TYPES)
        known = cols[5] < 0
        gone = [c[known] for c in cols]
        gone[5] = -gone[5]
        cols, new = _merged(_one(_entries(old)), _sorted([c[~known] for c in cols]))
        anchor, content, check, doc, start, more = cols
        head = _first_of_each(anchor, content, check)
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (doc != doc[lead]) & new
        gone = [np.concatenate((g, c[later])) for g, c in zip(gone, (anchor, content, check, doc, start, more + width), strict=True)]
        firsts = np.flatnonzero(head)
        a = anchor[firsts]
        begin = np.flatnonzero(_first_of_each(a))
        count = np.diff(np.append(begin, len(a)))
        has_new = np.add.reduceat(new[firsts].astype(np.int64), begin) if len(begin) else begin
        several = np.zeros(len(head), bool)
        several[firsts] = np.repeat((count > 1) & (has_new > 0), count)
        asked = np.flatnonzero(several[lead] & (head | new & (doc == doc[lead])))  # each copy in the smallest document
        fresh_rows = np.flatnonzero(head & new)
        out = []
        for kind, rows in ((_KIND_NEW, [c[fresh_rows] for c in cols]), (_KIND_GONE, gone), (_KIND_ASK, [c[asked] for c in cols])):
            if len(rows[0]):
                (b,) = packed(_RUN, np.full(len(rows[0]), number, np.int32), *(r.astype(t, copy=False) for r, t in zip(rows, _TYPES, strict=True)))
                out.append(pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), *b.columns], schema=_MERGED))
        return pa.Table.from_batches(out, _MERGED)

    return history.groupBy("bucket").cogroup(fresh.groupBy("bucket")).applyInArrow(run, "kind int, " + _RUN_SQL)


def compact(runs: DataFrame) -> DataFrame:
    """Merge the runs of each bucket into one sorted run; of equal regions the smallest document's entry stays."""

    def run(table: pa.Table) -> pa.Table:
        cols = _one(_entries(table))
        keep = _first_of_each(cols[0], cols[1], cols[2])
        number = np.full(int(keep.sum()), table.column("bucket")[0].as_py(), np.int32)
        return pa.Table.from_batches(packed(_RUN, number, *(c[keep] for c in cols)), _RUN)

    return runs.groupBy("bucket").applyInArrow(run, _RUN_SQL)


_RANGES_SQL = "doc_id long, start binary, end binary"


def per_document(rows: DataFrame, extra: int = 0) -> DataFrame:
    """(doc_id, start, end) of packed region rows, end being start + more + extra."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.binary()), ("end", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, start, more = (np.frombuffer(b"".join(c.to_pylist()), t) for c, t in zip(b.columns, (np.int64, np.int32, np.int32), strict=True))
            yield from packed(schema, doc, start, start + more + np.int32(extra))

    return rows.select("doc", "start", "more").mapInArrow(run, _RANGES_SQL)


_WINDOWS = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("content", "check", "doc", "start"))])


def compare_windows(docs: DataFrame, asked: DataFrame, buckets: int, width: int) -> DataFrame:
    """Ranges of windows that also start in a smaller document, among the regions asked for."""
    ends = asked.groupBy("doc_id").agg(F.listagg("start").alias("starts"), F.listagg("end").alias("ends"))
    texts = attach(docs, ends, "doc_id", "inner").select("doc_id", "text", "starts", "ends")

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        content, check, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from packed(_WINDOWS, bucket_of(content, buckets), content, check, doc, start)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc, text, starts, ends in rows_with_ranges(b):
                w = Words([text], SPACES, lower=False, check=True)
                ok = ends + width - 1 <= len(w)
                starts, ends = starts[ok], ends[ok]
                if not len(starts):
                    continue
                each = np.flatnonzero(covered(len(w), starts, ends))
                one, two = (RunHash(h, (width, width)) for h in (w.hash, w.check))
                held.append([one(each, each + width), two(each, each + width), np.full(len(each), doc), each.astype(np.int32)])
                size += len(each)
                if size > HELD:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def compare(table: pa.Table) -> pa.Table:
        content, check, doc, start = unpacked(table, [_U, _U, np.int64, np.int32])
        order = np.lexsort((doc, check, content))
        content, check, doc, start = (c[order] for c in (content, check, doc, start))
        head = _first_of_each(content, check)
        later = doc != doc[np.flatnonzero(head)[np.cumsum(head) - 1]]
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.binary()), ("end", pa.binary())])
        return pa.Table.from_batches(packed(schema, doc[later], start[later], start[later] + np.int32(width)), schema)

    windows = texts.mapInArrow(expand, "bucket int, content binary, check binary, doc binary, start binary")
    return windows.groupBy("bucket").applyInArrow(compare, _RANGES_SQL)


class FingerprintIndex:
    """The runs so far. `ingest` takes the next batch (ids above those seen) and gives its ranges that are repeated as whole
    regions; `resolve` compares the windows that were asked for since the last call, given the texts seen so far."""

    def __init__(self, buckets: int, width: int = WIDTH, gram: int = GRAM, max_runs: int = MAX_RUNS):
        self.buckets, self.width, self.gram, self.max_runs = buckets, width, gram, max_runs
        self.runs: list[DataFrame] = []
        self.asked: list[DataFrame] = []

    def _history(self) -> DataFrame | None:
        out = None
        for r in self.runs:
            out = r if out is None else out.unionByName(r)
        return out

    def ingest(self, docs: DataFrame) -> DataFrame:
        if len(self.runs) > self.max_runs:
            self.runs = [stored_by(compact(self._history()).withColumn("kind", F.lit(_KIND_NEW)), "bucket", self.buckets, "kind").drop("kind")]
        merged = stored_by(merge_join(self._history(), fingerprints(docs, self.buckets, self.width, self.gram), self.width), "bucket", self.buckets, "kind")
        self.runs.append(merged.where(f"kind = {_KIND_NEW}").drop("kind"))
        self.asked.append(per_document(merged.where(f"kind = {_KIND_ASK}"), extra=1))  # more + 1 window starts
        return per_document(merged.where(f"kind = {_KIND_GONE}"))

    def resolve(self, seen: DataFrame) -> DataFrame | None:
        asked, self.asked = self.asked, []
        every = None
        for a in asked:
            every = a if every is None else every.unionByName(a)
        return None if every is None else compare_windows(seen, every, self.buckets, self.width)


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """The documents in n batches by ranges of their ids, of about equal size."""
    cuts = sorted({int(x) for x in docs.where(F.col("doc_id") < NULL_ID).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.01)}) if n > 1 else []
    bounds = [None, *cuts, None]
    out = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = docs
        if lo is not None:
            part = part.where(F.col("doc_id") > lo)
        if hi is not None:
            part = part.where(F.col("doc_id") <= hi)
        out.append(part)
    return out


def removed_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, max_runs: int = MAX_RUNS) -> DataFrame:
    ship(docs.sparkSession)
    index = FingerprintIndex(buckets_for(docs), width, gram, max_runs)
    rows, gone = keyed(docs), None
    for part in batches_of(rows, batches):
        found = index.ingest(part)
        gone = found if gone is None else gone.unionByName(found)
    gone = gone.unionByName(index.resolve(rows))
    return gone.groupBy("doc_id").agg(F.listagg("start").alias("starts"), F.listagg("end").alias("ends"))


def deduplicate(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, max_runs: int = MAX_RUNS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document; with_text adds the kept words joined by a space."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_text)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            out = []
            for doc, text, starts, ends in rows_with_ranges(b):
                words = text.split()
                gone = covered(len(words), np.minimum(starts, len(words)), np.minimum(ends, len(words)))
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone)] if len(starts) else words)
                out.append((doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept)[: len(schema)])
            yield batch(schema, *(zip(*out, strict=True) if out else [[]] * len(schema)))

    return apply_ranges(docs, removed_ranges(docs, width, gram, batches, max_runs), run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * with_text)
