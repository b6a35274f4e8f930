"""Benchmark decontamination with a distributed positional inverted index.

`build_index` stores training token postings, once for any benchmark: the documents are cut into shards and each shard becomes one row with,
for each of its terms, the sorted positions where it occurs. A posting list holds places in the shard's word sequence, so
that one number gives document and position, and a gap is left between documents so that no phrase crosses them.
`search` takes the benchmark in blocks of at most `block_terms` words. For each test phrase it starts from the posting
list of the term that is rarest in the whole training corpus, and intersects the lists of the others, each shifted by
its offset in the phrase, from the rarest on. What is left are exact phrase matches; a proximity match needs the
phrase's rarest terms only within `slop` words of each other, in any order.

The index never leaves its shard and is written to the shared folder; every block of the benchmark searches the same
one. Each block that is sent to the executors has a fixed bound.

Defined results: null and empty texts have no words and no matches; an item without words is ignored, null item ids
read "null" (as would an item of that name); a very long text is a shard of its own; repeated document rows each get their row; repeated items count once; empty tables give no matches;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import NOT_ALNUM, Words, as_bytes, batch, chunks, covered, sequence_keys, ship, stored

PHRASE, SHARD_BYTES, BLOCK_TERMS = 13, 1 << 20, 200_000
SLOP, PROXIMITY_TERMS = 26, 4

_INDEX = pa.schema([("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("first", pa.binary()), ("terms", pa.binary()), ("offsets", pa.binary()), ("places", pa.binary())])
_INDEX_SQL = "doc_ids array<long>, keys array<long>, first binary, terms binary, offsets binary, places binary"
_HITS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
_HITS_SQL = "doc_id long, key long, n_words long, items array<string>, near_items array<string>, starts array<long>, ends array<long>"


def benchmark_blocks(benchmark: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The items' word hashes, streamed to the driver and cut into blocks of at most block_terms words (or one item)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    block, size = [], 0
    for r in rows.toLocalIterator():
        w = Words([bytes(r.text or b"")], NOT_ALNUM, lower=True)
        if not len(w):
            continue
        if block and size + len(w) > block_terms:
            yield block
            block, size = [], 0
        block.append((r.item_id if r.item_id is not None else "null", w.hash))
        size += len(w)
    if block:
        yield block


def build_index(docs: DataFrame) -> DataFrame:
    """One row per shard: its documents, where each begins, and the postings of its terms in order of their hashes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, SHARD_BYTES):
            w = Words(texts, NOT_ALNUM, lower=True)
            counts = np.diff(w.first)
            first = np.concatenate(([0], np.cumsum(counts + 1)))  # a free place after each document
            place = np.arange(len(w)) + np.repeat(np.arange(len(ids)), counts)
            order = np.argsort(w.hash, kind="stable")
            terms = w.hash[order]
            start = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
            blobs = first.astype(np.int64), terms[start], np.append(start, len(terms)).astype(np.int32), place[order].astype(np.int32)
            keys = sequence_keys(w.hash, w.first).view(np.int64)
            yield batch(_INDEX, [ids], [keys], *([x.tobytes()] for x in blobs))

    return stored(as_bytes(docs).mapInArrow(run, _INDEX_SQL))


def _present(vocabulary: np.ndarray, terms: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(which terms of the sorted vocabulary a shard has, where in the shard's)."""
    own = np.frombuffer(terms, np.uint64)
    at = np.searchsorted(own, vocabulary)
    at[at == len(own)] = 0
    hit = np.flatnonzero(own[at] == vocabulary) if len(own) else np.zeros(0, np.int64)
    return hit, at[hit]


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Corpus frequency of each term of the vocabulary, from the posting lists' lengths."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for terms, offsets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hit, at = _present(shared.value, terms)
                total[hit] += np.diff(np.frombuffer(offsets, np.int32))[at]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in index.select("terms", "offsets").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.term] = r.n
    return out


def _phrases(block: list[tuple[str, np.ndarray]], vocabulary: np.ndarray, counts: np.ndarray, width: int) -> list[tuple[str, int, list[tuple[int, int]]]]:
    """(item, length, [(term, offset) from the rarest on]) of each distinct phrase of an item."""
    out = []
    for item, words in block:
        terms = np.searchsorted(vocabulary, words)
        n = min(width, len(terms))
        seen = set()
        for s in range(len(terms) - n + 1):
            t = terms[s : s + n]
            if (key := t.tobytes()) not in seen:
                seen.add(key)
                out.append((item, n, sorted(((int(x), i) for i, x in enumerate(t)), key=lambda p: (counts[p[0]], p[1]))))
    return out


def _phrase_starts(terms: list[tuple[int, int]], lists: dict[int, np.ndarray]) -> np.ndarray:
    """Places where the phrase begins: offset-adjusted lists intersected from the rarest term on."""
    start = None
    for t, i in terms:
        own = lists.get(t)
        if own is None:
            return np.zeros(0, np.int64)
        if start is None:
            start = own - i
        else:
            at = np.searchsorted(own, start + i)
            start = start[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == start + i)]
        if not len(start):
            break
    return start


def _near_docs(terms: list[int], lists: dict[int, np.ndarray], first: np.ndarray, slop: int) -> list[int]:
    """Documents where the other terms occur at most slop words from an occurrence of the first one."""
    places = lists[terms[0]]
    doc = np.searchsorted(first, places, side="right") - 1
    for t in terms[1:]:
        own = lists.get(t)
        if own is None or not len(places):
            return []
        low, high = np.maximum(places - slop, first[doc]), np.minimum(places + slop, first[doc + 1] - 2)
        at = np.searchsorted(own, low)
        ok = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= high)
        places, doc = places[ok], doc[ok]
    return np.unique(doc).tolist()


def search(index: DataFrame, block: list, vocabulary: np.ndarray, counts: np.ndarray, width: int = PHRASE, slop: int = SLOP, terms_near: int = PROXIMITY_TERMS, finish=None) -> DataFrame:
    """A row per document: items with an exact phrase match, items with a proximity match, and the matched word ranges;
    or what `finish` (a function of batches of such rows, and its schema) makes of them in the same task."""
    shared = index.sparkSession.sparkContext.broadcast((vocabulary, _phrases(block, vocabulary, counts, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, phrases = shared.value
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids = row["doc_ids"]
                first = np.frombuffer(row["first"], np.int64)
                offsets, places = np.frombuffer(row["offsets"], np.int32), np.frombuffer(row["places"], np.int32)
                lists = {t: places[offsets[k] : offsets[k + 1]] for t, k in zip(*(x.tolist() for x in _present(known, row["terms"])), strict=True)}
                found: list[dict] = [{} for _ in ids]
                for item, n, terms in phrases:
                    if terms[0][0] not in lists:
                        continue
                    if slop:
                        for d in _near_docs(list(dict.fromkeys(t for t, _ in terms))[:terms_near], lists, first, slop):
                            found[d].setdefault(item, [])
                    start = _phrase_starts(terms, lists)
                    at = np.searchsorted(first, start, side="right") - 1
                    for d, s in zip(at.tolist(), (start - first[at]).tolist(), strict=True):
                        found[d].setdefault(item, []).append((s, s + n))
                spans = [sorted(x for v in f.values() for x in v) for f in found]
                yield batch(_HITS, ids, row["keys"], np.diff(first) - 1, [sorted(k for k, v in f.items() if v) for f in found], [sorted(f) for f in found], [[x[0] for x in s] for s in spans], [[x[1] for x in s] for s in spans])

    if finish:
        return index.mapInArrow(lambda batches: finish[0](run(batches)), finish[1])
    return index.mapInArrow(run, _HITS_SQL)


def matches(docs: DataFrame, benchmark: DataFrame, width: int = PHRASE, slop: int = SLOP, block_terms: int = BLOCK_TERMS, finish=None) -> DataFrame:
    """doc_id, n_words, items, near_items and matched word ranges of each document, over all blocks of the benchmark; or what
    `finish` makes of them."""
    index, blocks = build_index(docs), list(itertools.islice(stream := benchmark_blocks(benchmark, block_terms), 2))
    if len(blocks) < 2:  # one block: each row is whole in its task
        block = blocks[0] if blocks else []
        vocabulary = np.unique(np.concatenate([w for _, w in block])) if block else np.zeros(0, np.uint64)
        return search(index, block, vocabulary, term_counts(index, vocabulary), width, slop, finish=finish)
    parts = []
    for block in itertools.chain(blocks, stream):
        vocabulary = np.unique(np.concatenate([w for _, w in block]))
        parts.append(search(index, block, vocabulary, term_counts(index, vocabulary), width, slop))
    # a document's rows of all blocks meet by its id and the hash of its words; equal rows are numbered
    ranked = [p.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("n_words"))) for p in parts]
    every = ranked[0]
    for p in ranked[1:]:
        every = every.unionByName(p)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    whole = every.groupBy("doc_id", "key", "n_words", "_copy").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")), flat("starts"), flat("ends")).drop("_copy").select(*_HITS.names)
    return whole.mapInArrow(*finish) if finish else whole


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_share: int = 20, **options) -> DataFrame:
    """The contract's row of each document: hit words, items, digest and verdict; n_near_items counts proximity matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                hit = int(covered(r["n_words"], np.array(r["starts"], np.int64), np.array(r["ends"], np.int64)).sum()) if r["starts"] else 0
                digest = hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
                out.append((r["doc_id"], r["n_words"], hit, len(r["items"]), digest, hit > 0 and min_share * hit >= r["n_words"], len(r["near_items"])))
            yield batch(_OUT, *(zip(*out, strict=True) if out else [[]] * len(_OUT)))

    sql = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long"
    return matches(docs, benchmark, **options, finish=(run, sql))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("n_near_items", pa.int64())])
