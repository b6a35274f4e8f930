"""Removal of repeated substrings by longest-previous-factor arrays.

A byte goes if it lies in a `width`-byte string that also starts earlier: in a document with a smaller id, or earlier
in the same one. Suffixes of the whole corpus are never sorted at once; content-defined anchors split the work:

1. Each region (windows with one anchor) is compared with the other regions of its anchor by two independent 64-bit
   hashes. Regions that are equal to an earlier one are repeated as a whole, which settles the inside of every copy.
2. Where an anchor has several different regions, at the borders of copies and in near copies, the bytes of its distinct
   regions are brought together in blocks. A suffix array over a block is built by doubling, with the longest common
   prefix of neighbours from the ranks of each doubling step. Among the suffixes of `width` bytes or more (others can't
   matter) the previous and next smaller positions in suffix order give each one's longest previous factor; windows whose factor has `width` bytes or more go.
   An anchor with very many different regions (at the borders of a very common passage) is spread by the hashes of its windows.

Equal regions are merged inside each task before the shuffle, so copies of one text by the million arrive as one
row from each task. Strings are judged on the input, never on what is left. The texts move twice, by document id: to
cut out the regions that are asked for, and to apply the ranges. Buckets are numbered by the bytes of the whole table.

Defined results: a null text is empty; texts shorter than `width` stay; very long texts are hashed in stretches; rows
that share an id count as copies of one document, in which a string at the same offset is no repetition, and each row
has the removed ranges applied; a null id orders last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.anchors import EIGHT, folded, regions
from lexloom.llm.common import as_bytes, attach, batch, buckets_for, chunks, covered, mixed, ship, stored
from lexloom.llm.jaccard_join import packed, unpacked

WIDTH, GRAM = 100, 32
HOT = 4096
HELD, BLOCK = 200_000, 1 << 20
NULL_ID = (1 << 63) - 1
_U = np.uint64

_TYPES = [_U, _U, _U, np.int64, np.int32, np.int32]
_POSTS = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("anchor", "content", "check", "doc", "start", "more"))])
_POSTS_SQL = "bucket int, anchor binary, content binary, check binary, doc binary, start binary, more binary"
_RANGES = {"gone": (np.int32, np.int32), "ask": (np.int32, np.int32, np.int8, _U)}
_NAMES = ("gone_start", "gone_end", "ask_start", "ask_more", "ask_hot", "ask_anchor")
_OUT = pa.schema([("doc_id", pa.int64()), *((n, pa.binary()) for n in _NAMES)])
_OUT_SQL = "doc_id long, " + ", ".join(f"{n} binary" for n in _NAMES)


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> _U(33)) % _U(n)).astype(np.int32)


def keyed(docs: DataFrame) -> DataFrame:
    """(key, text bytes): the id, with null ids last."""
    return as_bytes(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID))))


def byte_blocks(texts: list[bytes]):
    """blocks(lo, hi) of the texts' bytes one after another, as `regions` takes them, and where each text begins."""
    data = b"".join(texts)

    def blocks(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        eight = np.ndarray((hi - lo - EIGHT + 1,), "<u8", data, lo, (1,)).astype(_U)
        return eight, mixed(eight)

    return blocks, np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def repeats(content: np.ndarray, check: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of its content, repeated): rows by content and place, and which have an earlier place with that content."""
    order = np.lexsort((start, doc, check, content))
    c, k, d, s = (x[order] for x in (content, check, doc, start))
    head = np.append(True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])) if len(c) else np.zeros(0, bool)
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    return order, head, (d != d[lead]) | (s != s[lead])


def post_regions(docs: DataFrame, buckets: int, width: int, gram: int) -> DataFrame:
    """Packed regions by anchor; rows with more < 0 are ranges already known to be repeated (-more is their length)."""

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        anchor, content, check, doc, start, more = (np.concatenate(x) for x in zip(*held, strict=True))
        order, _, again = repeats(content, check, doc, start)
        rows = order[again]
        more[rows] = -(more[rows] + width)
        spread = anchor.copy()
        spread[rows] = doc[rows].astype(_U) << _U(33)
        yield from packed(_POSTS, bucket_of(spread, buckets), anchor, content, check, doc, start.astype(np.int32), more.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for ids, texts in chunks(batches):
            blocks, first = byte_blocks(texts)
            for r in regions(blocks, first, width, gram):
                held.append([r.anchor, r.content, r.check, np.array([NULL_ID if i is None else i for i in ids], np.int64)[r.text], r.start, r.more])
                size += len(r.anchor)
                if size > HELD:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return keyed(docs).mapInArrow(run, _POSTS_SQL)


def merged_ranges(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Ranges in order of document and place, those that touch made one: (doc, (rows, start, end))."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return doc, (order, start, end)
    number = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    base = number * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    head = np.append(True, (start + base)[1:] > reach[:-1])
    last = np.append(np.flatnonzero(head)[1:] - 1, len(doc) - 1)
    return doc[head], (order[head], start[head], (reach - base)[last])


def by_document(doc: np.ndarray, gone: tuple, ask: tuple | None = None) -> pa.Table:
    """A row for each document with the packed ranges gone (rows, start, end) and asked for (rows, start, more, hot, anchor)."""
    ask = ask or (np.zeros(0, np.int64),) * 5
    rows = np.concatenate((gone[0], ask[0]))
    if not len(rows):
        return pa.Table.from_batches([], _OUT)
    ids = np.unique(doc[rows])
    d, (_, *ranges) = merged_ranges(doc[gone[0]], *gone[1:])
    order = np.argsort(doc[ask[0]], kind="stable")
    columns = []
    for kind, docs, values in (("gone", d, ranges), ("ask", doc[ask[0]][order], [x[order] for x in ask[1:]])):
        lo, hi = np.searchsorted(docs, ids), np.searchsorted(docs, ids, side="right")
        for v, t in zip(values, _RANGES[kind], strict=True):
            v = v.astype(t)
            columns.append([v[a:b].tobytes() for a, b in zip(lo, hi, strict=True)])
    return pa.Table.from_batches([batch(_OUT, ids, *columns)], _OUT)


def compare_regions(posts: DataFrame, width: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        anchor, content, check, doc, start, more = unpacked(table, _TYPES)
        known = np.flatnonzero(more < 0)
        live = np.flatnonzero(more >= 0)
        order, head, again = repeats(content[live], check[live], doc[live], start[live])
        order = live[order]
        gone, lead = order[again], order[head]
        lead = lead[np.argsort(anchor[lead], kind="stable")]
        a = anchor[lead]
        begin = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(a)))
        size = np.repeat(size, size)
        ask, hot = lead[size > 1], (size > HOT)[size > 1]
        rows = np.concatenate((known, gone))
        length = np.concatenate((-more[known], more[gone] + width))
        return by_document(doc, (rows, start[rows], start[rows] + length), (ask, start[ask], more[ask], hot, anchor[ask]))

    return posts.groupBy("bucket").applyInArrow(run, _OUT_SQL)


_CONTEXT = pa.schema([("bucket", pa.int32()), ("anchor", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("more", pa.int32()), ("bytes", pa.binary())])


def contexts(docs: DataFrame, asked: DataFrame, buckets: int, width: int) -> DataFrame:
    """The bytes of each region asked for, by anchor; of a hot anchor each window by its own hash."""
    names = ("ask_start", "ask_more", "ask_hot", "ask_anchor")
    texts = attach(keyed(docs), asked, "doc_id", "inner").select("doc_id", "text", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc, text, *asks = (c[i].as_py() for c in b.columns)
                text = text or b""
                start, more, hot, anchor = (np.frombuffer(x, t) for x, t in zip(asks, _RANGES["ask"], strict=True))
                fits = start.astype(np.int64) + more + width <= len(text)
                cold, warm = np.flatnonzero(fits & (hot == 0)), np.flatnonzero(fits & (hot != 0))
                rows = [anchor[cold], start[cold].astype(np.int64), more[cold]]
                pieces = [text[s : s + m + width] for s, m in zip(start[cold].tolist(), more[cold].tolist(), strict=True)]
                for s, m in zip(start[warm].tolist(), more[warm].tolist(), strict=True):
                    each = np.arange(m + 1)
                    own = folded(byte_blocks([text[s : s + m + width]])[0](0, m + width)[0], each, each + width, width)
                    rows = [np.concatenate(x) for x in zip(rows, (own, s + each, np.zeros(m + 1, np.int32)), strict=True)]
                    pieces += [text[x : x + width] for x in range(s, s + m + 1)]
                if pieces:
                    yield batch(_CONTEXT, bucket_of(rows[0], buckets), rows[0].view(np.int64), np.full(len(pieces), doc), rows[1], rows[2], pieces)

    return texts.mapInArrow(run, "bucket int, anchor long, doc long, start long, more int, bytes binary")


_GROUP = 4  # symbols of 9 bits in the first key: a byte plus one, or 0 beyond the piece's end


def _order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, which keys in order differ from the one before); keys of `bits` bits are sorted with their places in them."""
    low = max(len(key) - 1, 1).bit_length()
    if bits + low > 63:
        order = np.argsort(key)
        k = key[order]
    else:
        k = np.sort((key << low) | np.arange(len(key)))
        order = k & ((1 << low) - 1)
        k >>= low
    return order, np.append(False, k[1:] != k[:-1])


def suffix_array(data: np.ndarray, ends: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes of at least `least` symbols of pieces that lie one after another; ends[i] is the end of i's piece.

    Suffixes end with their piece, shorter before longer, equal ones in order of place. lcp[i] is what suffixes
    order[i - 1] and order[i] have in common, from the ranks of each doubling step.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide, left = np.append(data, np.zeros(_GROUP, np.uint8)), ends - np.arange(n)
    first = np.zeros(n, np.int64)
    for j in range(_GROUP):
        first = (first << 9) | np.where(left > j, wide[j : j + n].astype(np.int64) + 1, 0)
    key, bits, steps, length, half = first, 9 * _GROUP, [], _GROUP, (n + 1).bit_length()
    while True:
        order, new = _order(key, bits)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        steps.append((length, rank.astype(np.int32)))
        if length >= left.max() or new.sum() == n - 1:
            break
        ahead = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > length)
        ahead[inside] = rank[inside + length] + 1
        key, bits, length = (rank << half) | ahead, 2 * half, 2 * length
    order = _order((rank << half) | np.arange(n), 2 * half)[0] if new.sum() < n - 1 else order
    order = order[left[order] >= least]
    a, b = np.append(order[:1], order[:-1]), order
    common = np.zeros(len(order), np.int64)
    most = np.minimum(left[a], left[b])
    for size, ranks in reversed(steps):
        go = np.flatnonzero(common < most)
        go = go[ranks[a[go] + common[go]] == ranks[b[go] + common[go]]]
        common[go] = np.minimum(common[go] + size, most[go])
    go = np.flatnonzero(common < most)
    x = first[a[go] + common[go]] ^ first[b[go] + common[go]]  # fewer than _GROUP symbols are left
    same = np.zeros(len(go), np.int64)
    for j in range(1, _GROUP):
        same += (x >> (9 * (_GROUP - j))) == 0
    common[go] = np.minimum(common[go] + same, most[go])
    common[:1] = 0
    return order, common


def _smaller(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix in order, the LCP with the nearest one before it that has a smaller position, by pointer jumping.

    lcp[i] is shared by i - 1 and i; index -1 stands for none.
    """
    prev, low = np.arange(len(position)) - 1, lcp.copy()
    todo = np.flatnonzero((prev >= 0) & (position[prev] >= position) & (low > 0))
    while len(todo):
        p = prev[todo]
        low[todo] = np.minimum(low[todo], low[p])
        prev[todo] = prev[p]
        todo = todo[(prev[todo] >= 0) & (position[prev[todo]] >= position[todo]) & (low[todo] > 0)]
    low[(prev < 0) | (position[prev] >= position)] = 0
    return low


def previous_factors(order: np.ndarray, lcp: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix: the longer of what it shares with the previous and the next smaller position."""
    pos = position[order]
    before = _smaller(pos, lcp)
    after = _smaller(pos[::-1], np.append(0, lcp[1:][::-1]) if len(lcp) else lcp)[::-1]
    out = np.zeros(len(position), np.int64)
    out[order] = np.maximum(before, after)
    return out


def compare_suffixes(found: DataFrame, width: int) -> DataFrame:
    def block(doc: np.ndarray, start: np.ndarray, more: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, ...]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece = np.repeat(np.arange(len(pieces)), lengths)
        ends = np.cumsum(lengths)
        shift = np.arange(len(piece)) - (ends - lengths)[piece]
        at = start[piece] + shift
        position = (np.unique(doc, return_inverse=True)[1].astype(np.int64)[piece] << 32) | at  # a text has under 2**31 bytes
        order, lcp = suffix_array(np.frombuffer(b"".join(pieces), np.uint8), ends[piece], width)
        gone = previous_factors(order, lcp, position) >= width
        return doc[piece][gone], at[gone]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("anchor")
        anchor, doc, start, more = (table.column(i).to_numpy() for i in range(1, 5))
        pieces = table.column(5).to_pylist()
        size = np.cumsum([len(p) for p in pieces])
        docs, places, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while lo < len(pieces):
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + BLOCK)))
            if hi < len(pieces):  # a block ends where an anchor does
                hi = int(np.searchsorted(anchor, anchor[hi - 1], side="right"))
            d, p = block(doc[lo:hi], start[lo:hi], more[lo:hi].astype(np.int64), pieces[lo:hi])
            docs.append(d)
            places.append(p)
            lo = hi
        d, p = np.concatenate(docs), np.concatenate(places)
        return by_document(d, (np.arange(len(d)), p, p + width))

    return found.groupBy("bucket").applyInArrow(run, _OUT_SQL)


def removed_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, starts, ends): packed ranges to remove of each document that has some."""
    ship(docs.sparkSession)
    buckets = buckets_for(docs)
    first = stored(compare_regions(post_regions(docs, buckets, width, gram), width))
    asked = first.where("octet_length(ask_start) > 0").groupBy("doc_id").agg(*(F.listagg(c).alias(c) for c in _NAMES[2:]))
    second = compare_suffixes(contexts(docs, asked, buckets, width), width)
    gone = first.select("doc_id", "gone_start", "gone_end").unionByName(second.select("doc_id", "gone_start", "gone_end")).where("octet_length(gone_start) > 0")
    return gone.groupBy("doc_id").agg(F.listagg("gone_start").alias("starts"), F.listagg("gone_end").alias("ends"))


def apply_ranges(docs: DataFrame, ranges: DataFrame, run, sql: str) -> DataFrame:
    """Attach each document's ranges and hand (doc_id, text, starts, ends) to `run`."""
    full = attach(docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_key"), "doc_id", F.col("text").cast("binary").alias("text")), stored(ranges).withColumnRenamed("doc_id", "_key"), "_key")
    return full.select("doc_id", "text", "starts", "ends").mapInArrow(run, sql)


def rows_with_ranges(b: pa.RecordBatch) -> Iterator[tuple]:
    for doc, text, starts, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
        yield doc, text or b"", *(np.frombuffer(x or b"", np.int32).astype(np.int64) for x in (starts, ends))


def deduplicate(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document; with_text adds the kept bytes."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, starts, ends in rows_with_ranges(b):
                gone = covered(len(text), np.minimum(starts, len(text)), np.minimum(ends, len(text)))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(starts) else text
                spans = int(gone[0] + (gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                out.append((doc, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)[: len(schema)])
            yield batch(schema, *(zip(*out, strict=True) if out else [[]] * len(schema)))

    return apply_ranges(docs, removed_ranges(docs, width, gram), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
