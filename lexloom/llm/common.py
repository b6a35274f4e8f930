"""Shared plumbing: shared-folder tables, checked joins and vectorised text hashing.

Texts cross into Python as Arrow binary batches and are handled as one NumPy byte buffer a chunk at a time, so a
task holds a few megabytes whatever the size of its partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import new_path, ship, stored  # noqa: F401

CHUNK_BYTES, BUCKET_BYTES = 1 << 19, 16 << 20


# ---------------------------------------------------------------- session and tables


def stored_by(df: DataFrame, key: str, buckets: int, part: str) -> DataFrame:
    """Like `stored`, divided by `part` and laid out in buckets of `key`, so that groups and joins by it need no shuffle."""
    spark = df.sparkSession
    name = f"lexloom_{uuid.uuid4().hex}"
    df.write.format("parquet").partitionBy(part).bucketBy(buckets, key).option("path", new_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def attach(big: DataFrame, side: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a side table that grows with the data: a shuffled merge join, the same plan at every size."""
    return big.join(side.hint("merge"), key, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(docs: DataFrame, bytes_each: int = BUCKET_BYTES) -> int:
    """How many buckets of about bytes_each the whole texts fill, two for each shuffle partition at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * partitions(docs.sparkSession), size // bytes_each + 1)


# ---------------------------------------------------------------- batches


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of at most `limit` bytes together, or one longer text; a null text becomes empty bytes.

    Each piece is cut from the Arrow columns before it is turned into Python objects.
    """
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, side="right")))
            part = b.slice(lo, hi - lo)
            yield part.column(0).to_pylist(), [t or b"" for t in part.column(1).to_pylist()]
            lo = hi


def as_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias(key), F.col(text).cast("binary").alias(text))


# ---------------------------------------------------------------- hashing


_STEP, _MUL_A, _MUL_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that all bits can be used."""
    h = h ^ (h >> np.uint64(33))
    h *= _MUL_A
    h ^= h >> np.uint64(33)
    h *= _MUL_B
    h ^= h >> np.uint64(33)
    return h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in this order; the first is scrambled before the second comes in, so no sum of powers arises."""
    h = a ^ (a >> np.uint64(31))
    h *= _MUL_A
    h ^= h >> np.uint64(29)
    h += b
    h *= _MUL_B
    h ^= h >> np.uint64(32)
    return h


def _level(n: np.ndarray) -> np.ndarray:
    return np.frexp(np.asarray(n, np.float64))[1] - 1


class RunHash:
    """Hashes of runs of a sequence of 64-bit symbols in constant time each.

    Level k has a hash of the 2**k symbols from each place on, joined from two halves of the level below. A run is
    hashed from its first and its last 2**k symbols, which overlap and cover it, and its length. `lengths` are the
    (least, most) lengths that will be asked for; only their levels are kept.
    """

    def __init__(self, symbols: np.ndarray, *lengths: tuple[int, int]):
        wanted = {k for lo, hi in lengths for k in range(int(_level(lo)), int(_level(hi)) + 1)}
        self.levels, now = {}, symbols
        for k in range(max(wanted) + 1):
            if k:
                half = 1 << (k - 1)
                now = joined(now[:-half], now[half:]) if len(now) > half else now[:0]
            if k in wanted:
                self.levels[k] = now

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, n = np.asarray(start), np.asarray(end) - np.asarray(start)
        out, level = np.zeros(len(start), np.uint64), _level(n)
        for k, values in self.levels.items():
            at = np.flatnonzero(level == k)
            if len(at):
                s = start[at]
                out[at] = joined(values[s], values[s + n[at] - (1 << k)] + n[at].astype(np.uint64) * _STEP)
        return out


def sequence_keys(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each whole run first[i]:first[i + 1], from its symbols scrambled with their places."""
    place = np.arange(len(symbols)) - np.repeat(first[:-1], np.diff(first))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(symbols + place.astype(np.uint64) * _STEP))))
    return mixed(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))


_PLACES = 64


class ByteHash:
    """Hashes of words as sums of scrambled (byte, place in the word) pairs; a seed gives an independent hash."""

    def __init__(self, seed: int):
        self.seed = np.uint64(np.random.default_rng(seed).integers(1 << 63))
        self.table = self.value(np.arange(_PLACES << 8, dtype=np.uint64))

    def value(self, code: np.ndarray) -> np.ndarray:
        return mixed(code * _STEP + self.seed)

    def __call__(self, letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """letters: the bytes of all words, one after another."""
        if not len(lengths):
            return np.zeros(0, np.uint64)
        first, kind = np.cumsum(lengths) - lengths, np.int32 if lengths.max() < 1 << 22 else np.int64
        code = (np.arange(len(letters), dtype=kind) - np.repeat(first.astype(kind), lengths)) << 8
        code |= letters
        far = np.flatnonzero(code >= _PLACES << 8)
        v = self.table[np.minimum(code, len(self.table) - 1) if len(far) else code]
        if len(far):
            v[far] = self.value(code[far].astype(np.uint64))
        return mixed(np.add.reduceat(v, first) + lengths.astype(np.uint64))


WORD_HASH, CHECK_HASH = ByteHash(5), ByteHash(17)


def byte_class(pattern_is_word) -> np.ndarray:
    return np.array([not pattern_is_word(b) for b in range(256)])


#: Separators of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing A-Z).
SPACES = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
NOT_ALNUM = byte_class(lambda b: b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SEGMENT = 1 << 20


class Words:
    """The words of a list of texts: hash, byte bounds in `data`, and for text i the words first[i]:first[i+1].

    With `check`, a second hash that is independent of the first.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray, lower: bool, check: bool = False):
        data = b" " + b" ".join(texts) + b" "
        if lower:
            data = data.translate(LOWER)
        self.data = data
        a = np.frombuffer(data, np.uint8)
        self.bytes = a
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(lengths + 1))) + 1
        hashers = (WORD_HASH, CHECK_HASH)[: 1 + check]
        starts, ends, hashes, lo = [], [], [[] for _ in hashers], 0
        while lo < len(a) - 1:
            hi = min(lo + SEGMENT, len(a))
            while hi < len(a) and not separators[a[hi - 1]]:
                step = np.flatnonzero(separators[a[hi : hi + SEGMENT]])
                hi = hi + int(step[0]) + 1 if len(step) else min(hi + SEGMENT, len(a))
            part = a[max(lo - 1, 0) : hi]
            gap = separators[part]
            edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
            s, e = edge[0::2], edge[1::2]
            starts.append(s + max(lo - 1, 0))
            ends.append(e + max(lo - 1, 0))
            letters = part[~gap]
            for out, hasher in zip(hashes, hashers, strict=True):
                out.append(hasher(letters, e - s))
            lo = hi
        self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.hash, self.check = (*(np.concatenate(h) for h in hashes), None)[:2]
        self.first = np.searchsorted(self.start, self.text_start)

    def __len__(self) -> int:
        return len(self.hash)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, text) of each run of n words inside one text."""
        counts = np.diff(self.first)
        each = np.maximum(counts - n + 1, 0)
        text = np.repeat(np.arange(len(counts)), each)
        offset = np.cumsum(each) - each
        return self.first[:-1][text] + np.arange(len(text)) - offset[text], text


def covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of 0..size-1 lie in some [start, end)."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
