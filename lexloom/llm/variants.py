"""Spelling variants by full neighbourhoods: each word emits every string one edit away, and those that are words are its near words.

`vocabulary` counts words in the texts, with a planted misspelling where a hash of the document and the word says so. `neighbours`
emits, for each word, all distinct deletions, replacements and insertions over the letters that occur in the
vocabulary. A string one edit away needs no check of its distance, so a hash join with the vocabulary finishes the work. Nearly all
of the 180 strings for each letter of a word are no words; tasks drop them before the shuffle by a Bloom filter of
the vocabulary (hashes of all edits follow from prefix and suffix sums, without writing the strings). The filter takes FILTER_BITS
bits a word and at most MAX_BITS (64 MB); a larger vocabulary is cut by hash into several filters with a pass for each. What
passes wrongly finds no partner in the join, so that the filter changes no result.

A word's form is its most frequent near word, if that is `ratio` times as frequent; its root is the end of the chain of forms. Counts grow
along a chain by the ratio, which bounds its length by the logarithm of the largest count; pointers are doubled that
many times.

Defined results: a null text has no words; a null id is written as an empty string before the hash; repeated ids and rows count each; an empty
table gives an empty result; other columns are ignored; runs of any length are words, long ones are worked off in blocks
of places. Ties of count go to the smallest word in code-point order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import mixed, ship, stored

LEAST, REPEATS, RATIO, PLANTED = 7, 2, 10, 31
FILTER_BITS, MAX_BITS, PROBES = 32, 1 << 29, 3
BLOCK = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_U = np.uint64
_PLACE, _LETTER = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_MORE = [_U(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]  # factors of the further probes


def vocabulary(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS, planted: int = PLANTED) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, of at least `least` code points and `repeats` occurrences.

    Where `planted` divides the CRC-32 of `<doc_id>:<run>`, the run loses the code point at that number modulo its length.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    cut = F.concat(F.expr("substring(run, 1, int(h % char_length(run)))"), F.expr("substring(run, int(h % char_length(run)) + 2)"))
    words = runs.select(F.when(F.col("h") % planted == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= repeats)


def _value(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """A random number for each letter at each place; a word's hash is the sum of its letters' numbers."""
    return mixed(place.astype(_U) * _PLACE + (letter.astype(_U) + _U(1)) * _LETTER)


class Edits:
    """Hashes of all strings one edit away from words of one length, given as a matrix of Latin-1 codes."""

    def __init__(self, words: np.ndarray, letters: np.ndarray):
        self.words, self.letters = words, letters
        places, zero = np.arange(words.shape[1]), np.zeros((len(words), 1), _U)
        self.own = _value(places[None, :], words)
        self.before = np.concatenate((zero, np.cumsum(self.own, 1)), 1)  # of the letters before a place
        self.hash = self.before[:, -1]

        def after(shift: int) -> np.ndarray:
            moved = _value((places + shift)[None, :], words)
            return np.concatenate((np.cumsum(moved[:, ::-1], 1)[:, ::-1], zero), 1)

        self.left, self.right = after(-1), after(1)  # of the letters from a place on, moved by one

    def blocks(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, int]]:
        """(kind, hashes, which are distinct and no word itself, first place); the last two axes are place and letter."""
        words, n = self.words, self.words.shape[1]
        repeat = np.zeros((len(words), n), bool)
        repeat[:, 1:] = words[:, 1:] == words[:, :-1]  # deleting the second of two equal letters repeats the first deletion
        yield "delete", (self.before[:, :-1] + self.left[:, 1:])[:, :, None], ~repeat[:, :, None], 0
        step = max(1, BLOCK // (len(words) * len(self.letters)))
        for lo in range(0, n + 1, step):
            hi = min(lo + step, n + 1)
            value = _value(np.arange(lo, hi)[:, None], self.letters[None, :])
            last = np.concatenate((np.zeros((len(words), 1), words.dtype), words), 1)[:, lo:hi]  # inserting a letter behind its like repeats
            yield "insert", (self.before[:, lo:hi] + self.right[:, lo:hi])[:, :, None] + value, self.letters != last[:, :, None], lo
            if (hi := min(hi, n)) > lo:
                rest = self.hash[:, None] - self.own[:, lo:hi]
                yield "replace", rest[:, :, None] + value[: hi - lo], self.letters != words[:, lo:hi, None], lo


def _edited(word: str, kind: str, at: int, letter: str) -> str:
    return word[:at] + ("" if kind == "delete" else letter) + word[at + (kind != "insert") :]


def _by_length(words: list[str], width: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """(rows, their codes): words of one length at a time, no more than BLOCK candidates for each place."""
    lengths: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        lengths.setdefault(len(w), []).append(i)
    for n, rows in lengths.items():
        step = max(1, BLOCK // (width * n))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            yield some, np.frombuffer("".join(words[i] for i in some).encode("latin-1"), np.uint8).reshape(len(some), n)


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter's bits of each hash."""
    shift = _U(64 - bits)
    return [h >> shift, *((h * m) >> shift for m in _MORE[: PROBES - 1])]


def _filter_of(h: np.ndarray, filters: int) -> np.ndarray:
    return (h & _U(0xFFFF)) % _U(filters)


def word_filter(words: DataFrame, bits: int, filters: int, which: int) -> np.ndarray:
    """A Bloom filter of 2**bits bits, at most MAX_BITS, of the words that hash to filter number `which`; tasks set bits, Spark joins them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [Edits(codes, np.zeros(0, np.uint8)).hash for _, codes in _by_length(batch.column(0).to_pylist(), 1)]
            h = np.concatenate([*h, np.zeros(0, _U)])
            at = np.concatenate(_places(h[_filter_of(h, filters) == which], bits))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + 1)], names=["place"])

    places = words.select("word").mapInArrow(run, "place long")
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(max(1 << (bits - 3), 4096), np.uint8)
    for r in parts.toLocalIterator():
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def candidates(words: DataFrame, letters: np.ndarray, bits: int, filters: int, which: int) -> DataFrame:
    """(word, n, near): the strings one edit away from each word that pass filter number `which`."""
    shared = words.sparkSession.sparkContext.broadcast(word_filter(words, bits, filters, which))
    names = [chr(c) for c in letters.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            own, found, near = batch.column(0).to_pylist(), [], []
            for rows, codes in _by_length(own, len(letters)):
                for kind, h, distinct, first in Edits(codes, letters).blocks():
                    at = (h >> _U(64 - bits)).astype(np.int64 if bits > 31 else np.int32)
                    hit = np.flatnonzero((held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & distinct)
                    h = h.ravel()[hit]
                    ok = _filter_of(h, filters) == which
                    for p in _places(h, bits)[1:]:
                        ok &= (held[(p >> _U(3)).astype(np.int64)] >> (p & _U(7)).astype(np.uint8) & 1).astype(bool)
                    row, place, letter = np.unravel_index(hit[ok], distinct.shape)
                    for r, p, c in zip(row.tolist(), place.tolist(), letter.tolist(), strict=True):
                        found.append(rows[r])
                        near.append(_edited(own[rows[r]], kind, first + p, names[c]))
            taken = batch.take(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(near, pa.string())], names=["word", "n", "near"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, near string")


def neighbours(words: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(word, n, near, near_n) for each two words that differ by one inserted, deleted or replaced code point."""
    ship(words.sparkSession)
    size = words.count()
    filters = -(-size * FILTER_BITS // max_bits) or 1
    bits = max(15, math.ceil(math.log2(max(size * FILTER_BITS // filters, 1))))
    codes = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c != ''").distinct()
    letters = np.array(sorted(ord(r.c) for r in codes.collect()), np.uint8)  # 90 at most
    out = None
    for which in range(filters):
        some = candidates(words, letters, bits, filters, which)
        out = some if out is None else out.unionByName(some)
    return out.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("shuffle_hash"), "near").select("word", "n", "near", "near_n")


def group(docs: DataFrame, ratio: int = RATIO, max_bits: int = MAX_BITS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of the vocabulary."""
    words = stored(vocabulary(docs))
    near = neighbours(words, max_bits).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("top"))
    known = words.join(near, "word", "left")
    formed = -F.col("top.minus") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("top.near")).alias("form"), F.when(formed, -F.col("top.minus")).alias("form_n"))
    known = stored(known)
    ends = known.where("form is not null").select("word", F.col("form").alias("root"))
    hops = math.log(max(known.agg(F.max("n")).first()[0] or 1, 1), ratio)
    for _ in range(math.ceil(math.log2(max(hops, 1)))):
        next_ends = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = stored(ends.join(next_ends, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return known.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
