"""Alignment of two tokenizers over the same texts: a byte-level BPE (A) and a piece model (B).

A text is encoded as space+text by A and as text by B, which adds the space. Neither tokenizer joins characters across
a space that follows a character other than white space, so a text falls into chunks there, and a text's alignment is the sequence of
its chunks' alignments. Each task aligns every distinct chunk of what it reads, in DuckDB over Arrow tables:
token interval tables (place, id, byte range) of both sides, a range join for the overlaps, ASOF joins that give each
token the next common end, and window sums that number the groups between common ends. A task keeps at most
MAX_CHUNKS aligned chunks and starts afresh beyond, which changes no result.

Links are token occurrences of A and B that end at the same byte. The shorter of the two is then a suffix of the longer, so
the vocabularies alone bound the pairs of ids that can be linked (`pair_codes`: 324,302 for the default files). Tasks count pairs over that
list, Spark adds the counts, and the sums go back to the tasks as one array of that size, whatever the corpus.

A document has no tokens if its text is null or empty, or if the bytes of its A or B tokens differ from
space+text (a U+2581 in it). Defined results: one row a row; repeated or null ids are carried along and each row counts; an empty table gives an empty
result; other columns are ignored; a very long text is handled whole, within one task.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import ship
from lexloom.llm.vocabularies import BYTE_BPE, PIECE_BPE, SPACE, byte_bpe, piece_bpe
from lexloom.session import new_path

MAX_CHUNKS, MAX_CHARS = 150_000, 4 << 20
EDGE = re.compile(r"(?<=\S) ")

#: a(i, id, lo, hi) and b(j, id, lo, hi) are the token intervals of all new chunks, laid end to end.
OVERLAPS = "SELECT a.i, b.j, a.id AS a_id, b.id AS b_id, a.lo AS a_lo, b.lo AS b_lo, a.hi AS a_hi, b.hi AS b_hi FROM a JOIN b ON a.lo < b.hi AND b.lo < a.hi"
CUTS = "SELECT i, j, a_id, b_id, a_hi AS hi, sum(1) OVER (ORDER BY a_hi ROWS UNBOUNDED PRECEDING) - 1 AS g FROM overlap WHERE a_hi = b_hi"
GROUP_OF = "SELECT t.{0} AS place, c.g FROM {1} t ASOF JOIN cut c ON t.hi <= c.hi ORDER BY place"


@lru_cache(maxsize=2)
def pair_codes(a_path: str, b_path: str) -> np.ndarray:
    """Sorted codes a * |B| + b of all ids of which one's bytes end with the other's."""
    a_bytes, b_bytes = byte_bpe(a_path)[1], piece_bpe(b_path)[1]

    def by_bytes(tokens: list[bytes]) -> dict[bytes, list[int]]:
        out = defaultdict(list)
        for i, t in enumerate(tokens):
            out[t].append(i)
        return out

    of_a, of_b = by_bytes(a_bytes), by_bytes(b_bytes)
    found = {a * len(b_bytes) + b for a, t in enumerate(a_bytes) for k in range(len(t)) for b in of_b.get(t[k:], ())}
    found |= {a * len(b_bytes) + b for b, t in enumerate(b_bytes) for k in range(1, len(t)) for a in of_a.get(t[k:], ())}
    return np.array(sorted(found), np.int64)


@lru_cache(maxsize=2)
def _printed(n: int, ends: tuple[str, str]) -> pa.Array:
    """The ids 0..n-1 in decimals, followed by the first (2 * id) or the second (2 * id + 1) end."""
    return pa.array([f"{i}{e}".encode() for i in range(n) for e in ends], pa.binary())


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum())), sizes


def _joined(tokens: pa.Array, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of the tokens one after another, and where each ends."""
    taken = pc.take(tokens, pa.array(ids)).cast(pa.large_binary())
    ends = np.frombuffer(taken.buffers()[1], np.int64)[1 : len(ids) + 1] if len(ids) else np.zeros(0, np.int64)
    return (taken.buffers()[2] or b"", ends) if len(ids) else (b"", ends)


class Aligner:
    """Aligned distinct chunks, numbered in the order they came."""

    def __init__(self, a_path: str, b_path: str):
        self.a, a_bytes = byte_bpe(a_path)
        self.b, b_bytes = piece_bpe(b_path)
        self.a_bytes, self.b_bytes, self.codes = pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary()), pair_codes(a_path, b_path)
        self.lone = [self.b.piece_to_id(SPACE)]  # what B makes of the space it adds to nothing
        self.sql = duckdb.connect(config={"threads": 1})
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars, self.printed, self.links = 0, [], []
        self.counts, self.odd = np.zeros((0, 5), np.int64), np.zeros(0, bool)  # of a chunk: A and B tokens, groups, overlaps, 1 if unfit

    def parts(self, texts: list[str]) -> list[list[int]]:
        """The chunk numbers of each text."""
        if len(self.number) > MAX_CHUNKS or self.chars > MAX_CHARS:
            self.clear()
        split = [t.split(" ") for t in texts]
        for i, words in enumerate(split):  # a space after white space is no edge
            if any(not w or w[-1].isspace() for w in words):
                split[i] = EDGE.split(texts[i])
        new = list({w: None for words in split for w in words if w not in self.number})
        if new:
            self._align(new)
        return [list(map(self.number.__getitem__, words)) for words in split]

    def _align(self, new: list[str]) -> None:
        full = [f" {w}" for w in new]
        a, b = _flat(list(map(self.a.encode_ordinary, full))), _flat([x or self.lone for x in self.b.encode(new, num_threads=1)])
        want = [w.encode() for w in full]
        size = np.fromiter(map(len, want), np.int64, len(want))
        (a_text, a_hi), (b_text, b_hi) = _joined(self.a_bytes, a[0]), _joined(self.b_bytes, b[0])
        text, fit = b"".join(want), np.ones(len(new), bool)
        if not a_text == b_text == text:  # leave out the chunks whose own bytes differ
            a_end, b_end = (np.concatenate(([0], hi))[np.concatenate(([0], np.cumsum(n)))] for hi, n in ((a_hi, a[1]), (b_hi, b[1])))
            a_text, b_text = bytes(a_text), bytes(b_text)
            fit = np.array([a_text[a_end[k] : a_end[k + 1]] == b_text[b_end[k] : b_end[k + 1]] == w for k, w in enumerate(want)])
            a, b = ((ids[np.repeat(fit, n)], np.where(fit, n, 0)) for ids, n in (a, b))
            a_hi, b_hi = _joined(self.a_bytes, a[0])[1], _joined(self.b_bytes, b[0])[1]
        counts, printed, links = self._groups(*a, a_hi, *b, b_hi)
        counts[:, 4] = ~fit
        self.counts = np.concatenate((self.counts, counts))
        self.printed += printed
        self.links += links
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.chars += int(size.sum())

    def overlaps(self, a: np.ndarray, a_hi: np.ndarray, b: np.ndarray, b_hi: np.ndarray) -> None:
        """DuckDB tables of the intervals (a, b), their overlaps, and the common ends with their numbers (cut)."""
        for name, place, ids, hi in (("a", "i", a, a_hi), ("b", "j", b, b_hi)):
            lo = np.concatenate(([0], hi[:-1])) if len(hi) else hi
            self.sql.register(f"{name}_arrow", pa.table({place: np.arange(len(ids)), "id": ids, "lo": lo, "hi": hi}))
            self.sql.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS FROM {name}_arrow")
            self.sql.unregister(f"{name}_arrow")
        self.sql.execute(f"CREATE OR REPLACE TEMP TABLE overlap AS {OVERLAPS}")
        self.sql.execute(f"CREATE OR REPLACE TEMP TABLE cut AS {CUTS}")

    def _groups(self, a: np.ndarray, a_n: np.ndarray, a_hi: np.ndarray, b: np.ndarray, b_n: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        self.overlaps(a, a_hi, b, b_hi)
        get = lambda sql: self.sql.execute(sql).fetchnumpy()
        g_a, g_b = (get(GROUP_OF.format(*x))["g"].astype(np.int64) for x in (("i", "a"), ("j", "b")))
        cut, over = get("SELECT i, a_id, b_id FROM cut ORDER BY i"), get("SELECT i, count(*) AS n FROM overlap GROUP BY i ORDER BY i")["n"]
        first_a, first_b = (np.concatenate(([0], np.cumsum(n))) for n in (a_n, b_n))
        # tokens in the order of groups, A's before B's, each with the sign that follows it
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (g_a, g_b))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(g_b, g_a)] = 2 * a.astype(np.int64) + last_a
        signs = _printed(len(self.a_bytes), (",", "|")), _printed(len(self.b_bytes), (",", ";"))
        order[np.arange(len(b)) + np.searchsorted(g_a, g_b, side="right")] = 2 * b.astype(np.int64) + last_b + len(signs[0])
        text, ends = _joined(pa.concat_arrays(signs), order)
        text, ends = bytes(text), np.concatenate(([0], ends))[first_a + first_b]
        code = np.searchsorted(self.codes, cut["a_id"].astype(np.int64) * len(self.b_bytes) + cut["b_id"]).astype("<u4").tobytes()
        cuts = np.searchsorted(cut["i"], first_a)
        overs = np.concatenate(([0], np.cumsum(over, dtype=np.int64)))[first_a]
        counts = np.column_stack((a_n, b_n, np.diff(cuts), np.diff(overs), np.zeros(len(a_n), np.int64)))
        printed = [text[lo : hi - 1] if hi > lo else b"" for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return counts, printed, [code[4 * lo : 4 * hi] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, groups_sha256 string, links binary"
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_overlaps")), ("groups_sha256", pa.string()), ("links", pa.binary())])


def aligned(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """One row a row: token, group and overlap counts, the hash of the groups, and the links as little-endian places in `pair_codes`."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Aligner(a_path, b_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            parts = known.parts([t for t in texts if t])
            rows, left = [], iter(parts)
            for t in texts:
                own = next(left) if t else []
                total = known.counts[own].sum(0)
                if not own or total[4]:
                    rows.append((0, 0, 0, 0, "", b""))
                    continue
                groups = hashlib.sha256(b";".join(map(known.printed.__getitem__, own))).hexdigest()
                rows.append((*total[:4].tolist(), groups, b"".join(map(known.links.__getitem__, own))))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_SCHEMA)[1:], strict=True))], schema=_SCHEMA) if rows else pa.RecordBatch.from_pylist([], _SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, _ALIGNED)


def pair_counts(links: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """(pair, n): how many links each place in `pair_codes` has in the corpus; tasks count, Spark adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(pair_codes(a_path, b_path)), np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=len(n))
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen])], names=["pair", "n"])

    return links.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """The alignment's figures of each document, with how its links fare in the whole corpus: n_best counts the links whose
    pair is as frequent as any pair of their B id, count_sum adds the frequencies of all links."""
    spark = docs.sparkSession
    path = new_path(spark, f"lexloom-{uuid.uuid4().hex}")
    aligned(docs, a_path, b_path).write.option("compression", "zstd").parquet(path)
    links = spark.read.schema(_ALIGNED).parquet(path)
    counted = pair_counts(links, a_path, b_path).toArrow()  # no more rows than pair_codes has
    codes, n_b = pair_codes(a_path, b_path), len(piece_bpe(b_path)[1])
    n = np.zeros(len(codes), np.int64)
    n[counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    most = np.zeros(n_b, np.int64)
    np.maximum.at(most, codes % n_b, n)
    shared = spark.sparkContext.broadcast((n, n == most[codes % n_b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = shared.value
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(6)]
            figures = [[len(x) for x in own], [int(np.count_nonzero(best[x])) for x in own], [int(n[x].sum()) for x in own]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *(pa.array(f, pa.int64()) for f in figures)], names=[*_SCHEMA.names[:6], "n_links", "n_best", "count_sum"])

    return links.mapInArrow(run, _ALIGNED.replace("links binary", "n_links long, n_best long, count_sum long"))
