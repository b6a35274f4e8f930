"""Piece encoding and decoding with exact N-best segmentation.

A text's segmentations are the paths through the lattice of the vocabulary's pieces. A forward Viterbi pass gives each
position the best score of any path to it. Those scores are an exact heuristic for an A-star search from the end
backwards, so the N best paths come out in order and nothing else is expanded to the end.

No piece goes across a line break or from a letter into a space, so the lattice falls apart into chunks (spaces and
the word after them). The chunks of a batch that the worker's bounded cache doesn't hold are segmented together: the pieces are found by
walking a trie from all positions at once, and the Viterbi pass and the first steps of the backward search (best path, loss of
the second best) go over all chunks at the same time. The N best segmentations of a text differ from its best in its
N - 1 cheapest chunks only (by the loss of a chunk's second-best segmentation), and are merged exactly from those
chunks' own N best, found by the A-star search. A model whose pieces do cross is searched over whole texts.

Scores are whole numbers (millionths), so sums are exact; of equal scores the path goes first whose piece ids, read from
the end of the chunk, are smaller. The ranks of a BPE model are no log-probabilities; its pieces score by Zipf's law for
their rank. What no piece covers is spelt in byte pieces.

Defined results: null and empty texts have no pieces and decode to the empty text; very long texts and chunks take time and memory
in proportion to their length; repeated rows each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.common import as_bytes, batch, chunks, ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST, CACHE, WAYS = 4, 150_000, 20_000
SHORT = 64  # longer chunks are searched one by one
SPACE = "▁"
_CHUNK = re.compile(" +[^ \n]*|\n+|[^ \n]+")
_NONE = -(1 << 62)  # below any score
_HEAD = np.dtype([("score", np.int64), ("loss", np.int64)])  # of an entry of the cache; the ids follow


_MUL = np.uint64(0x9E3779B97F4A7C15)


class Trie:
    """The pieces as a trie in flat arrays: symbol of a code point, and a table of (state, symbol) -> state with open addressing."""

    def __init__(self, pieces: dict[str, tuple]):
        every = sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)}, key=len)
        number = {"": 0} | {p: i for i, p in enumerate(every, 1)}
        codes = sorted({ord(p[-1]) for p in every})
        self.symbols = np.zeros(max(codes, default=0) + 2, np.int64)
        self.symbols[codes] = np.arange(1, len(codes) + 1)
        self.width = len(codes) + 1
        self.ids, self.scores = np.full(len(number), -1, np.int64), np.zeros(len(number), np.int64)
        for p, hit in pieces.items():
            if hit:
                self.ids[number[p]], self.scores[number[p]] = hit[0][0], hit[1]
        key = np.array([number[p[:-1]] * self.width + int(self.symbols[ord(p[-1])]) for p in every], np.int64)
        bits = max(8, int(4 * len(key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.to[slot[put]] = key[put], put + 1
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MUL) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states that the symbols lead to, -1 where there is none."""
        key = state * self.width + symbol
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where((found == key) & (symbol > 0), self.to[slot], -1)
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            same = found == key[todo]
            out[todo[same]] = self.to[slot[todo[same]]]
            todo = todo[~same & (found >= 0)]
        out[symbol == 0] = -1
        return out


@dataclass
class Vocabulary:
    """pieces: text (with plain spaces) -> ((id,), score), or () for what only begins a piece; byte ids; what each id decodes to."""

    pieces: dict[str, tuple]
    byte_ids: list[int]
    byte_score: int
    decoded: list[bytes]
    separable: bool
    trie: Trie


def load(model_file: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(sp.get_piece_size())
    normal = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    raw = {i: sp.get_score(i) for i in normal}
    ranked = all(float(s).is_integer() for s in raw.values())
    total = sum(1 / (2 - s) for s in raw.values()) if ranked else 1.0
    score = {i: round(1e6 * (-math.log((2 - s) * total) if ranked else s)) for i, s in raw.items()}
    low = min(score.values())
    pieces = {sp.id_to_piece(i).replace(SPACE, " "): ((i,), score[i]) for i in normal}
    decoded = [b""] * len(ids)
    byte_ids = [-1] * 256
    for p, ((i,), _) in pieces.items():
        decoded[i] = p.encode()
    for i in ids:
        if sp.is_byte(i):
            b = int(sp.id_to_piece(i)[1:-1], 16)
            byte_ids[b], decoded[i] = i, bytes([b])
    if -1 in byte_ids:
        raise ValueError("the model has no byte pieces")
    separable = not any("\n" in p or " " in p.lstrip(" ") for p in pieces)
    begun = {p[:n]: () for p in pieces for n in range(1, len(p))}
    return Vocabulary(begun | pieces, byte_ids, low - 10_000_000, decoded, separable, Trie(pieces))


def lattice(chunk: str, v: Vocabulary) -> tuple[list[list], list]:
    """For each end the edges (start, ids, score) into it, and the best score of a path to it (forward Viterbi)."""
    get, n = v.pieces.get, len(chunk)
    best, edges = [0] + [_NONE] * n, [[] for _ in range(n + 1)]
    for i in range(n):
        here = best[i]
        for j in range(i + 1, n + 1):
            hit = get(chunk[i:j])
            if hit:
                ids, s = hit
                edges[j].append((i, ids, s))
                s += here
                if s > best[j]:
                    best[j] = s
            elif hit is None:
                break
        if not edges[i + 1] or edges[i + 1][-1][0] != i:
            spelt = chunk[i].encode("utf-8", "surrogatepass")
            s = v.byte_score * len(spelt)
            edges[i + 1].append((i, tuple([v.byte_ids[b] for b in spelt]), s))
            if here + s > best[i + 1]:
                best[i + 1] = here + s
    return edges, best


def best_two(chunk: str, v: Vocabulary) -> bytes:
    """Score of the best path, loss of the second best (-_NONE if there is none) and the best path's ids, as bytes.

    The second best leaves the best path, seen from the end, at one place by another edge, and from there on has the
    best score ahead: the first step of the A-star search, without its queue.
    """
    edges, best = lattice(chunk, v)
    at, parts, loss = len(chunk), [], -_NONE
    while at:
        top, ways = best[at], edges[at]
        if len(ways) == 1:
            at, ids, _ = ways[0]
        else:
            ranked = sorted([(-best[i] - s, ids, i) for i, ids, s in ways])
            _, ids, at = ranked[0]
            if top + ranked[1][0] < loss:
                loss = top + ranked[1][0]
        parts.append(ids)
    return struct.pack("=qq%di" % sum(map(len, parts)), best[-1], loss, *[x for p in reversed(parts) for x in p])


def _spelt(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number) of each code point in UTF-8, four columns."""
    n = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    out = np.zeros((len(code), 4), np.int64)
    for k, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        at = np.flatnonzero(n == k)
        for j in range(k):
            rest = code[at] >> (6 * (k - 1 - j))
            out[at, j] = (rest | lead) if j == 0 else 0x80 | (rest & 0x3F)
    return out, n


def best_two_of(chunks_: list[str], v: Vocabulary) -> list[bytes]:
    """best_two of many short chunks together."""
    lengths = np.fromiter(map(len, chunks_), np.int64, len(chunks_))
    code = np.frombuffer("".join(chunks_).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    count, size = len(chunks_), len(code)
    owner = np.repeat(np.arange(count), lengths)
    ends = np.cumsum(lengths)
    last, node = ends[owner], np.arange(size) + owner  # a chunk of n characters has n + 1 nodes
    symbol = v.trie.symbols[np.minimum(code, len(v.trie.symbols) - 1)]
    at, state, d, single = np.arange(size), np.zeros(size, np.int64), 0, np.zeros(size, bool)
    found: list[tuple] = []
    while len(at):
        state = v.trie.step(state, symbol[at + d])
        on = state >= 0
        at, state, d = at[on], state[on], d + 1
        whole = np.flatnonzero(v.trie.ids[state] >= 0)
        begin = node[at[whole]]
        found.append((begin, begin + d, v.trie.ids[state[whole]], v.trie.scores[state[whole]], np.full(len(whole), -1)))
        if d == 1:
            single[at[whole]] = True
        on = at + d < last[at]
        at, state = at[on], state[on]
    bare = np.flatnonzero(~single)
    letters, n_letters = _spelt(code[bare])
    byte_ids = np.array(v.byte_ids, np.int64)
    found.append((node[bare], node[bare] + 1, byte_ids[letters[:, 0]], v.byte_score * n_letters, np.arange(len(bare))))
    source, target, ids, score, spelling = (np.concatenate(x) for x in zip(*found, strict=True))
    head_node = np.append(0, ends[:-1]) + np.arange(count)  # the first node of each chunk
    local = target - np.repeat(head_node, lengths + 1)[target]
    order = np.argsort((local << 48) | (target << 20) | ids)
    source, target, ids, score, spelling, local = (x[order] for x in (source, target, ids, score, spelling, local))
    heads = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    longest = int(lengths.max())
    cuts, head_cuts = np.searchsorted(local, np.arange(1, longest + 2)), np.searchsorted(local[heads], np.arange(1, longest + 2))
    best, total = np.zeros(size + count, np.int64), np.empty(len(source), np.int64)
    for lo, hi, a, b in zip(cuts, cuts[1:], head_cuts, head_cuts[1:], strict=False):
        total[lo:hi] = best[source[lo:hi]] + score[lo:hi]
        best[target[heads[a:b]]] = np.maximum.reduceat(total[lo:hi], heads[a:b] - lo)
    top = np.flatnonzero(total == best[target])
    top = top[np.append(True, target[top][1:] != target[top][:-1])]  # of equal ones the smallest id
    choice, gap = np.zeros(size + count, np.int64), np.zeros(size + count, np.int64)
    choice[target[top]] = top
    total[top] = _NONE
    second = np.maximum.reduceat(total, heads)
    gap[target[heads]] = np.where(second == _NONE, -_NONE, best[target[heads]] - second)
    here, alive, loss = ends + np.arange(count), np.arange(count), np.full(count, -_NONE)
    final, steps = best[here], []
    while len(alive):
        edge = choice[here]
        loss[alive] = np.minimum(loss[alive], gap[here])
        steps.append((alive, edge))
        here = source[edge]
        on = here != head_node[alive]
        alive, here = alive[on], here[on]
    chunk, edge = (np.concatenate(x) for x in zip(*steps[::-1], strict=True))
    order = np.argsort(chunk, kind="stable")
    chunk, edge = chunk[order], edge[order]
    width = np.where(spelling[edge] >= 0, n_letters[spelling[edge]] if len(bare) else 1, 1)
    out, to = np.zeros(int(width.sum()), np.int32), np.cumsum(width) - width
    out[to] = ids[edge]
    odd = np.flatnonzero(width > 1)
    for j in range(1, 4):
        odd = odd[width[odd] > j]
        out[to[odd] + j] = byte_ids[letters[spelling[edge[odd]], j]]
    heads_ = np.empty(count, _HEAD)
    heads_["score"], heads_["loss"] = final, loss
    blob, ids_blob = heads_.tobytes(), out.tobytes()
    bounds = np.append(0, np.cumsum(np.bincount(chunk, width, count))).astype(np.int64) * 4
    h = _HEAD.itemsize
    return [blob[h * i : h * i + h] + ids_blob[a:b] for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False))]


class _Path:
    """A path from the end of a chunk, as a linked list with jumps, so that two paths are compared in logarithmic time."""

    __slots__ = ("ids", "up", "depth", "jump")

    def __init__(self, ids: tuple = (), up: _Path | None = None):
        self.ids, self.up, self.depth = ids, up, up.depth + 1 if up else 0
        self.jump = self if up is None else up.jump.jump if up.depth - up.jump.depth == up.jump.depth - up.jump.jump.depth else up

    def __lt__(self, other: _Path) -> bool:
        """By piece ids, from the end of the chunk on."""
        a, b = self, other
        while a.depth != b.depth:
            if a.depth > b.depth:
                a = a.jump if a.jump.depth >= b.depth else a.up
            else:
                b = b.jump if b.jump.depth >= a.depth else b.up
        if a is b:
            return self.depth < other.depth
        while a.up is not b.up:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.up, b.up)
        return a.ids < b.ids


def n_best(chunk: str, n: int, v: Vocabulary) -> list[tuple[int, tuple[int, ...]]]:
    """The n best (score, ids) in order, by A-star search from the end with the forward scores ahead as exact heuristic."""
    edges, best = lattice(chunk, v)
    out: list[tuple[int, tuple[int, ...]]] = []
    heap: list[tuple] = [(-best[-1], _Path(), len(chunk), 0)]  # minus (score behind + best score ahead), path, place, score behind
    while heap and len(out) < n:
        total, path, at, behind = heapq.heappop(heap)
        if at == 0:
            ids: list[int] = []
            while path.up:
                ids += path.ids
                path = path.up
            out.append((-total, tuple(ids)))
            continue
        for i, piece, s in edges[at]:
            heapq.heappush(heap, (-(behind + s + best[i]), _Path(piece, path), i, behind + s))
    return out


class Encoder:
    """Encodes texts with a bounded cache of what best_two gives for chunks, one bytes object each.

    The cache has two generations of half the limit each: the old one goes when the young one is full, and what is
    used again moves to the young one, so frequent chunks stay.
    """

    def __init__(self, v: Vocabulary, n: int = N_BEST, cache: int = CACHE):
        self.v, self.n, self.limit, self.cache, self.old, self.ways = v, n, max(cache // 2, 1), {}, {}, {}

    def _split(self, text: str) -> list[str]:
        return (_CHUNK.findall(" " + text) if self.v.separable else [" " + text]) if text else []

    def prepare(self, texts: list[list[str]]) -> None:
        """Bring all chunks of these texts into the cache."""
        if len(self.cache) >= self.limit:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        fresh = {c for pieces in texts for c in pieces if c not in cache}
        cache.update({c: old[c] for c in fresh if c in old})
        missing = [c for c in fresh if c not in cache]
        short = [c for c in missing if len(c) <= SHORT]
        for lo in range(0, len(short), 1 << 15):
            part = short[lo : lo + (1 << 15)]
            cache.update(zip(part, best_two_of(part, self.v), strict=True))
        cache.update({c: best_two(c, self.v) for c in missing if len(c) > SHORT})

    def _n_best(self, chunk: str) -> list[tuple[int, tuple[int, ...]]]:
        found = self.ways.get(chunk)
        if found is None:
            found = n_best(chunk, self.n, self.v)
            if len(chunk) <= SHORT:
                if len(self.ways) >= WAYS:
                    self.ways.clear()
                self.ways[chunk] = found
        return found

    def encode(self, text: str) -> tuple[np.ndarray, int, list[tuple[int, dict[int, tuple[int, ...]]]]]:
        """(ids, score, the N best as (loss, changed chunk -> its ids))."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, int, list[tuple[int, dict[int, tuple[int, ...]]]]]]:
        split = [self._split(t) for t in texts]
        self.prepare(split)
        get, size = self.cache.__getitem__, _HEAD.itemsize
        for pieces in split:
            if not pieces:
                yield np.zeros(0, np.int32), 0, []
                continue
            found = list(map(get, pieces))
            ids = np.frombuffer(b"".join([e[size:] for e in found]), np.int32)
            head = np.frombuffer(b"".join([e[:size] for e in found]), _HEAD)
            best: list[tuple[int, dict]] = [(0, {})]
            if self.n > 1:
                loss = head["loss"]
                k = min(self.n - 1, len(loss))
                near = np.flatnonzero(loss <= np.partition(loss, k - 1)[k - 1])
                for c in near[np.lexsort((near, loss[near]))][:k].tolist():
                    own = self._n_best(pieces[c])  # the first is the chunk's best path, as in ids
                    best = heapq.nsmallest(self.n, ((a + own[0][0] - s, {**d, c: way} if i else d) for a, d in best for i, (s, way) in enumerate(own)), key=lambda x: (x[0], sorted(x[1].items())))
            yield ids, int(head["score"].sum()), best

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of piece ids; the first space is the one that encoding put in front."""
        table = self.v.decoded
        return b"".join([table[i] for i in ids.tolist()])[1:]


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(shared, key: tuple) -> Encoder:
    """The encoder of this Python worker, which later tasks of the worker use again; one model at a time."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value, key[1])
    return _ENCODERS[key]


def encode(docs: DataFrame, model_file: str = MODEL, n: int = N_BEST, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, score, gaps of the N best to the best, digests of the ids and of the ways they differ, and
    whether the ids decode to the text; with_ids adds the ids."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load(model_file))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("gaps", pa.list_(pa.float64())), ("ids_sha256", pa.string()), ("n_best_sha256", pa.string()), ("round_trip", pa.bool_())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared, (model_file, n))
        for ids, texts in chunks(batches):
            out = []
            every = e.encode_all([t.decode("utf-8", "surrogatepass") for t in texts])
            for doc, text, (found, score, ways) in zip(ids, texts, every, strict=True):
                other = ";".join(f"{a}:{sorted(d.items())}" for a, d in ways)
                out.append((doc, len(found), score / 1e6, [a / 1e6 for a, _ in ways[1:]], hashlib.sha256(found.tobytes()).hexdigest(), hashlib.sha256(other.encode()).hexdigest(), e.decode(found) == text, found)[: len(schema)])
            yield batch(schema, *(zip(*out, strict=True) if out else [[]] * len(schema)))

    sql = "doc_id long, n_tokens long, score double, gaps array<double>, ids_sha256 string, n_best_sha256 string, round_trip boolean"
    return as_bytes(docs).mapInArrow(run, sql + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    spark = encoded.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value)
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        for b in batches:
            yield batch(schema, b.column(0), [e.decode(np.array(x or [], np.int32)).decode("utf-8", "replace") for x in b.column(1).to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
