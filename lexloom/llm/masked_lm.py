"""Masked pseudo-likelihood of documents under a bidirectional window network trained in NumPy.

Word counts over the whole corpus give a vocabulary of the VOCABULARY most frequent words; all other words share one
entry. The network sees the embeddings of the RADIUS words on either side of a masked word and predicts the word by a
hierarchical softmax: a softmax over classes of about equal mass, then in each class a Huffman tree over the counts with
the words as leaves, where the network gives the probability of each turn on the way to a leaf. So all words' probabilities sum to one. A document's score is the sum over all of
its words of the log-probability of the word given both sides. Words outside the vocabulary take equal shares of theirs.

In training the places of each document's words modulo MASK are dealt over the rounds, so every word of the corpus is
masked (with over MASK rounds again in turn). Documents are dealt to shards of about SHARD_WORDS words by a hash of id and text; each
shard trains from the same start on its documents in order of their ids, and the shards' networks are averaged by their number of
masked words, in order of the shards. Neither partitions nor tasks change the result.

Only the counts of the vocabulary and the averaged parameters (both of a fixed size) reach the driver.

Defined results: null and empty texts have no words, a score of 0 and no mean; a corpus without words gives every
text that; very long texts are one row of a shard, two bytes a word; repeated rows each get their row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import SPACES, Words, as_bytes, batch, chunks, ship, stored

VOCABULARY, CLASSES, RADIUS, DIM, HIDDEN = 8192, 64, 2, 8, 16
MASK, ROUNDS, BATCH, RATE, SEED = 8, 2, 2048, 0.15, 3
SHARD_WORDS, SEGMENTS = 2_000_000, 64
HELD = 1_000_000
_ID = np.uint16  # holds every id: words, others, padding


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, n) over all documents; each task adds up stretches before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return batch(schema, word.view(np.int64), n)

        for _, texts in chunks(batches):
            held.append(Words(texts, SPACES, lower=True).hash)
            size += len(held[-1])
            if size > HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return as_bytes(docs).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Word ids by hash, the class of each id, its path in the class's Huffman tree and the log share of a word in its id.
    The last id stands for all other words and has a class of its own."""

    def __init__(self, counts: DataFrame, size: int = VOCABULARY, classes: int = CLASSES):
        counts = stored(counts)
        total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).first()
        top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
        self.words, self.total = len(top), total.n or 0
        hashes = np.array([r.word for r in top], np.int64).view(np.uint64)
        self.rest = max((total.types or 0) - len(top), 1)
        self.share = np.append(np.zeros(len(top)), -math.log(self.rest))
        self.id_of = np.argsort(hashes)
        self.sorted = hashes[self.id_of]
        self._classes([r.n for r in top], classes)

    def _classes(self, weights: list[int], classes: int) -> None:
        """Classes of about equal mass in order of frequency, and the trees; weights are those of the words."""
        mass, total = 0, max(sum(weights), 1)
        self.class_of = np.zeros(len(weights) + 1, np.int64)
        heaps: dict[int, list] = {}
        for i, n in enumerate(weights):
            self.class_of[i] = mass * classes // total
            heaps.setdefault(int(self.class_of[i]), []).append((n, i))
            mass += n
        self.class_of[-1] = classes
        used, self.class_of = np.unique(self.class_of, return_inverse=True)  # a very frequent word leaves classes empty
        self.classes = len(used)
        up, sign, count = {}, {}, len(weights) + 1
        for heap in heaps.values():
            heapq.heapify(heap)
            while len(heap) > 1:
                (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
                up[x] = up[y] = count
                sign[x], sign[y] = -1, 1
                heapq.heappush(heap, (a + b, count))
                count += 1
        nodes, turns, self.first = [], [], [0]
        for leaf in range(len(weights) + 1):
            at = leaf
            while at in up:
                nodes.append(up[at] - len(weights) - 1)
                turns.append(sign[at])
                at = up[at]
            self.first.append(len(nodes))
        self.nodes, self.turns, self.first = np.array(nodes, _ID), np.array(turns, np.float32), np.array(self.first)
        self.inner = count - len(weights) - 1

    def paths(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, turns, row of each, rows with any, first of each of those) of the ways from the roots to the given leaves."""
        start = self.first[ids]
        n = self.first[ids + 1] - start
        some = np.flatnonzero(n)
        start, n = start[some], n[some]
        begin = np.cumsum(n) - n
        at = np.repeat(start - begin, n) + np.arange(int(n.sum()))
        return self.nodes[at], self.turns[at], np.repeat(some, n), some, begin

    def ids(self, words: np.ndarray) -> np.ndarray:
        if not self.words:
            return np.zeros(len(words), _ID)
        at = np.minimum(np.searchsorted(self.sorted, words), self.words - 1)
        return np.where(self.sorted[at] == words, self.id_of[at], self.words).astype(_ID)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each): the keys' places by key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.append(True, k[1:] != k[:-1]))


class Network:
    """Embeddings of the words on both sides, one tanh layer, a turn at each node of the tree. Ids are words, others, padding."""

    def __init__(self, lexicon: Lexicon):
        rng, wide = np.random.default_rng(SEED), 2 * RADIUS * DIM
        self.lexicon = lexicon
        inner = max(lexicon.inner, 1)
        shapes = {"e": (lexicon.words + 2, DIM), "w": (wide, HIDDEN), "b": (HIDDEN,), "s": (HIDDEN, lexicon.classes), "t": (lexicon.classes,), "u": (inner, HIDDEN), "c": (inner,)}
        scale = {"e": 0.3, "w": wide**-0.5}
        self.p = {k: (rng.standard_normal(s) * scale.get(k, 0)).astype(np.float32) for k, s in shapes.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, values: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = values[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def hidden(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.take(self.p["e"], near, axis=0).reshape(len(near), -1)
        return x, np.tanh(x @ self.p["w"] + self.p["b"])

    def log_probabilities(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target word given the words on both sides."""
        _, h = self.hidden(near)
        z = h @ self.p["s"] + self.p["t"]
        own = z[np.arange(len(target)), self.lexicon.class_of[target]].astype(np.float64)
        top = z.max(1)
        z -= top[:, None]
        out = own - top - np.log(np.exp(z, out=z).sum(1))
        nodes, turns, row, some, begin = self.lexicon.paths(target)
        if len(nodes):
            z = turns * (np.einsum("ij,ij->i", np.take(self.p["u"], nodes, axis=0), np.take(h, row, axis=0)) + np.take(self.p["c"], nodes))
            out[some] += np.add.reduceat(-np.log1p(np.exp(-np.clip(z, -30, 30))).astype(np.float64), begin)
        return out

    def class_shares(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.p["s"] + self.p["t"]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def train(self, near: np.ndarray, target: np.ndarray, past: dict[str, np.ndarray]) -> None:
        """One step of Adagrad."""
        x, h = self.hidden(near)
        dz = self.class_shares(h)
        dz[np.arange(len(target)), self.lexicon.class_of[target]] -= 1
        dz /= len(target)
        dh, grads = dz @ self.p["s"].T, []
        nodes, turns, row, some, begin = self.lexicon.paths(target)
        if len(nodes):
            u, hr = np.take(self.p["u"], nodes, axis=0), np.take(h, row, axis=0)
            z = turns * (np.einsum("ij,ij->i", u, hr) + np.take(self.p["c"], nodes))
            d = -turns / (1 + np.exp(np.clip(z, -30, 30))) / len(target)
            u *= d[:, None]
            dh[some] += np.add.reduceat(u, begin)
            hr *= d[:, None]
            order, head = grouped(nodes)
            at = nodes[order[head]]
            grads += [("u", at, np.add.reduceat(np.take(hr, order, axis=0), head)), ("c", at, np.add.reduceat(d[order], head))]
        dh *= 1 - h * h
        dx = (dh @ self.p["w"].T).reshape(-1, DIM)
        flat = near.ravel()
        order, head = grouped(flat)
        grads += [("e", flat[order[head]], np.add.reduceat(np.take(dx, order, axis=0), head)), ("w", slice(None), x.T @ dh), ("b", slice(None), dh.sum(0)), ("s", slice(None), h.T @ dz), ("t", slice(None), dz.sum(0))]
        for k, rows, g in grads:
            total = past[k][rows] + g * g
            past[k][rows] = total
            self.p[k][rows] -= RATE * g / np.sqrt(total + 1e-8)


_SIDES = np.array([*range(-RADIUS, 0), *range(1, RADIUS + 1)])


def padded(ids: np.ndarray, first: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids with RADIUS paddings around each text, place of each word in it); the texts are first[i]:first[i + 1]."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(ids)) + RADIUS * (text + 1)
    out = np.full(len(ids) + RADIUS * len(first), padding, _ID)
    out[place] = ids
    return out, place


def windows(around: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The ids on both sides of the words at these places."""
    return around[place[:, None] + _SIDES]


def masked(first: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The words that round `turn` masks; the texts are first[i]:first[i + 1]. Over the rounds that is every word."""
    place = np.arange(first[-1]) - first[:-1].repeat(np.diff(first))
    cycle = min(rounds, MASK)
    return np.flatnonzero(place % MASK % cycle == turn % cycle)


def shards(docs: DataFrame, lexicon: Lexicon, words_each: int = SHARD_WORDS) -> DataFrame:
    """(shard, doc_id, ids): a row for each document with its word ids, packed, in shards of about words_each words."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    n = lexicon.total // words_each + 1
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.expr(f"pmod(xxhash64(doc_id, text), {n}L)").alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            for ids, texts in chunks(iter([b])):
                w = Words(texts, SPACES, lower=True)
                word, first = shared.value.ids(w.hash), w.first.tolist()
                yield batch(schema, b.column(2).slice(lo, len(ids)), ids, [word[x:y].tobytes() for x, y in zip(first, first[1:], strict=False)])
                lo += len(ids)

    return rows.mapInArrow(run, "shard long, doc_id long, ids binary")


_PART = pa.schema([("segment", pa.int32()), ("shard", pa.int64()), ("weight", pa.float64()), ("p", pa.binary())])
_PART_SQL = "segment int, shard long, weight double, p binary"


def _added(table: pa.Table, shard: int) -> pa.Table:
    """The weighted sum of one segment of the parameters, in order of the shards."""
    table = table.sort_by("shard")
    total = np.zeros(0)
    for p in table.column("p"):
        p = np.frombuffer(p.as_buffer(), np.float64)
        total = total + p if len(total) else p
    return pa.Table.from_batches([batch(_PART, [table.column("segment")[0].as_py()], [shard], [float(np.sum(table.column("weight").to_numpy()))], [total.tobytes()])], _PART)


def shard_step(shared, turn: int, rounds: int):
    """Training of one shard in round `turn`, from the shared start: its parameters times its masked words, in segments."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        start = shared.value
        own = Network(start.lexicon)
        own.load(start.flat())
        past = {k: np.zeros_like(v) for k, v in own.p.items()}
        blobs = [x.as_buffer() for x in table.column("ids")]
        first = np.concatenate(([0], np.cumsum([len(x) // 2 for x in blobs])))
        ids = np.frombuffer(b"".join(blobs), _ID)
        around, place = padded(ids, first, own.lexicon.words + 1)
        at = np.random.default_rng(SEED + turn).permutation(masked(first, turn, rounds))
        for lo in range(0, len(at), BATCH):
            rows = at[lo : lo + BATCH]
            own.train(windows(around, place[rows]), ids[rows], past)
        parts = np.array_split(own.flat().astype(np.float64) * len(at), SEGMENTS)
        number = table.column("shard")[0].as_py()
        return pa.Table.from_batches([batch(_PART, list(range(SEGMENTS)), [number] * SEGMENTS, [float(len(at))] * SEGMENTS, [p.tobytes() for p in parts])], _PART)

    return run


def train(docs: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS, words_each: int = SHARD_WORDS) -> Network:
    """A network trained on the documents."""
    return train_on(stored(shards(docs, lexicon, words_each)), lexicon, rounds, words_each)


def train_on(texts: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS, words_each: int = SHARD_WORDS) -> Network:
    """Each shard trains on all of its documents; the parameters are averaged over the shards after each round."""
    spark, net = texts.sparkSession, Network(lexicon)
    if not lexicon.words:
        return net
    groups = math.isqrt(lexicon.total // words_each + 1) + 1
    texts = texts.where("octet_length(ids) > 0")

    def near(table: pa.Table) -> pa.Table:
        return _added(table, table.column("shard")[0].as_py() % groups)

    def whole(table: pa.Table) -> pa.Table:
        return _added(table, 0)

    for turn in range(rounds):
        parts = texts.groupBy("shard").applyInArrow(shard_step(spark.sparkContext.broadcast(net), turn, rounds), _PART_SQL)
        rows = parts.groupBy("segment", F.expr(f"shard % {groups}")).applyInArrow(near, _PART_SQL).groupBy("segment").applyInArrow(whole, _PART_SQL).collect()
        rows.sort(key=lambda r: r.segment)
        weight = rows[0].weight if rows else 0
        if weight:
            net.load(np.concatenate([np.frombuffer(r.p, np.float64) for r in rows]) / weight)
    return net


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("pseudo_log_likelihood", pa.float64()), ("per_word", pa.float64())])


def score(docs: DataFrame, lexicon: Lexicon, net: Network) -> DataFrame:
    """The row of each document, of any documents."""
    return score_on(shards(docs, lexicon), net)


def score_on(texts: DataFrame, net: Network) -> DataFrame:
    """The row of each document, from its word ids."""
    shared = texts.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lex = model.lexicon
        for doc, blobs in chunks(batches):
            first = np.concatenate(([0], np.cumsum([len(x) // 2 for x in blobs])))
            word = np.frombuffer(b"".join(blobs), _ID)
            around, place = padded(word, first, lex.words + 1)
            total = lex.share[word]
            for lo in range(0, len(word), BATCH):  # always BATCH rows, so that a word's products don't hang on its neighbours in the block
                at = np.minimum(np.arange(lo, lo + BATCH), len(word) - 1)
                total[lo : lo + BATCH] += model.log_probabilities(windows(around, place[at]), word[at])[: len(word) - lo]
            n = np.diff(first)
            pll = np.zeros(len(n))
            if len(word):
                pll[n > 0] = np.add.reduceat(total, first[:-1][n > 0])
            yield batch(_OUT, doc, n, np.round(pll, 4), [round(p / k, 6) if k else None for p, k in zip(pll.tolist(), n.tolist(), strict=True)])

    return texts.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_words long, pseudo_log_likelihood double, per_word double")


def fit_and_score(docs: DataFrame, rounds: int = ROUNDS, words_each: int = SHARD_WORDS) -> DataFrame:
    """Train on all documents and score each of them; the words are looked up once for both."""
    ship(docs.sparkSession)
    lexicon = Lexicon(word_counts(docs))
    texts = stored(shards(docs, lexicon, words_each))
    return score_on(texts, train_on(texts, lexicon, rounds, words_each))
