"""N-gram Jaccard join with several global token orders.

Documents link when the Jaccard similarity of their sets of word 5-grams reaches a threshold. Copies with equal sets
form one class, named by a 64-bit sum over the set, and take part as one.

1. Order by the words' rarity. A gram's estimated frequency comes from the corpus counts of its words (the WORDS most
   frequent are told apart); a class keeps the first `n - ceil(t n) + c` tokens of its set in that order, ties by hash.
   A linked pair has at least c of its common tokens in both prefixes, and chance phrases of common words are in few.
2. Order by the grams' rarity. Within that prefix tokens are ordered by document frequency, then hash. The rarest common
   token of a linked pair is followed by c - 1 common ones, so dropping the c - 1 most frequent of a prefix never loses
   it, while frequent passages drop out. Classes left with fewer than c shared tokens are out.
3. Two orders by independent scramblings of the tokens, over the whole sets. Linked sets share a token among the first
   `n - ceil(t n) + 1` of each in any order; a candidate pair must do so in both, or is out before verification. Sets
   with little in common seldom do.
4. Verification compares the sets. All members of a token's bucket are first compared with a pivot, the class that
   shares most. The links found give components; then, among the members that met one pivot, those outside its component
   are compared with each other and with its component, in tiles of about TILE by TILE sets or TILE_TOKENS tokens a side. So a group of thousands of
   near copies costs about one comparison each, and no link between components is lost. `pairs` instead compares all
   members that met a pivot with each other, and gives every link between different sets.

Tokens move as packed arrays, a few rows for each task.

Defined results: a text of fewer words than the gram is one gram; null and empty texts have an empty set, no links
and their own id as component; rows with equal ids are judged one by one and each get their row; a null id takes
the smallest id of its component, and null if there is none; very long texts are hashed in one piece; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import SPACES, RunHash, Words, as_bytes, attach, batch, buckets_for, chunks, mixed, ship, stored
from lexloom.llm.components import components
from lexloom.llm.masked_lm import word_counts

GRAM, PERCENT = 5, 75
SLACK = 16
WORDS, TILE, TILE_TOKENS = 4096, 512, 1 << 18
HELD = 200_000
_ORDERS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)

_U = np.uint64


class WordScores:
    """16 times the log2 corpus count of the most frequent words, 0 for others; whole numbers, so that sums are exact."""

    def __init__(self, docs: DataFrame | None = None, words: int = WORDS):
        top = word_counts(docs).orderBy(F.desc("n"), "word").limit(words).collect() if docs is not None else []
        table = sorted((r.word & ((1 << 64) - 1), round(16 * math.log2(r.n + 1))) for r in top)
        self.hashes = np.array([t[0] for t in table], _U)
        self.scores = np.array([t[1] for t in table], np.int64)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.scores[at], 0)


def token_sets(texts: list[bytes], gram: int = GRAM, scores: WordScores | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, first, estimates): the sorted distinct gram hashes of text i are tokens[first[i]:first[i + 1]]."""
    w = Words(texts, SPACES, lower=True)
    run = RunHash(w.hash, (1, gram))
    start, text = w.windows(gram)
    end = start + gram
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < gram))
    if len(short):
        start, end, text = (np.concatenate(x) for x in ((start, w.first[short]), (end, w.first[short] + counts[short]), (text, short)))
    token = run(start, end)
    total = np.concatenate(([0], np.cumsum(scores(w.hash)))) if scores else np.zeros(len(w) + 1, np.int64)
    order = np.lexsort((token, text))
    token, text = token[order], text[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    order = order[new]
    return token[new], np.searchsorted(text[new], np.arange(len(texts) + 1)), total[end[order]] - total[start[order]]


def class_keys(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit sum over each set, which does not depend on the order of its tokens."""
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(mixed(token ^ _U(0x9E3779B97F4A7C15)))))
    return mixed(sums[first[1:]] - sums[first[:-1]] + (first[1:] - first[:-1]).astype(_U))


def slack(n: np.ndarray) -> np.ndarray:
    return 1 + n // SLACK


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with any linked set."""
    return -(-percent * n // 100)


def packed(schema: pa.Schema, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each bucket, its columns as bytes."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    keys, start = np.unique(bucket[order], return_index=True)
    ends = np.append(start[1:], len(order))
    sorted_columns = [c[order] for c in columns]
    yield batch(schema, keys, *([c[s:e].tobytes() for s, e in zip(start, ends, strict=True)] for c in sorted_columns))


def unpacked(table: pa.Table, dtypes: list) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(i + 1).to_pylist()), t) for i, t in enumerate(dtypes)]


def _bucket(token: np.ndarray, n: int) -> np.ndarray:
    return ((token >> _U(40)) % _U(n)).astype(np.int32)


_SIG = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64())])


def signatures(docs: DataFrame, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            token, first, _ = token_sets(texts, gram)
            yield batch(_SIG, ids, np.diff(first), class_keys(token, first).view(np.int64))

    return as_bytes(docs).mapInArrow(run, "doc_id long, n long, cls long")


_POST = pa.schema([("bucket", pa.int32()), ("token", pa.binary()), ("cls", pa.binary()), ("n", pa.binary())])
_POST_SQL = "bucket int, token binary, cls binary, n binary"


def word_prefixes(docs: DataFrame, gram: int, percent: int, buckets: int, scores: WordScores) -> DataFrame:
    """Packed (token, class, set size) of the prefixes by rarity of words; copies within a stretch of a task count once."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        token, cls, n = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from packed(_POST, _bucket(token, buckets), token, cls, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for _, texts in chunks(batches):
            token, first, rarity = token_sets(texts, gram, shared.value)
            cls, n = class_keys(token, first), np.diff(first)
            fresh = np.array([n[i] > 0 and not (c in seen or seen.add(c)) for i, c in enumerate(cls.tolist())], bool)
            length = np.minimum(np.where(fresh, n - need(n, percent) + slack(n), 0), n)
            order = np.lexsort((token, rarity, np.repeat(np.arange(len(n)), n)))
            at = order[np.repeat(first[:-1], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)]
            held.append([token[at], np.repeat(cls, length), np.repeat(n, length).astype(np.int32)])
            size += len(at)
            if size > HELD:
                yield from flush(held)
                held, size, seen = [], 0, set()
        if size:
            yield from flush(held)

    return as_bytes(docs).mapInArrow(run, _POST_SQL)


_SHARED = pa.schema([("bucket", pa.int32()), ("cls", pa.binary()), ("token", pa.binary()), ("n", pa.binary()), ("df", pa.binary())])


def shared_tokens(prefixes: DataFrame, buckets: int) -> DataFrame:
    """Of each token bucket the postings of tokens that two classes or more hold, with that number, packed by class."""

    def run(table: pa.Table) -> pa.Table:
        token, cls, n = unpacked(table, [_U, _U, np.int32])
        order = np.lexsort((cls, token))
        token, cls, n = token[order], cls[order], n[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls, n = token[keep], cls[keep], n[keep]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        df = np.repeat(np.diff(np.append(start, len(token))), np.diff(np.append(start, len(token))))
        two = df > 1
        return pa.Table.from_batches(packed(_SHARED, _bucket(cls[two], buckets), cls[two], token[two], n[two], df[two].astype(np.int32)), _SHARED)

    return prefixes.groupBy("bucket").applyInArrow(run, "bucket int, cls binary, token binary, n binary, df binary")


_KEPT = pa.schema([("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("weight", pa.int64())])


def rare_prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """A row for each token that a class keeps in the order by rarity.

    The weight, how much of the set is shared with how many, ranks classes as pivots."""

    def run(table: pa.Table) -> pa.Table:
        cls, token, n, df = unpacked(table, [_U, _U, np.int32, np.int32])
        order = np.lexsort((token, df, cls))
        c, size = cls[order], n[order]
        start = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(c)))
        rank = np.arange(len(c)) - np.repeat(start, count)
        least = slack(size)
        kept = (np.repeat(count, count) >= least) & (rank < np.repeat(count, count) - (least - 1))
        sums = np.concatenate(([0.0], np.cumsum(np.log2(df[order]))))
        weight = np.repeat(sums[np.append(start[1:], len(c))] - sums[start], count) * 1000 / size if len(c) else np.zeros(0)
        return pa.Table.from_batches([batch(_KEPT, token[order][kept].view(np.int64), c[kept].view(np.int64), size[kept].astype(np.int64), weight[kept].astype(np.int64))], _KEPT)

    return shared.groupBy("bucket").applyInArrow(run, "token long, cls long, n long, weight long")


def scrambled_prefix(tokens: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 tokens in an order by scrambling, cut to 32 bits (which can only add agreements)."""
    h = np.sort(mixed(tokens ^ _U(order)))
    return (h[: len(h) - int(need(np.int64(len(h)), percent)) + 1] >> _U(32)).astype(np.uint32).view(np.int32)


def candidate_sets(docs: DataFrame, sig: DataFrame, kept: DataFrame, gram: int, percent: int) -> DataFrame:
    """(cls, tokens, second, third): the whole set, sorted, of each class that is still in, from its first document, and
    its prefixes under the two scrambled orders. A class without an id is found by its key."""
    least = stored(sig.join(kept.select("cls").distinct().hint("merge"), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id")))
    chosen = attach(as_bytes(docs), least.where("doc_id is not null"), "doc_id", "inner").select("cls", "text")
    nameless = as_bytes(docs.where("doc_id is null")).select(F.lit(None).cast("long").alias("cls"), "text")
    schema = pa.schema([("cls", pa.int64()), ("tokens", pa.binary()), ("second", pa.list_(pa.int32())), ("third", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wanted, texts in chunks(batches):
            token, first, _ = token_sets(texts, gram)
            own = class_keys(token, first).view(np.int64).tolist()
            rows = [i for i, c in enumerate(wanted) if (c is None or own[i] == c) and first[i + 1] > first[i]]
            sets = [token[first[i] : first[i + 1]] for i in rows]
            yield batch(schema, [own[i] for i in rows], [x.tobytes() for x in sets], *([scrambled_prefix(x, o, percent) for x in sets] for o in _ORDERS))

    sql = "cls long, tokens binary, second array<int>, third array<int>"
    rest = attach(nameless.mapInArrow(run, sql), least.where("doc_id is null").select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
    return chosen.mapInArrow(run, sql).unionByName(rest)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of the pairs that share a token in both scrambled prefixes; the others can't be linked."""
    side = lambda x, *names: sets.select(F.col("cls").alias(x), *(F.col(n).alias(f"{n}_{x}") for n in names)).hint("merge")
    both = pairs.join(side("a", "second", "third"), "a").join(side("b", "second", "third"), "b")
    some = both.where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")
    full = some.join(side("b", "tokens"), "b").join(side("a", "tokens"), "a").select("a", "b", "tokens_a", "tokens_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])
        for x in batches:
            out = []
            for p, q in zip(x.column(2), x.column(3), strict=True):
                p, q = np.frombuffer(p.as_buffer(), _U), np.frombuffer(q.as_buffer(), _U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch(schema, x.column(0), x.column(1), out)

    return full.mapInArrow(run, "a long, b long, linked boolean")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of a few sets, by products of 0/1 matrices over the tokens that two or more hold."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    token, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    column = (np.cumsum(count > 1) - 1)[column[keep]]
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, [lo, lo + 2048])
        m = np.zeros((len(sets), 2048), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def compare_tiles(members: DataFrame, sets: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Links among the classes of each tile (p, i, j), side 0 with side 1, or all if there is one side: those that join
    different components, or every one."""

    def run(table: pa.Table) -> pa.Table:
        cls, comp, side = (table.column(n).to_numpy() for n in ("cls", "comp", "side"))
        tokens = [np.frombuffer(x, _U) for x in table.column("tokens").to_pylist()]
        size = np.array([len(x) for x in tokens])
        common, one_side = overlaps(tokens), side.min() == side.max()
        parent = {c: c for c in comp.tolist()}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for lo in range(0, len(cls), 128):
            rows = slice(lo, lo + 128)
            both = common[rows].astype(np.int64)
            linked = (100 * both >= percent * (size[rows, None] + size[None, :] - both)) & (np.arange(len(cls)) > np.arange(len(cls))[rows, None])
            linked &= one_side | (side[rows, None] != side[None, :])
            linked &= (cls[rows, None] != cls[None, :]) if every else (comp[rows, None] != comp[None, :])
            for i, j in zip(*np.nonzero(linked), strict=True):
                x, y = root(int(comp[lo + i])), root(int(comp[j]))
                if every or x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((cls[lo + i], cls[j]))
        return pa.Table.from_batches([batch(_LINK, [o[0] for o in out], [o[1] for o in out])], _LINK)

    full = members.join(sets.select("cls", "tokens").hint("merge"), "cls")
    return full.groupBy("p", "i", "j").applyInArrow(run, "a long, b long")


def tiles(met: DataFrame, tile: int) -> DataFrame:
    """(p, i, j, side, cls, comp): of the classes that met pivot p, those outside its component (side 1) in tiles with
    each other (j <= -1 stands for a tile of theirs) and with its component (side 0)."""
    away = F.col("comp") != F.col("home")
    load = F.lit(1 / tile) + F.col("n") / TILE_TOKENS  # of a tile, by number of sets and by tokens
    count = met.groupBy("p").agg(F.sum(F.when(away, load).otherwise(0.0)).alias("l1"), F.sum(F.when(away, 0.0).otherwise(load)).alias("l0")).where("l1 > 0")
    sized = met.join(count, "p").select("p", "cls", "comp", F.expr("if(comp = home, 0, 1)").alias("side"), F.ceil("l1").cast("int").alias("t1"), F.ceil("l0").cast("int").alias("t0"))
    spot = F.pmod(F.xxhash64("cls"), F.when(F.col("side") == 1, F.col("t1")).otherwise(F.greatest("t0", F.lit(1)))).cast("int")
    placed = sized.withColumn("s", spot)
    home = placed.where("side = 0").select("p", F.explode(F.expr("sequence(0, t1 - 1)")).alias("i"), F.col("s").alias("j"), "side", "cls", "comp")
    away = placed.where("side = 1 and t0 > 0").select("p", F.col("s").alias("i"), F.explode(F.expr("sequence(0, t0 - 1)")).alias("j"), "side", "cls", "comp")
    among = placed.where("side = 1").select("p", "s", F.explode(F.expr("sequence(0, t1 - 1)")).alias("o"), "cls", "comp").select("p", F.least("s", "o").alias("i"), (-1 - F.greatest("s", "o")).alias("j"), F.when(F.col("s") <= F.col("o"), 0).otherwise(1).alias("side"), "cls", "comp")
    return home.unionByName(away).unionByName(among)


def candidates(docs: DataFrame, gram: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, sets, met): a row per document, the sets of classes still in, and the classes b (of n tokens) that met a pivot a."""
    ship(docs.sparkSession)
    buckets = buckets_for(docs)
    sig = stored(signatures(docs, gram))
    kept = stored(rare_prefixes(shared_tokens(word_prefixes(docs, gram, percent, buckets, WordScores(docs)), buckets), percent))
    sets = stored(candidate_sets(docs, sig, kept, gram, percent))
    pivot = kept.groupBy("token").agg(F.max(F.struct("weight", "cls", "n")).alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = stored(kept.join(pivot.hint("merge"), "token").select(F.col("p.cls").alias("a"), F.col("cls").alias("b"), "n", F.expr(f"{percent} * greatest(n, p.n) <= 100 * least(n, p.n)").alias("fits")).distinct())
    return sig, sets, met


def links(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(signatures, links): a row per document, and verified links (a, b) of classes that connect all that is linked."""
    sig, sets, met = candidates(docs, gram, percent)
    found = stored(verified(met.where("a <> b and fits").select("a", "b"), sets, percent)).where("linked").select("a", "b")
    label = stored(components(found, "a", "b"))
    named = attach(met.select(F.col("a").alias("p"), F.col("b").alias("cls"), "n"), label.select(F.col("node").alias("cls"), F.col("component").alias("comp")), "cls")
    named = attach(named, label.select(F.col("node").alias("p"), F.col("component").alias("home")), "p")
    rest = stored(tiles(named.select("p", "cls", "n", F.coalesce("comp", "cls").alias("comp"), F.coalesce("home", "p").alias("home")), tile))
    return sig, found.unionByName(stored(compare_tiles(rest, sets, percent)))


def pairs(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(signatures, links): a row per document with its class, and every link (a < b) between classes."""
    sig, sets, met = candidates(docs, gram, percent)
    rest = stored(tiles(met.select(F.col("a").alias("p"), F.col("b").alias("cls"), "n", F.col("b").alias("comp"), F.col("a").alias("home")), tile))
    found = compare_tiles(rest, sets, percent, every=True)
    return sig, found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each document."""
    sig, found = links(docs, gram, percent)
    label = components(found, "a", "b").withColumnRenamed("node", "cls")
    classes = sig.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = attach(classes, label, "cls").withColumn("component", F.coalesce("component", "cls"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = attach(named, ids, "component", "inner").select("cls", "component_id")
    full = attach(sig.withColumn("cls", F.expr("if(n > 0, cls, null)")), by_class, "cls")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
