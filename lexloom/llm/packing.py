"""Best-fit packing of tokenized documents into sequences of a fixed capacity, by swap-based local search.

Documents are tokenized once; an end token is added, and only documents longer than the capacity are cut, into full pieces behind a first
one that holds the rest. Pieces are dealt into shards of at most SHARD pieces. A shard packs its pieces best fit first, the
longest piece first, and then searches: each underfull bin in turn, the fullest first, takes from the emptier ones what raises the
sum of squared fills most: a piece or two that fill it (move), a longer piece for one of its own (one for one), two for
one or one for two. The emptier bins lose what the fuller ones gain until they are empty.

Full bins are final. The underfull ones are dealt into new shards, where those of different shards meet, and searched again, from
where they are and from a new best fit of their pieces, as long as a round leaves fewer of them. The search ends sooner where none can be saved: when the free space of all bins
together is less than one sequence. Rounds read only the underfull bins of the round before, so each is a fraction of the last.

Defined results: a null text is empty and has the end token only; null or repeated ids and repeated rows are packed row by row;
an empty table gives an empty result; other columns are ignored; a very long text is tokenized whole, within one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import ship, stored
from lexloom.llm.vocabularies import BYTE_BPE, byte_bpe

CAPACITY, END, SHARD = 2048, 0, 8192

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECES}, sequence_id long, offset long, open boolean"
_PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_SCHEMA = pa.schema([*_PIECE_SCHEMA, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str = BYTE_BPE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each row's tokens, the end token included."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path)[0].encode_to_numpy
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or "", allowed_special="all"), END).astype("<u4")
                edges = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
                rows += [(doc, k, lo, hi - lo, zlib.crc32(ids[lo:hi])) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE_SCHEMA, strict=True)], schema=_PIECE_SCHEMA) if rows else pa.RecordBatch.from_pylist([], _PIECE_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, _PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: the longest piece first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    waiting: dict[int, list[int]] = defaultdict(list)  # bins by free space
    spaces = 0  # bit k: some bin has k free
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = spaces >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            at = waiting[free].pop()
            if not waiting[free]:
                spaces ^= 1 << free
            bins[at].append(i)
        else:
            free, at = capacity, len(bins)
            bins.append([i])
        if free > n:
            waiting[free - n].append(at)
            spaces |= 1 << (free - n)
    return bins


class Search:
    """Local search over bins of pieces. `bins` is changed in place; emptied bins stay as empty lists."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.home = {i: at for at, b in enumerate(bins) for i in b}
        self.pieces: dict[int, dict[int, None]] = defaultdict(dict)  # pieces on offer by length, those of the emptiest bins last
        self.have = self.mirror = 0  # bit n, or bit capacity - n: a piece of length n is on offer

    def offer(self, i: int) -> None:
        n = self.lengths[i]
        self.pieces[n][i] = None
        self.have |= 1 << n
        self.mirror |= 1 << (self.capacity - n)

    def withdraw(self, i: int) -> None:
        n = self.lengths[i]
        if self.pieces[n].pop(i, 0) is None and not self.pieces[n]:
            self.have ^= 1 << n
            self.mirror ^= 1 << (self.capacity - n)

    def put(self, i: int, at: int) -> None:
        old = self.home[i]
        self.bins[old].remove(i)
        self.bins[at].append(i)
        self.fill[old] -= self.lengths[i]
        self.fill[at] += self.lengths[i]
        self.home[i] = at

    def exchange(self, at: int, wanted: list[int], given: list[int]) -> None:
        """Bin `at` takes pieces of the wanted lengths, the longest first, and gives its own to the bin that the longest leaves."""
        donor = None
        for n in wanted:
            i = next(reversed(self.pieces[n]))
            self.withdraw(i)
            donor = self.home[i] if donor is None else donor
            self.put(i, at)
        for i in given:
            self.put(i, donor)
            self.offer(i)

    def two(self, total: int, least: int) -> list[int] | None:
        """Lengths on offer, x1 >= x2 and x1 >= least, that make up the total."""
        both = self.have & (self.mirror >> (self.capacity - total)) if 1 < total <= self.capacity else 0
        both = both >> (least := max(least, (total + 1) // 2)) << least
        while both:
            x = (both & -both).bit_length() - 1
            if 2 * x != total or len(self.pieces[x]) > 1:
                return [x, total - x]
            both ^= 1 << x
        return None

    def step(self, at: int) -> bool:
        """The exchange that gains bin `at` most, if any: one that fills it, else the longest move or one for one."""
        gap, own = self.capacity - self.fill[at], {self.lengths[i]: i for i in self.bins[at]}
        if self.have >> gap & 1:
            self.exchange(at, [gap], [])
            return True
        for n, i in own.items():
            if n + gap <= self.capacity and self.have >> (n + gap) & 1:
                self.exchange(at, [n + gap], [i])
                return True
        if found := self.two(gap, 0):
            self.exchange(at, found, [])
            return True
        for n, i in own.items():
            if found := self.two(n + gap, n):
                self.exchange(at, found, [i])
                return True
        for n, i in own.items():
            for m, j in own.items():
                if m < n and self.have >> min(n + m + gap, self.capacity + 1) & 1:
                    self.exchange(at, [n + m + gap], [i, j])
                    return True
        best, give = (self.have & ((1 << gap) - 1)).bit_length() - 1, []
        for n, i in own.items():
            if (x := (self.have & ((1 << (n + gap)) - 1)).bit_length() - 1 - n) > best:
                best, give = x, [i]
        if best < 1:
            return False
        self.exchange(at, [best + sum(self.lengths[i] for i in give)], give)
        return True

    def run(self) -> None:
        """One pass: the underfull bins, the fullest first, each as long as it gains from emptier ones."""
        left = [(-self.fill[at], at) for at in range(len(self.bins)) if self.fill[at] < self.capacity]
        for _, at in sorted(left):
            for i in self.bins[at]:
                self.offer(i)
        heapify(left)
        while left:
            fill, at = heappop(left)
            if -fill != self.fill[at]:  # it has given since
                if self.bins[at]:
                    heappush(left, (-self.fill[at], at))
                continue
            for i in self.bins[at]:
                self.withdraw(i)
            while self.fill[at] < self.capacity and self.step(at):
                pass


def searched(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Passes of the search as long as they empty bins."""
    while True:
        search = Search(lengths, bins, capacity)
        search.run()
        left = [b for b in bins if b]
        if len(left) == len(bins) or sum(capacity - sum(lengths[i] for i in b) for b in left) < capacity:
            return left
        bins = left


def _round(pieces: DataFrame, number: int, capacity: int) -> DataFrame:
    """Pack the pieces of each partition; those of one bin lie in one partition and start together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).select(_SCHEMA.names).cast(_SCHEMA)
        table = table.sort_by([(n, "ascending") for n in ("sequence_id", "length", "doc_id", "piece", "ids_crc32")])
        lengths, at = table.column("length").to_pylist(), table.column("sequence_id").to_pylist()
        starts = [best_fit(lengths, capacity)]
        if number:
            groups = defaultdict(list)
            for i, b in enumerate(at):
                groups[b].append(i)
            starts.append(list(groups.values()))
        bins = min((searched(lengths, b, capacity) for b in starts), key=len)
        first = (number << 56) + (TaskContext.get().partitionId() << 24)
        order = [i for b in bins for i in b]
        taken = table.take(order)
        of = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        ends = np.cumsum(taken.column("length").to_numpy())
        starts = ends - taken.column("length").to_numpy()
        size = np.bincount(of, weights=ends - starts, minlength=len(bins))
        head = np.concatenate(([0], np.cumsum([len(b) for b in bins])))[:-1]
        columns = [*taken.columns[:5], pa.array(first + of), pa.array(starts - starts[head][of]), pa.array((size < capacity)[of])]
        yield from pa.table(columns, schema=_SCHEMA).to_batches(max_chunksize=10_000)

    return pieces.mapInArrow(run, _PLACED)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str = BYTE_BPE, shard: int = SHARD) -> DataFrame:
    """One row a piece, with its sequence and its place there."""
    pieces = stored(cut(docs, capacity, path))
    now = pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long"), "open": F.lit(True)})
    done, number, before = [], 0, None
    rows = now.count()
    while True:
        shards = rows // shard + 1
        placed = stored(_round(now.repartition(shards, "sequence_id") if number else now.repartition(shards), number, capacity))
        rows, bins, size = placed.where("open").agg(F.count("*"), F.count_distinct("sequence_id"), F.sum("length")).first()
        saved, before = before is None or bins < before, bins
        if bins * capacity - (size or 0) < capacity or shards == 1 or not saved:
            done.append(placed)
            break
        done.append(placed.where("not open"))
        now, number = placed.where("open"), number + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("open")
