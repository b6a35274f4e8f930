"""Alignment, packing and spelling variants against brute force."""

import random
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import alignment, packing, variants, vocabularies

DIR = "/root/testdata/sf0.001"
LETTERS = "ab  \n\t  　.,'1é<|endoftext|>😀 \x00\x1f\x85​-ſ▁"
LOOSE = "doc_id long, text string, id long, i int, a int, j int, b int, word string, run string, h int, n long, near string, g int, place int, pair int, piece int, open boolean, sequence_id string, offset string, length int"


def loose(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "w", "r", 6, 7, "n", 8, 9, 10, 11, True, "s", "o", 12) for r in rows], LOOSE).repartition(parts)


def odd_texts():
    r = random.Random(3)
    rows = [(None, None), (None, "null id"), (1, ""), (2, " "), (3, "  "), (4, "x"), (4, "x"), (5, "a▁b"), (6, "a " * 5000), (7, "ab" * 20_000), (8, " x"), (9, "x "), (9, "another text of the id")]
    return rows + [(10 + i, "".join(r.choice(LETTERS[:-1] if i % 3 else "ab cd\n ") for _ in range(r.randint(1, 60)))) for i in range(300)]


def given(spark):
    return [(x.doc_id, x.text) for x in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(df, columns):
    return sorted((tuple(x[c] for c in columns) for x in df.collect()), key=str)


# ---------------------------------------------------------------- alignment


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("which", ["odd", "given"])
def test_alignment_is_that_of_brute_force(spark, which, monkeypatch):
    rows = odd_texts() if which == "odd" else given(spark)
    monkeypatch.setattr(alignment, "MAX_CHUNKS", 150)  # starts afresh again and again
    assert rows_of(alignment.align(loose(spark, rows)), ALIGNED) == sorted(brute.op11(rows), key=str)


def test_no_pair_lies_outside_the_bound(spark):
    codes = set(alignment.pair_codes(vocabularies.BYTE_BPE, vocabularies.PIECE_BPE).tolist())
    known = alignment.Aligner(vocabularies.BYTE_BPE, vocabularies.PIECE_BPE)
    known.parts([t for _, t in given(spark)[:40]])
    a, b = known.sql.execute("SELECT a_id, b_id FROM cut").fetchnumpy().values()
    assert len(a) and set((a.astype(np.int64) * len(known.b_bytes) + b).tolist()) <= codes


def test_overlaps_and_groups_of_two_token_rows():
    known = alignment.Aligner(vocabularies.BYTE_BPE, vocabularies.PIECE_BPE)
    known.overlaps(np.array([1, 2, 3]), np.array([2, 5, 9]), np.array([4, 5]), np.array([5, 9]))
    assert sorted(known.sql.execute("SELECT i, j FROM overlap").fetchall()) == [(0, 0), (1, 0), (2, 1)]
    assert known.sql.execute("SELECT i, j, g FROM cut ORDER BY g").fetchall() == [(1, 0, 0), (2, 1, 1)]
    assert known.sql.execute(alignment.GROUP_OF.format("i", "a")).fetchall() == [(0, 0), (1, 0), (2, 1)]


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(loose(spark, [(1, "x")]).limit(0)).collect() == []


def test_both_libraries_give_the_same_ids():
    a = Tokenizer.from_file(vocabularies.BYTE_BPE)
    own, r = vocabularies.byte_bpe()[0], random.Random(5)
    marks = [c for c in range(1, 0x3000)] + [r.randrange(0x3000, 0x110000) for _ in range(20_000)]
    texts = [f"a{chr(c)}b 1{chr(c)} {chr(c)}.{chr(c)}" for c in marks if not 0xD800 <= c < 0xE000] + [t or "" for _, t in odd_texts()]
    a.encode_special_tokens = True
    assert [x.ids for x in a.encode_batch(texts, add_special_tokens=False)] == list(map(own.encode_ordinary, texts))
    a.encode_special_tokens = False
    assert [x.ids for x in a.encode_batch(texts, add_special_tokens=False)] == [own.encode(t, allowed_special="all") for t in texts]


# ---------------------------------------------------------------- packing


def check_packing(rows, pieces, capacity=2048):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(pieces, key=str)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(held), -(-sum(p[3] for p in pieces) // capacity)


@pytest.mark.parametrize("shard", [packing.SHARD, 40])
def test_packing(spark, shard):
    for rows in (odd_texts(), given(spark)):
        used, least = check_packing(packing.pack(loose(spark, rows), shard=shard).collect(), brute.op12_pieces(rows))
        assert used <= least + 1
    small = given(spark)[:60]
    check_packing(packing.pack(loose(spark, small), capacity=300, shard=25).collect(), brute.op12_pieces(small, 300), 300)
    assert packing.pack(loose(spark, small).limit(0)).collect() == []


def squares(lengths, bins):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_every_exchange_raises_the_sum_of_squares(seed, monkeypatch):
    r = random.Random(seed)
    lengths = [r.randint(1, (100, 60, 30, 100, 9, 99)[seed]) for _ in range(300)]
    bins = [[i] for i in range(300)] if seed % 2 else packing.best_fit(lengths, 100)
    seen, plain = [], packing.Search.step

    def step(self, at):
        before = squares(lengths, self.bins)
        gained = plain(self, at)
        assert (squares(lengths, self.bins) > before) == gained
        assert all(sum(lengths[i] for i in b) == f <= 100 for b, f in zip(self.bins, self.fill, strict=True))
        seen.append(gained)
        return gained

    monkeypatch.setattr(packing.Search, "step", step)
    left = packing.searched(lengths, [list(b) for b in bins], 100)
    assert sorted(i for b in left for i in b) == list(range(300)) and len(left) <= len(bins)
    if seed % 2:
        assert any(seen) and len(left) <= len(packing.best_fit(lengths, 100)) * 1.1


@pytest.mark.parametrize(
    "bins, full",
    [
        ([[60, 30], [10, 5]], 1),  # move
        ([[60, 30], [40, 2]], 1),  # one for one: 40 for 30
        ([[60, 30], [33, 7]], 1),  # two for one: 33 and 7 for 30
        ([[60, 20, 15], [40]], 1),  # one for two: 40 for 20 and 15
        ([[60, 30], [6, 1], [4, 1]], 1),  # two moves
        ([[50, 49]], 0),
    ],
)
def test_kinds_of_exchange(bins, full):
    lengths = [n for b in bins for n in b]
    at = iter(range(len(lengths)))
    search = packing.Search(lengths, [[next(at) for _ in b] for b in bins], 100)
    search.run()
    assert sum(f == 100 for f in search.fill) == full and sum(search.fill) == sum(lengths)


def test_best_fit_takes_the_fullest_bin():
    lengths = [70, 60, 50, 30, 40]
    assert sorted(map(sorted, packing.best_fit(lengths, 100))) == [[0, 3], [1, 4], [2]]


# ---------------------------------------------------------------- spelling variants


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def spelled():
    r = random.Random(11)
    base = ["".join(r.choice("abàéz×") for _ in range(r.randint(6, 9))) for _ in range(40)]
    rows = [(None, None), (None, "abababa abababa"), (1, ""), (2, "AbĀcdefgh"), (3, "x" * 20_000), (4, "x" * 20_000), (5, "aaaaaaa aaaaaaaa aaaaaaa aaaaaaaa aaaaaa")]
    for i in range(6, 200):
        words = [r.choice(base[: 1 + i // 5]) for _ in range(40)]
        for k in range(0, 40, 7):
            w, at = words[k], r.randrange(6)
            words[k] = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abàé") + w[at:], w[:at] + "z" + w[at + 1 :], w.upper()])
        rows += [(i, " ".join(words) + ".,1\n")] * (1 + i % 2)
    return rows


@pytest.mark.parametrize("which", ["spelled", "given"])
def test_variants_are_those_of_brute_force(spark, which):
    rows = spelled() if which == "spelled" else given(spark)
    got = rows_of(variants.group(loose(spark, rows)), COLUMNS)
    want = sorted(brute.op13(rows), key=str)
    assert got == want
    assert any(x[3] for x in want) if which == "spelled" else any(x[2] for x in want)
    if which == "spelled":
        assert rows_of(variants.group(loose(spark, rows, 5), max_bits=1 << 11), COLUMNS) == want  # several filters


def test_roots_follow_long_chains(spark):
    names = [f"abcdefg{'h' * k}" for k in range(5)]
    text = " ".join(w for k, w in enumerate(names) for _ in range(2 * 10**k))
    got = {r.word: (r.form, r.root) for r in variants.group(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    want = {r[0]: (r[3], r[5]) for r in brute.op13([(1, text)])}
    assert got == want and len({r for _, r in got.values()}) == 1


def test_neighbourhoods_are_full_and_distinct():
    letters = np.array(sorted(map(ord, "abé")), np.uint8)
    for word in ("aab", "abba", "bbbbb", "éa"):
        codes = np.frombuffer(word.encode("latin-1"), np.uint8).reshape(1, -1)
        found, edits = [], variants.Edits(codes, letters)
        for kind, h, distinct, first in edits.blocks():
            for _, p, c in np.argwhere(distinct).tolist():
                near = variants._edited(word, kind, first + p, chr(letters[c]))
                other = variants.Edits(np.frombuffer(near.encode("latin-1"), np.uint8).reshape(1, -1), letters)
                assert other.hash[0] == h[0, p, c]
                found.append(near)
        n = len(word)
        want = {word[:i] + word[i + 1 :] for i in range(n)} | {word[:i] + c + word[i + k :] for k in (0, 1) for i in range(n + 1 - k) for c in "abé"}
        assert sorted(found) == sorted(want - {word})


def test_variants_of_an_empty_table(spark):
    assert variants.group(loose(spark, [(1, "x")]).limit(0)).collect() == []
    assert variants.group(spark.createDataFrame([(1, "too few")], "doc_id long, text string").withColumn("word", F.lit("x"))).collect() == []
