"""Near-duplicate removal with MinHash signatures and bands, and exact Jaccard pairs."""

from __future__ import annotations

from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import shingles, tokens
from lexloom.session import stored

HASHES, BANDS = 100, 25


def next_prime(n: int) -> int:
    """The smallest prime over n."""
    n += 1
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


PRIME = next_prime(1 << 28)  # over every 28-bit shingle hash
_RANDOM = Random(42)
CONSTANTS = [(_RANDOM.randrange(1, PRIME), _RANDOM.randrange(PRIME)) for _ in range(HASHES)]


def shingle_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, shingle), distinct."""
    words = docs.select("doc_id", F.explode(F.array(F.struct(tokens(F.col("text")).alias("w")))).alias("x"))
    return words.select("doc_id", F.explode(shingles(F.col("x.w"))).alias("shingle"))


def signatures(rows: DataFrame) -> DataFrame:
    """One min aggregate for each hash, in one pass; documents without shingles have no signature."""
    x = rows.select("doc_id", F.conv(F.substring(F.md5("shingle"), 1, 7), 16, 10).cast("long").alias("x"))
    return x.groupBy("doc_id").agg(*(F.min((F.col("x") * a + b) % PRIME).alias(f"h{i}") for i, (a, b) in enumerate(CONSTANTS)))


def bands(sig: DataFrame, n: int = BANDS) -> DataFrame:
    """(doc_id, band, sig)"""
    rows = HASHES // n
    return sig.select("doc_id", F.posexplode(F.array(*(F.concat_ws("_", *(F.col(f"h{b * rows + r}") for r in range(rows))) for b in range(n)))).alias("band", "sig"))


def candidates(band_rows: DataFrame) -> DataFrame:
    a, b = band_rows.select(F.col("doc_id").alias("a"), "band", "sig"), band_rows.select(F.col("doc_id").alias("b"), "band", "sig")
    return a.join(b.hint("merge"), ["band", "sig"]).where("a < b").select("a", "b").distinct()


def estimated(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """(a, b, similarity): the share of equal hashes. An array looks like one number to the planner, which would send all signatures through
    the driver as a small table; the joins are merge joins."""
    pack = sig.select("doc_id", F.array(*(F.col(f"h{i}").cast("int") for i in range(HASHES))).alias("s"))
    side = lambda c: pack.select(F.col("doc_id").alias(c), F.col("s").alias(f"s{c}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", (F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e)) / HASHES).alias("similarity"))


def near_duplicates_removed(docs: DataFrame, limit: float = 0.8, sig: DataFrame | None = None) -> DataFrame:
    """Documents that are the higher one of no candidate pair over the limit; stored signatures are used if given.

    Of documents with one signature only the smallest can stay, and it is compared for all of them, so copies are not
    paired with each other."""
    sig = signatures(shingle_rows(docs)) if sig is None else sig
    hashes = [c for c in sig.columns if c != "doc_id"]
    least = stored(sig.groupBy(*hashes).agg(F.min("doc_id").alias("doc_id")))
    copies = sig.select("doc_id").join(least.select("doc_id").hint("merge"), "doc_id", "left_anti") if limit < 1 else sig.select("doc_id").limit(0)
    gone = estimated(candidates(bands(least)), least).where(F.col("similarity") > limit).select(F.col("b").alias("doc_id"))
    return docs.join(gone.unionByName(copies).distinct().hint("merge"), "doc_id", "left_anti")


def number_sets(rows: DataFrame) -> DataFrame:
    """(doc_id, s): each document's shingles as sorted 64-bit hashes, stored."""
    return stored(rows.select("doc_id", F.xxhash64("shingle").alias("t")).groupBy("doc_id").agg(F.sort_array(F.collect_list("t")).alias("s")))


def _ratio(x: Column, y: Column) -> Column:
    """Jaccard similarity of two sets that are not empty."""
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def _class_pairs(sets: DataFrame, limit: float) -> DataFrame:
    """(a, b, j) over the limit among different sets. A pair meets at a prefix of its shingles, rarest first; of a meeting, what is left of
    the smaller rest must be enough for the limit, which holds at the first shingle that the two share."""
    flat = sets.select("doc_id", F.size("s").alias("n"), F.explode("s").alias("t"))
    df = flat.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    often = flat.join(df.hint("merge"), "t").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    before = F.col("n") - F.size("o")  # shingles of no other document
    room = F.greatest(F.col("n") - F.ceil(F.col("n") * limit) + 1 - before, F.lit(0)).cast("int")
    short = stored(often.select("doc_id", "n", before.alias("before"), F.posexplode(F.slice("o", F.lit(1), room)).alias("i", "x")).select("doc_id", "n", (F.col("n") - F.col("before") - F.col("i")).alias("left"), "x.t"))
    a, b = (short.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("left").alias(f"left{c}"), "t") for c in "ab")
    enough = f"least(lefta, leftb) > {limit / (1 + limit)} * (na + nb) - 1e-6"
    met = a.join(b.hint("merge"), "t").where(f"a < b and least(na, nb) > {limit} * greatest(na, nb) and {enough}").select("a", "b").distinct()
    side = lambda c, name: sets.select(F.col("doc_id").alias(c), F.col("s").alias(name)).hint("merge")  # noqa: E731  (arrays look small to the planner)
    return met.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", _ratio(F.col("x"), F.col("y")).alias("j")).where(F.round("j", 6) > limit)


def exact_pairs(rows: DataFrame, limit: float = 0.8, unrounded: bool = False) -> DataFrame:
    """(a, b, similarity) over the limit, with j, which is not rounded, on request. Documents of one set are compared with others once, by
    their smallest; their pairs follow from that."""
    sets = number_sets(rows)
    keys = sets.select("doc_id", F.sha2(F.array_join("s", ","), 256).alias("key"))
    members = stored(keys.join(keys.groupBy("key").agg(F.min("doc_id").alias("of")).hint("merge"), "key").select("doc_id", "of"))
    distinct = stored(sets.join(members.where("doc_id = of").select("doc_id").hint("merge"), "doc_id", "left_semi"))
    found = stored(_class_pairs(distinct, limit)).select(F.col("a").alias("p"), F.col("b").alias("q"), "j")
    many = members.groupBy("of").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("of").alias("p"), F.col("of").alias("q"), F.lit(1.0).alias("j"))
    found = found.unionByName(many) if limit < 1 else found
    left, right = members.select(F.col("doc_id").alias("x"), F.col("of").alias("p")), members.select(F.col("doc_id").alias("y"), F.col("of").alias("q"))
    every = found.join(left.hint("merge"), "p").join(right.hint("merge"), "q").where("p <> q or x < y")
    every = every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("j", 6).alias("similarity"), "j")
    return every if unrounded else every.drop("j")


def quality_test(pairs: DataFrame, rows: DataFrame, others: int = 5) -> DataFrame:
    """The share of candidate pairs (a, b) whose similarity is over that of a with each of `others` documents, drawn by a hash. A
    document is compared with those drawn once, whatever its pairs; similarities of pairs are taken from j, if they have it."""
    sets = number_sets(rows)
    if "j" not in pairs.columns:
        side = lambda c, name: sets.select(F.col("doc_id").alias(c), F.col("s").alias(name)).hint("merge")
        pairs = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", _ratio(F.col("x"), F.col("y")).alias("j"))
    some = sets.select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"), "s").orderBy("h", "doc_id").limit(others + 2)  # two more, so that a and b can be left out
    some = some.agg(F.array_sort(F.collect_list(F.struct("h", "doc_id", "s"))).alias("some"))
    near = sets.crossJoin(F.broadcast(some)).select(F.col("doc_id").alias("a"), F.transform("some", lambda o: F.struct(o["doc_id"].alias("o"), _ratio(F.col("s"), o["s"]).alias("j"))).alias("drawn"))
    own = pairs.select("a", "b", "j").join(near.hint("merge"), "a")
    kept = F.slice(F.filter("drawn", lambda o: (o["o"] != F.col("a")) & (o["o"] != F.col("b"))), 1, others)
    per = own.select("j", kept.alias("kept")).where(F.size("kept") > 0).select("j", F.array_max(F.transform("kept", lambda o: o["j"])).alias("other"))
    return per.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.when(F.col("j") > F.col("other"), 1.0).otherwise(0.0)), 6).alias("better"))
