"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Base spans of e-mail addresses, IP addresses, payment cards and phone numbers follow fixed patterns with checks (parts
of an address, Luhn digits, number of digits). They are the seed entities, with a kind that has no base spans: secrets,
seeded by runs of 32 lower-case hexadecimal digits or more. The extraction around them:

1. Candidates are runs of words that hold a digit or an at sign. Each has the words around it as context.
2. Contexts are patterns: the word before, the two words before, and the word before with the word after. Distinct
   (pattern, instance) pairs are the edges of a bipartite graph.
3. In each round a pattern scores for a kind as the share of its instances that are known to be of that kind, if
   there are MIN_SUPPORT of them; an unseen instance of a fitting shape gets the noisy-or of its patterns that score
   MIN_SCORE or more, and from MIN_CONFIDENCE on counts as known from the next round on. Rounds end when one adds nothing.
4. Occurrences of secrets and of the instances found become further spans; base spans always stay, and no span is added over one.

Regular expressions are possessive and begin only where a match can, so that long runs take linear time. All
aggregates are pre-aggregated by pattern or instance; nothing but tables in the shared folder passes between rounds.

Defined results: null and empty texts have no spans; very long texts take linear time for positions; counts by kind are of base spans, n_added of the others; repeated rows each get their row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import attach, stored

# The kinds in order, their patterns, and the bounds of the checks.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    # a match begins where its first run does, or where the match before it ended
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = r"^[0-9a-f]{32,}+$"
SEEDED = (*KINDS, "secret")
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)

MIN_SUPPORT, MIN_SCORE, MIN_CONFIDENCE, CONTEXT = 3, 0.6, 0.8, 64
BLOCK = 256  # matches are located in blocks, since Spark copies an array that grows

_WORD = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
CANDIDATE = rf"(?<![^\x20\x09-\x0D]){_WORD}(?:\x20{_WORD})*+"
_SPAN = "array<struct<s:int,e:int,v:string>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    def value(i: Column) -> Column:
        x = F.expr("0") + d.substr(-i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    """Whether a match of the kind's pattern passes its check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    d = _digits(v)
    low, high = CARD_DIGITS if kind == "card" else PHONE_DIGITS
    ok = F.length(d).between(low, high)
    return F.when(ok, _luhn(d)).otherwise(False) if kind == "card" else ok


def passes(kind: str, field: str | None = None):
    return lambda x: valid(kind, x[field] if field else x)


def tagged(order: int, kind: str):
    return lambda x: F.struct(F.lit(order).alias("o"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, however often the next step uses them."""
    names = df.columns
    made = df.withColumn("_once", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return made.select(*(F.col(n) for n in names if n not in columns), *(F.col(f"_once.{n}").alias(n) for n in columns))


def _hint(kind: str, text: Column) -> Column:
    return text.rlike("[0-9]") if HINTS[kind] is None else F.contains(text, F.lit(HINTS[kind])) & text.rlike("[0-9]" if kind in ("ip", "phone") else "@")


def matches(text: Column, pattern: str, when: Column) -> tuple[Column, Column]:
    """All matches, and the pieces of text between them."""
    none = F.array().cast("array<string>")
    return F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(when, F.split(text, pattern, -1)).otherwise(none)


def located(found: str, pieces: str) -> Column:
    """Matches with start and end in code points, from the lengths of all that stands before."""
    size = "(a, x) -> a + x.p + x.m"
    span = "struct(a.at + x.p as s, a.at + x.p + x.m as e, x.v as v)"
    parts = f"zip_with(slice({pieces}, 1, size({found})), {found}, (p, m) -> struct(char_length(p) as p, char_length(m) as m, m as v))"
    blocks = f"transform(sequence(0, size({found}) div {BLOCK}), b -> slice({parts}, b * {BLOCK} + 1, {BLOCK}))"
    begin = f"aggregate(blocks, struct(0 as at, cast(array() as array<int>) as o), (a, x) -> struct(a.at + aggregate(x, 0, {size}) as at, concat(a.o, array(a.at)) as o)).o"
    inside = f"aggregate(xs, struct(at as at, cast(array() as {_SPAN}) as o), (a, x) -> struct(a.at + x.p + x.m as at, concat(a.o, array({span})) as o)).o"
    return F.expr(f"flatten(transform(transform(array({blocks}), blocks -> struct(blocks, {begin} as begin)), t -> flatten(zip_with(t.blocks, t.begin, (xs, at) -> {inside}))))")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _row and for each kind its base spans as an array of (s, e, v)."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).withColumn("_row", F.xxhash64("doc_id", "_t"))
    text = F.col("_t")
    raw = {}
    for k in KINDS:
        raw[f"_m_{k}"], raw[f"_p_{k}"] = matches(text, PATTERNS[k], _hint(k, text))
    df = once(df, **raw)
    df = once(df, **{k: F.filter(located(f"_m_{k}", f"_p_{k}"), passes(k, "v")) for k in KINDS})
    return df.drop("_t", *raw)


def candidates(docs: DataFrame) -> DataFrame:
    """A row for each candidate: _row, s, e, inst, the base kind it holds if any, and the words around it."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).withColumn("_row", F.xxhash64("doc_id", "_t"))
    m, p = matches(F.col("_t"), CANDIDATE, F.col("_t").rlike("[0-9@]"))
    df = once(df.where(F.col("_t").rlike("[0-9@]")), m=m, p=p)
    df = once(df.drop("_t"), spans=located("m", "p"), after=F.expr("slice(p, 2, size(p))"), p=F.col("p"))
    rows = df.select("_row", F.explode(F.arrays_zip("spans", F.expr("slice(p, 1, size(spans))").alias("before"), "after")).alias("x"))
    v = F.col("x.spans.v")
    words = lambda c: F.filter(F.split(F.lower(c), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = rows.select(
        "_row",
        v.alias("v"),
        F.col("x.spans.s").alias("s0"),
        words(F.expr(f"right(x.before, {CONTEXT})")).alias("l"),
        words(F.expr(f"left(x.after, {CONTEXT})")).alias("r"),
        F.regexp_replace(v, r"^[^0-9A-Za-z+@]+|[^0-9A-Za-z]+$", "").alias("core"),
    )
    lead = F.length(F.regexp_extract("v", r"^[^0-9A-Za-z+@]*", 0))
    df = df.withColumns({"s": F.col("s0") + lead, "e": F.col("s0") + lead + F.length("core"), "inst": F.lower("core")}).where("core <> ''")
    kind = F.coalesce(*(F.when(F.exists(F.regexp_extract_all("v", F.lit(PATTERNS[k]), F.lit(0)), passes(k)), F.lit(k)) for k in KINDS), F.when(F.col("core").rlike(SECRET), F.lit("secret")))
    n = F.length(_digits(F.col("core")))
    shape = F.concat(
        F.when(F.contains("core", F.lit("@")), F.lit("email,")).otherwise(""),
        F.when(F.col("core").rlike(r"^[0-9a-fA-F]+([.:][0-9a-fA-F]*){3,}$"), F.lit("ip,")).otherwise(""),
        F.when(n.between(12, 19), F.lit("card,")).otherwise(""),
        F.when(n.between(7, 15), F.lit("phone,")).otherwise(""),
        F.when(F.col("core").rlike("^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[0-9A-Za-z_-]{16,}$"), F.lit("secret,")).otherwise(""),
    )
    near = lambda a, i: F.try_element_at(a, F.lit(i))
    pattern = F.array_compact(F.array(F.concat(F.lit("1 "), near("l", -1)), F.concat(F.lit("2 "), near("l", -2), F.lit(" "), near("l", -1)), F.concat(F.lit("3 "), near("l", -1), F.lit(" _ "), near("r", 1))))
    return df.select("_row", "s", "e", "inst", kind.alias("kind"), shape.alias("shape"), pattern.alias("patterns"))


def bootstrap(rows: DataFrame, min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(inst, kind, confidence) of the unseen instances that the pattern-instance graph makes known, up to the fixed point.

    What is known stays known, so every round but the last adds an instance."""
    nodes = rows.groupBy("inst").agg(F.min("kind").alias("seed"), F.max("shape").alias("shape"))
    edges = stored(rows.select("inst", F.explode("patterns").alias("pattern")).distinct().join(nodes, "inst"))
    seeds = edges.where("seed is not null").select("inst", F.col("seed").alias("kind"), F.lit(1.0).alias("confidence")).distinct()
    found = stored(seeds.limit(0))
    while True:
        known = seeds.unionByName(found)
        scored = edges.select("pattern", "inst").join(known, "inst", "left").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.when(F.col("kind") == k, F.col("confidence")).otherwise(0.0)).alias(k) for k in SEEDED))
        long = scored.select("pattern", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("hits")) for k in SEEDED))).alias("x")).where(f"x.hits >= {min_support}")
        good = long.select("pattern", F.col("x.kind").alias("kind"), (F.col("x.hits") / F.col("n")).alias("score")).where(f"score >= {min_score}")
        fits = edges.where("seed is null and shape <> ''").join(good, "pattern").where("contains(shape, concat(kind, ','))").join(found.select("inst"), "inst", "left_anti")
        conf = fits.groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("confidence"))
        best = conf.groupBy("inst").agg(F.max_by(F.struct("kind", "confidence"), F.struct("confidence", "kind")).alias("b"))
        new = stored(best.select("inst", "b.kind", "b.confidence").where(f"confidence >= {min_confidence}"))
        if new.isEmpty():
            return found
        found = stored(found.unionByName(new))


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', cast(x.s as string), ':', cast(x.e as string))), ',')"


def extract(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and all spans of each document; n_added and n_spans count the added and all spans."""
    rows = stored(candidates(docs))
    found = bootstrap(rows, **options)
    seen = rows.where("kind is null").join(found.select("inst", F.col("kind").alias("_k")), "inst").select("_row", F.struct(F.col("_k").alias("kind"), "s", "e").alias("x"))
    secrets = rows.where("kind = 'secret'").select("_row", F.struct("kind", "s", "e").alias("x"))
    more = seen.unionByName(secrets).groupBy("_row").agg(F.collect_set("x").alias("more"))
    df = attach(base_spans(docs), more, "_row")
    every = F.concat(*(F.transform(k, tagged(i, k)) for i, k in enumerate(KINDS)))
    order = " ".join(f"when '{k}' then {i}" for i, k in enumerate(SEEDED))
    df = once(df, base=every, more=F.expr(f"transform(coalesce(more, array()), x -> struct(case x.kind {order} end as o, x.s as s, x.e as e, x.kind as kind))"))
    df = once(df, added=F.filter("more", lambda m: ~F.exists("base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"]))))
    return df.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"),
        F.expr(_joined("array_sort(concat(base, added))")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
