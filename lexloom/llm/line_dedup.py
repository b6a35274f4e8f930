"""Line dedup by content-defined chunks of lines, in DataFrame and SQL functions only.

Each line gets a 28-bit hash. A rolling hash over a line and the one before it closes a chunk where it is 0 modulo
DIVISOR, so that boundaries follow the content: lines put in front shift no chunk but the one they touch. Chunks of
two lines or more (with something in them) that occur more than once in the whole corpus are candidates by their
64-bit hash. Candidates are compared byte for byte by grouping them by hash and bytes; the first copy of a content
(smallest doc_id, then place in the document) stays, and all later copies are removed with their line ends.

Hash counts move pre-aggregated, candidates as (document, place, hash). The texts move twice, by document: to cut out the
candidates' bytes, and to apply what goes. Candidates' bytes move once, pre-aggregated; a later copy finds its content
by the hash alone, and by the bytes only where one hash has several contents. The plan is the same at every size.

Defined results: a null text is one empty line; very long texts take memory in proportion to their lines; a text whose chunks all go becomes empty; rows that share an id count
as one document, where a chunk at the same place is no repetition; a null id orders last; an empty table gives an empty result;
other columns are ignored by `deduplicate` and kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import attach, stored

DIVISOR, ROLL, MIN_LINES = 4, 31, 2
NULL_ID = (1 << 63) - 1


def with_chunks(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """_key, the input's columns, n_lines, and chunks as an array of (n, bytes) in order."""
    lines = keyed(docs).withColumn("_l", F.expr("split(coalesce(text, ''), '\\n')"))
    # explode of one struct: what it holds is computed once, not again for each use below
    once = lines.withColumn("_x", F.expr("explode(array(struct(_l as l, transform(_l, x -> cast(conv(substring(md5(x), 1, 7), 16, 10) as long)) as h)))")).drop("_l")
    marks = F.expr(f"transform(zip_with(_x.h, slice(concat(array(0L), _x.h), 1, size(_x.h)), (a, b) -> (b * {ROLL} + a) % {divisor} = 0), (f, i) -> if(f or i = size(_x.h) - 1, i + 1, null))")
    ended = once.withColumn("_e", F.explode(F.array(F.array_compact(marks))))
    chunks = F.expr("zip_with(slice(concat(array(0), _e), 1, size(_e)), _e, (s, e) -> struct(e - s as n, array_join(slice(_x.l, s + 1, e - s), '\\n') as bytes))")
    return ended.withColumn("chunks", F.explode(F.array(chunks))).withColumn("n_lines", F.expr("cast(size(_x.l) as long)")).drop("_x", "_e")


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """(_key, gone): for each document with repeated chunks the "place:hash" of those to remove."""
    rows = with_chunks(docs.select("doc_id", "text"), divisor).select("_key", F.posexplode("chunks").alias("at", "c")).where(f"c.n >= {min_lines} and trim(translate(c.bytes, '\n', ' ')) <> ''")
    places = stored(rows.select("_key", "at", F.xxhash64("c.bytes").alias("h")))
    often = places.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h")
    candidates = stored(attach(places, often, "h", "inner"))
    wanted = candidates.groupBy("_key").agg(F.collect_set(F.struct("at", "h")).alias("wanted"))
    texts = with_chunks(attach(keyed(docs.select("doc_id", "text")), wanted, "_key", "inner").drop("_key"), divisor)
    cut = texts.select("_key", F.explode("wanted").alias("x"), F.expr("chunks[x.at].bytes").alias("bytes")).where("xxhash64(bytes) = x.h")
    bytes_ = stored(cut.select(F.col("x.h").alias("h"), "_key", F.col("x.at").alias("at"), "bytes"))
    contents = bytes_.groupBy("h", "bytes").agg(F.min(F.struct("_key", "at")).alias("first"))
    firsts = stored(contents.select("h", "bytes", F.col("first._key").alias("k"), F.col("first.at").alias("i")))
    alone = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("k").alias("k"), F.min("i").alias("i"))
    later = attach(candidates, alone.where("m = 1"), "h", "inner").where("_key <> k or at <> i").select("_key", "at", "h")
    clash = attach(firsts, alone.where("m > 1").select("h"), "h", "left_semi")  # several contents with one hash
    more = bytes_.join(clash.hint("merge"), ["h", "bytes"]).where("_key <> k or at <> i").select("_key", "at", "h")
    return later.unionByName(more).groupBy("_key").agg(F.collect_set(F.concat_ws(":", "at", "h")).alias("gone"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.expr(f"coalesce(doc_id, {NULL_ID}L)"))


def _applied(docs: DataFrame, divisor: int, min_lines: int) -> DataFrame:
    full = with_chunks(attach(keyed(docs), repeated_chunks(docs, divisor, min_lines), "_key").drop("_key"), divisor).drop("_key")
    places = "array_except(transform(chunks, (c, i) -> concat_ws(':', i, xxhash64(c.bytes))), gone)"  # linear in both
    kept = F.expr(f"if(gone is null, chunks, transform({places}, p -> chunks[cast(substring_index(p, ':', 1) as int)]))")
    return full.withColumn("_kept", F.explode(F.array(kept)))


def deduplicate(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines, n_chunks, n_removed_chunks, n_removed_lines and kept_sha256 of each document."""
    count = "cast(aggregate({0}, 0, (s, c) -> s + c.n) as long)"
    return _applied(docs.select("doc_id", "text"), divisor, min_lines).select(
        "doc_id",
        "n_lines",
        F.expr("cast(size(chunks) as long)").alias("n_chunks"),
        F.expr("cast(size(chunks) - size(_kept) as long)").alias("n_removed_chunks"),
        (F.col("n_lines") - F.expr(count.format("_kept"))).alias("n_removed_lines"),
        F.sha2(F.expr("array_join(transform(_kept, c -> c.bytes), '\\n')"), 256).alias("kept_sha256"),
    )


def clean(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """The documents without repeated chunks, all columns kept; a null text stays null."""
    names = docs.columns
    inner = docs.select("doc_id", "text", F.struct(*(F.col(f"`{n}`") for n in names if n != "text")).alias("_in"))
    text = F.expr("if(text is null, null, array_join(transform(_kept, c -> c.bytes), '\\n'))")
    return _applied(inner, divisor, min_lines).select(*((text if n == "text" else F.col("_in").getField(n)).alias(n) for n in names))


ORACLE_SQL = f"""
WITH l AS (
  SELECT doc_id, u.i AS i, u.line AS line, ('0x' || substr(md5(u.line), 1, 7))::BIGINT AS h, n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents),
       LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) AS i) u
), marked AS (
  SELECT *, (coalesce(lag(h) OVER w, 0) * {ROLL} + h) % {DIVISOR} = 0 OR i = n AS closes FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM marked
), chunks AS (
  SELECT doc_id, c, count(*) AS m, string_agg(line, chr(10) ORDER BY i) AS bytes FROM numbered GROUP BY doc_id, c
), judged AS (
  SELECT *, m >= {MIN_LINES} AND trim(replace(bytes, chr(10), ' ')) <> '' AND row_number() OVER (PARTITION BY bytes ORDER BY doc_id, c) > 1 AS gone FROM chunks
)
SELECT doc_id, sum(m)::BIGINT AS n_lines, count(*)::BIGINT AS n_chunks, count(*) FILTER (gone)::BIGINT AS n_removed_chunks,
       coalesce(sum(m) FILTER (gone), 0)::BIGINT AS n_removed_lines,
       sha256(coalesce(string_agg(bytes, chr(10) ORDER BY c) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
