"""Queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from lexloom.llm import alignment, decontaminate, jaccard_join, licenses, line_dedup, masked_lm, packing, pieces, pii, quality_rules, substring_dedup, suffix_dedup, variants


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_decontaminate(spark, d):
    return decontaminate.decontaminate(_docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


def op2_pii(spark, d):
    return pii.extract(_docs(spark, d))


def op3_pieces(spark, d):
    return pieces.encode(_docs(spark, d))


def op4_jaccard(spark, d):
    return jaccard_join.near_duplicates(_docs(spark, d))


def op5_suffix(spark, d):
    return suffix_dedup.deduplicate(_docs(spark, d))


def op6_licenses(spark, d):
    return licenses.scan(_docs(spark, d))


def op7_quality(spark, d):
    return quality_rules.judge(_docs(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


def op8_masked_lm(spark, d):
    return masked_lm.fit_and_score(_docs(spark, d))


def op9_substring(spark, d):
    return substring_dedup.deduplicate(_docs(spark, d))


def op10_lines(spark, d):
    return line_dedup.deduplicate(_docs(spark, d))


def op11_align(spark, d):
    return alignment.align(_docs(spark, d))


def op12_pack(spark, d):
    return packing.pack(_docs(spark, d))


def op13_variants(spark, d):
    return variants.group(_docs(spark, d))


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_pii, op3_pieces, op4_jaccard, op5_suffix, op6_licenses, op7_quality, op8_masked_lm, op9_substring, op10_lines, op11_align, op12_pack, op13_variants)
}
ORACLE_SQL: dict[str, str] = {"op10_lines": line_dedup.ORACLE_SQL}
