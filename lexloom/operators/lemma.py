"""Lemmas by detachment rules: an ending is replaced, and the result counts if it is itself a word of the vocabulary.

One row a distinct word goes through the rules, as columns; the vocabulary is met by a join. Irregular forms come first,
then the rules in their order. Words that no rule turns into a known word are their own lemmas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The usual detachment rules of English by part of speech (ending, replacement), and irregular forms.
RULES = {
    "noun": (("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"), ("s", "")),
    "verb": (("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""), ("s", "")),
    "adjective": (("er", ""), ("est", ""), ("er", "e"), ("est", "e")),
}
IRREGULAR = {
    "noun": {"mice": "mouse", "lice": "louse", "feet": "foot", "teeth": "tooth", "geese": "goose", "children": "child", "oxen": "ox", "wolves": "wolf", "lives": "life", "knives": "knife", "leaves": "leaf", "wives": "wife"},
    "verb": {"was": "be", "were": "be", "been": "be", "had": "have", "has": "have", "did": "do", "done": "do", "went": "go", "gone": "go", "said": "say", "made": "make", "took": "take", "came": "come", "saw": "see", "seen": "see"},
    "adjective": {"better": "good", "best": "good", "worse": "bad", "worst": "bad"},
}
KINDS, SHORTEST = ("noun", "verb", "adjective"), 2


def rules(kinds: tuple[str, ...] = KINDS) -> list[tuple[str, str]]:
    """(ending, replacement) in the order in which they are tried; a rule counts once."""
    return list(dict.fromkeys(r for k in kinds for r in RULES[k]))


def irregular(kinds: tuple[str, ...] = KINDS) -> dict[str, str]:
    return {w: base for k in kinds for w, base in IRREGULAR[k].items()}


def lemmas(words: DataFrame, known: DataFrame | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(word, lemma) of each distinct (word); bases must be among the words of `known`, or of `words`. Bases have SHORTEST letters at least."""
    words = words.select("word").where("word is not null").distinct()
    known = (words if known is None else known.select("word").distinct()).select(F.col("word").alias("base"))
    w = F.col("word")
    made = [F.when(w.endswith(a) & (F.length(w) - len(a) + len(b) >= SHORTEST), F.struct(F.lit(i).alias("i"), F.concat(w.substr(F.lit(1), F.length(w) - len(a)), F.lit(b)).alias("base"))) for i, (a, b) in enumerate(rules(kinds))]
    tried = words.select("word", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x")).select("word", "x.i", "x.base")
    found = tried.join(known, "base", "left_semi").groupBy("word").agg(F.min_by("base", "i").alias("base"))
    odd = irregular(kinds)
    fixed = F.create_map(*(F.lit(x) for pair in odd.items() for x in pair))[w] if odd else F.lit(None).cast("string")
    return words.join(found, "word", "left").select("word", F.coalesce(fixed, "base", "word").alias("lemma"))
