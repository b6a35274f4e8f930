"""Text expressions: cleaning, tokens, stop words, stems, shingles, grams and similarity, as native columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# URL and e-mail tokens, ASCII punctuation, and the two stop word lists.
URLS = r"(?i)\S*http\S*|\S*www\S*|\S+\.ir\S*|\S+\.com\S*|\S+\.org\S*|\S*@\S*"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
STOPWORDS = ["this", "that", "about", "whom", "being", "where", "why", "had", "should", "each"]
GENERAL_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some such no nor not only "
    "own same so than too very s t can will just don should now"
).split()


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, URLS, " ")


def normalised(c: Column) -> Column:
    """URL removal, lower case, punctuation to space, single spaces."""
    return F.array_join(tokens(remove_urls(c)), " ")


_BLANKS = "\t\n\x0b\f\r" + "".join(chr(x) for x in range(33, 127) if not chr(x).isalnum())


def tokens(c: Column) -> Column:
    """Lower-cased words between white space and ASCII punctuation; a null text has none."""
    return F.filter(F.split(F.translate(F.lower(F.coalesce(c, F.lit(""))), _BLANKS, " " * len(_BLANKS)), " "), lambda w: w != "")


def present(c: Column, default=None) -> Column:
    """The value, or the default where it is null or not a number."""
    return F.coalesce(F.when(c.cast("string") != "NaN", c), F.lit(default))


def without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(stop))


def clean_words(c: Column) -> Column:
    """Letters only, general stop words out, then words of over two letters."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z\s]", " "), r"\s+"), lambda w: w != "")
    return F.filter(without(words, GENERAL_STOPWORDS), lambda w: F.length(w) > 2)


def shingles(words: Column) -> Column:
    """Distinct word pairs; a single word stands for itself."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) == 1, words).otherwise(F.array_distinct(pairs))


def kgrams(word: Column, k: int = 2) -> Column:
    """Distinct character k-grams of $word$."""
    padded = F.concat(F.lit("$"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) + 3 - k), lambda i: padded.substr(i, F.lit(k))))


def jaccard(a: Column, b: Column, empty_is_equal: bool = False) -> Column:
    """Jaccard similarity of two sets: 1 if both are empty, or, for shingle sets (empty_is_equal), if either is."""
    union = F.size(F.array_union(a, b))
    none = (F.size(a) == 0) | (F.size(b) == 0) if empty_is_equal else union == 0
    return F.when(none, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def html_text(c: Column) -> Column:
    """Scripts and styles out, tags to space, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?is)<script.*?</script>|<style.*?</style>", " "), r"(?s)<[^>]*>", " "), r"\s+", " "))


def labelled(pairs: dict[str, Column], limit: int = 1024) -> Column:
    """`Label: value` of the non-empty values, joined by bars and cut."""
    return F.substring(F.concat_ws(" | ", *(F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in pairs.items())), 1, limit)


def shortened(c: Column, n: int = 35) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def highlighted(c: Column, word: str) -> Column:
    """The word marked wherever it stands alone, in any case; it is taken literally."""
    return F.regexp_replace(c, rf"(?i)\b({re.escape(word)})\b", "<mark>$1</mark>")


def marked(c: Column) -> Column:
    """A snippet's ***words*** as marked HTML."""
    return F.regexp_replace(c, r"\*\*\*(.+?)\*\*\*", "<mark>$1</mark>")


# ---------------------------------------------------------------- stemming, after M. F. Porter, 1980


def _measure(w: str) -> int:
    kinds = "".join("v" if ch in "aeiou" or ch == "y" and i and w[i - 1] not in "aeiou" else "c" for i, ch in enumerate(w))
    return kinds.count("vc")


def _vowel(w: str) -> bool:
    return any(ch in "aeiou" or ch == "y" and i and w[i - 1] not in "aeiou" for i, ch in enumerate(w))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiou"


def _cvc(w: str) -> bool:
    return len(w) > 2 and w[-1] not in "aeiouwxy" and w[-2] in "aeiouy" and w[-3] not in "aeiou"


# Suffix tables of the published algorithm.
_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(w: str) -> str:
    if len(w) < 3:
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        hit = max((s for s in table if w.endswith(s)), key=len, default=None)
        if hit and _measure(w[: -len(hit)]):
            w = w[: -len(hit)] + table[hit]
    hit = max((s for s in _STEP4 if w.endswith(s)), key=len, default=None)
    if hit and _measure(w[: -len(hit)]) > 1 and (hit != "ion" or w[: -len(hit)].endswith(("s", "t"))):
        w = w[: -len(hit)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if _double(w) and w.endswith("l") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map({w: porter(w) for w in words.dropna().unique()})
