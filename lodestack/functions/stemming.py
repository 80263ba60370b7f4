"""Stemmers. The plural stemmer is a column expression; the others run as Arrow-batched UDFs over whole token arrays.

``porter2`` follows Porter's published "English" algorithm. ``inflection_stem`` is a rule-only stand-in for a dictionary stemmer
of inflections (plurals, -ed, -ing).
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Fixed values of the published algorithm.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEEP_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"), ("tional", "tion"), ("lessli", "less"), ("biliti", "ble"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("fulli", "ful"), ("ousli", "ous"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(word: str) -> tuple[int, int]:
    """Starts of R1 and R2."""
    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        m = re.search(r"[aeiouy][^aeiouy]", word)
        r1 = m.end() if m else len(word)
    m = re.search(r"[aeiouy][^aeiouy]", word[r1:])
    return r1, r1 + m.end() if m else len(word)


def _short(word: str, r1: int) -> bool:
    return r1 >= len(word) and bool(re.search(r"(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", word))


@lru_cache(maxsize=200_000)
def porter2(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = word.lstrip("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(r"[aeiouy].", word[:-1]):
        word = word[:-1]
    if word in KEEP_AFTER_1A:
        return word
    for end in ("eedly", "eed"):
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: len(word) - len(end)] + "ee"
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if word.endswith(end):
                stem = word[: len(word) - len(end)]
                if re.search(r"[aeiouy]", stem):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif word.endswith(DOUBLES):
                        word = word[:-1]
                    elif _short(word, r1):
                        word += "e"
                break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    for end, to in STEP2:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r1 and (end != "ogi" or word[at - 1 : at] == "l") and (end != "li" or word[at - 1 : at] in tuple("cdeghkmnrt")):
                word = word[:at] + to
            break
    for end, to in STEP3:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                word = word[:at] + to
            break
    for end in STEP4:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r2 and (end != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not re.search(r"(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", word[:at]):
            word = word[:at]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


@lru_cache(maxsize=200_000)
def inflection_stem(word: str) -> str:
    word = min_stem(word)
    for end in ("ing", "ed"):
        stem = word[: -len(end)]
        if word.endswith(end) and len(stem) >= 3 and re.search(r"[aeiouy]", stem):
            if stem[-2:] in DOUBLES:
                return stem[:-1]
            return stem + "e" if re.search(r"[aeiou][^aeiouwxy]$", stem) and not re.search(r"[aeiou]{2}[^aeiou]$", stem) and len(stem) <= 4 else stem
    return word


def min_stem(word: str) -> str:
    """Harman's S-stemmer: plurals only."""
    if len(word) < 3 or word[-1] != "s" or word[-2] in "us":
        return word
    if word.endswith("ies") and len(word) > 3 and word[-4] not in "ae":
        return word[:-3] + "y"
    if word[-2] == "e" and (word[-3] in "iaoe"):
        return word
    return word[:-1]


def min_stem_column(t: Column) -> Column:
    return (
        F.when((F.length(t) < 3) | ~t.endswith("s") | t.rlike("[us]s$"), t)
        .when(t.rlike("[^ae]ies$"), F.concat(t.substr(F.lit(1), F.length(t) - 3), F.lit("y")))
        .when(t.rlike("[iaoe]es$"), t)
        .otherwise(t.substr(F.lit(1), F.length(t) - 1))
    )


def _arrays(stem):
    @F.pandas_udf("array<string>")
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: None if ts is None else [None if t is None else stem(t) for t in ts])

    return run


def porter2_column(tokens: Column) -> Column:
    return _arrays(porter2)(tokens)


def inflection_column(tokens: Column) -> Column:
    return _arrays(inflection_stem)(tokens)
