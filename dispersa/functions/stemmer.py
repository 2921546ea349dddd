"""Porter's stemmer (1980), from the published rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# The suffixes of steps 2, 3 and 4 of the published algorithm.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """C for consonants, V for vowels; y is a vowel behind a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "V" if c in "aeiou" or (c == "y" and i and out[-1] == "C") else "C"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("V+C+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "C"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "CVC" and word[-1] not in "wxy"


def _replace(word: str, rules, least: int) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case English word; words of one or two letters stay."""
    w = word
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and "V" in _shape(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "V" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, STEP2, 0)
    w = _replace(w, STEP3, 0)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _stem_rows(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return pd.Series([None if row is None else [known[w] if w in known else known.setdefault(w, stem(w)) for w in row] for row in words], dtype=object)


def stems(words: Column) -> Column:
    """Stems of an array of words, in Arrow batches; each distinct word of a batch is stemmed once."""
    return pandas_udf(_stem_rows, ArrayType(StringType()))(words)
