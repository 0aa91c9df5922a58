"""The stemmer of M. F. Porter, "An algorithm for suffix stripping" (1980), for English words."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The suffix tables of the published algorithm.
_STEP2 = (
    "ational ate|tional tion|enci ence|anci ance|izer ize|abli able|alli al|entli ent|eli e|ousli ous|ization ize|ation ate"
    "|ator ate|alism al|iveness ive|fulness ful|ousness ous|aliti al|iviti ive|biliti ble"
)
_STEP3 = "icate ic|ative |alize al|iciti ic|ical ic|ful |ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_PAIRS2 = sorted((tuple(x.split(" ")) for x in _STEP2.split("|")), key=lambda p: -len(p[0]))
_PAIRS3 = sorted((tuple(x.split(" ")) for x in _STEP3.split("|")), key=lambda p: -len(p[0]))
_ENDS4 = sorted(_STEP4.split(), key=len, reverse=True)


def _forms(word: str) -> str:
    """c for consonants and v for vowels, letter by letter."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    form = _forms(word)
    return sum(a == "v" and b == "c" for a, b in zip(form, form[1:]))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _forms(word)[-1] == "c"


def _short(word: str) -> bool:
    return len(word) > 2 and _forms(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """Stem of a lower-case word; other words than of a-z stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _forms(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _forms(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            cut += "e"
        elif _double(cut) and cut[-1] not in "lsz":
            cut = cut[:-1]
        elif _measure(cut) == 1 and _short(cut):
            cut += "e"
        word = cut
    if word.endswith("y") and "v" in _forms(word[:-1]):
        word = word[:-1] + "i"
    for table in (_PAIRS2, _PAIRS3):
        for suffix, by in table:
            if word.endswith(suffix):
                if _measure(word[: -len(suffix)]) > 0:
                    word = word[: -len(suffix)] + by
                break
    for suffix in _ENDS4:
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(ArrayType(StringType()))
def porter_all(tokens: pd.Series) -> pd.Series:
    """Stems of arrays of words, in Arrow batches."""
    return tokens.map(lambda ws: None if ws is None else [porter(w) for w in ws])
