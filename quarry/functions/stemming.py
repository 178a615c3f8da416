"""English stems by suffix stripping (Porter, "An algorithm for suffix stripping", 1980): rules as data, one small interpreter.

A rule (suffix, replacement) of a step applies to the longest suffix that a word has, if the stem before it meets the step's condition. The measure of a stem is the
number of its runs of vowels that a consonant follows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules of the paper's steps.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# Words that a text search leaves out.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by",
    "can", "did", "do", "does", "doing", "don", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself",
    "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other",
    "our", "ours", "ourselves", "out", "over", "own", "s", "same", "she", "should", "so", "some", "such", "t", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there",
    "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with",
    "you", "your", "yours", "yourself", "yourselves",
)

_PLAIN = re.compile(r"[a-z]{3,}")


def _form(stem: str) -> str:
    """v for each vowel, c for each consonant; a y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _form(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last of which is none of w, x, y."""
    return _form(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _form(stem).endswith("c")


def _longest(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if _measure(stem) >= least else word
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-cased word. Words with other signs than a to z, and those of one or two letters, stay as they are."""
    if not _PLAIN.fullmatch(word):
        return word
    word = _longest(word, PLURALS, 0)
    cut = next((word[: len(word) - len(s)] for s in ("ed", "ing") if word.endswith(s)), None)
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif cut is not None and "v" in _form(cut):
        word = cut
        if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short(word)):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(_longest(word, STEP_2, 1), STEP_3, 1)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            head = word[: len(word) - len(suffix)]
            word = head if _measure(head) > 1 and (suffix != "ion" or head.endswith(("s", "t"))) else word
            break
    if word.endswith("e"):
        head = word[:-1]
        word = head if _measure(head) > 1 or (_measure(head) == 1 and not _short(head)) else word
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stems(words: Column) -> Column:
    """The stem of each word of an array; a null array stays null."""

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(words)
