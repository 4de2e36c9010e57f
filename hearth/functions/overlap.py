"""Token functions of the overlap metrics: 13a tokens, stems, longest common subsequence."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hearth.functions.text import BLANK_CHARS, as_column, blank_tokens

# fixed values: the rules of the public mteval-13a tokeniser, in order; the first
# leaves out the space, which ends up between tokens either way
ENTITIES = {"&quot;": '"', "&amp;": "&", "&lt;": "<", "&gt;": ">"}
SPLIT_RULES = [
    (r"([{-~\[-`!-&(-+:-@/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]


def tokens_13a(text: Column | str) -> Column:
    """Array of mteval-13a tokens; case is kept."""
    line = F.rtrim(as_column(text), F.lit(BLANK_CHARS))
    for mark, into in {"<skipped>": "", "-\n": "", "\n": " ", **ENTITIES}.items():
        line = F.replace(line, F.lit(mark), F.lit(into))
    line = F.concat(F.lit(" "), line, F.lit(" "))
    for rule, into in SPLIT_RULES:
        line = F.regexp_replace(line, rule, into)
    return blank_tokens(line)


def words_az09(text: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.array_remove(F.split(F.lower(as_column(text)), "[^a-z0-9]+"), "")


# ---- Porter stemming ---------------------------------------------------------
# Porter (1980) with the usual later changes: irregular forms, short -ies/-ied,
# y after a consonant only, -alli/-fulli/-logi, and two-letter stems ending cvc.

# fixed values: suffix tables of the published algorithm
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}


def _shape(stem: str) -> str:
    """One letter per character: v for a vowel (y after a consonant too), else c."""
    out = ""
    for ch in stem:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    shape = _shape(stem)
    return (len(stem) > 2 and shape.endswith("cvc") and stem[-1] not in "wxy") or shape == "vc"


def _double_consonant(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def _plurals_and_tenses(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]

    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        stem = w[: -len(suffix)]
        if w.endswith(suffix) and "v" in _shape(stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_consonant(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem
    return w


def _swap(w: str, table: list[tuple[str, str]]) -> str:
    for suffix, into in table:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + into if _measure(stem) > 0 else w
    return w


@lru_cache(maxsize=1 << 16)
def porter_stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _plurals_and_tenses(word)
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    if w.endswith("logi"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        w = _swap(w, STEP2)
    w = _swap(w, STEP3)
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _ends_cvc(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit vectors: one big-integer step per token of ``b``."""
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def clipped_ngrams(pred: list[str], ref: list[str], orders: int) -> list[int]:
    """Clipped matches of every order, n-grams of every order in ``pred``, length of ``ref``."""
    matches = []
    for n in range(1, orders + 1):
        p, r = (Counter(zip(*(side[i:] for i in range(n)))) for side in (pred, ref))
        matches.append((p & r).total())
    return [*matches, *(max(0, len(pred) - n + 1) for n in range(1, orders + 1)), len(ref)]


def ngram_overlap(pred: Column, ref: Column, orders: int) -> Column:
    """:func:`clipped_ngrams` of two token arrays."""

    @F.pandas_udf("array<long>")
    def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p_side, r_side in batches:
            yield pd.Series([clipped_ngrams(list(p), list(r), orders) for p, r in zip(p_side, r_side)])

    return measure(pred, ref)


def stems(tokens: list[str]) -> list[str]:
    return [porter_stem(t) if len(t) > 3 else t for t in tokens]


def lcs_sizes(left: Column, right: Column, stem: bool) -> Column:
    """``[common length, left length, right length]`` of two token arrays."""

    @F.pandas_udf("array<int>")
    def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tokens = stems if stem else list
        for a_side, b_side in batches:
            yield pd.Series([[lcs_length(tokens(a), tokens(b)), len(a), len(b)] for a, b in zip(a_side, b_side)])

    return measure(left, right)
