"""Text cleaning, token and cut functions as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearth import constants as C

# Every character Python's str.split() takes as blank: Unicode white space and four
# separators. As a regex class (which needs the U flag) and as plain characters.
BLANK = r"[\s\x1c-\x1f]"
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column used several times, or inside a lambda, may be evaluated each time;
    as the element of a one-item array it becomes a plain variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(value: Column | str, null_literal: str = "") -> Column:
    """Text of a cell; a missing cell becomes ``null_literal``."""
    return F.coalesce(as_column(value).cast("string"), F.lit(null_literal))


def collapse_blanks(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, f"(?U){BLANK}+", " "))


def strip_blanks(value: Column) -> Column:
    """Unicode-aware trim; inner blanks are kept."""
    return F.trim(value, F.lit(BLANK_CHARS))


def first_token(value: Column) -> Column:
    return F.regexp_extract(value, r"(?U)[^\s\x1c-\x1f]+", 0)


def whole_word(word: str) -> str:
    return rf"(?iU)\b{word}\b"


def fix_typos(value: Column) -> Column:
    """Whole-word spelling fixes, applied to every text."""
    for wrong, right in C.TYPOS.items():
        value = F.regexp_replace(value, whole_word(wrong), right)
    return value


def clean_text(value: Column | str, null_literal: str = "") -> Column:
    """Drop corpus artefacts, fix known typos and collapse every run of blanks."""
    text = F.replace(text_or_empty(value, null_literal), F.lit("\x00"), F.lit(""))
    for artefact, mark in C.ARTEFACTS.items():
        text = F.replace(text, F.lit(artefact), F.lit(mark))
    return bind(text, lambda t: collapse_blanks(fix_typos(t)))


def is_blank(value: Column) -> Column:
    """True for texts that cleaning leaves empty; far cheaper than cleaning them."""
    return ~value.rlike(r"(?U)[^\s\x00\x1c-\x1f]")


def with_prefix(prefix: str, value: Column | str) -> Column:
    return F.concat(F.lit(prefix), as_column(value))


def cut(value: Column | str, limit: int) -> Column:
    """First ``limit`` characters followed by dots, if there are more."""
    value = as_column(value)
    return F.when(
        F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("..."))
    ).otherwise(value)


def snippet(value: Column | str, limit: int = C.SNIPPET_CHARS) -> Column:
    """One-line preview that never exceeds ``limit`` characters, dots included."""
    line = F.replace(text_or_empty(value), F.lit("\n"), F.lit(" "))
    return F.when(
        F.length(line) > limit, F.concat(F.substring(line, 1, limit - 3), F.lit("..."))
    ).otherwise(line)


def title(value: Column | str) -> Column:
    return cut(value, C.TITLE_CHARS)


def missing_to_null(value: Column | str) -> Column:
    """Null for every spelling the CSV reader of the source data takes as missing."""
    value = as_column(value)
    return F.when(value.isin(C.MISSING_SPELLINGS), F.lit(None)).otherwise(value)


def blank_tokens(value: Column) -> Column:
    """Tokens between blanks, without empty ones."""
    return F.array_remove(F.split(value, f"(?U){BLANK}+"), "")
