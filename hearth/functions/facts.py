"""Personal facts stated in a message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearth import constants as C
from hearth.functions.text import as_column, strip_blanks

# i: any case, u: beyond ASCII, U: blanks and digits of all scripts, d: only \n ends a line
FLAGS = "(?iuUd)"


def _pattern(kind: str, pattern: str, strict_names: bool) -> str:
    if strict_names and kind == "name":
        trigger, value = pattern.split(r"\s+(", 1)
        return rf"(?uUd)(?i:{trigger})\s+({value}"
    return FLAGS + pattern


def _records(kind: str, values: Column, sentence: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    return F.transform(
        values,
        lambda v: F.struct(F.lit(kind).alias("kind"), value(v).alias("value"), sentence(v).alias("fact")),
    )


def fact_details(message: Column | str, strict_names: bool = False) -> Column:
    """Array of ``struct(kind, value, fact)``, one per match, in pattern order."""
    message = as_column(message)

    def matches(kind: str, pattern: str) -> Column:
        regex = F.lit(_pattern(kind, pattern, strict_names))
        groups = [F.regexp_extract_all(message, regex, F.lit(i)) for i in (1, 2)]
        if kind != "taste":
            return groups[0]
        return F.arrays_zip(groups[0].alias("verb"), groups[1].alias("thing"))

    def filled(sentence: str) -> Callable[[Column], Column]:
        head, slot, tail = sentence.partition("{0}")
        return lambda v: F.concat(F.lit(head), strip_blanks(v), F.lit(tail)) if slot else F.lit(head)

    def taste(v: Column) -> Column:
        return F.concat(F.lit("User "), v.getField("verb"), F.lit(" "), strip_blanks(v.getField("thing")))

    found = []
    for kind, pattern, sentence in C.FACT_PATTERNS:
        values = matches(kind, pattern)
        if kind == "taste":
            found.append(_records(kind, values, taste, lambda v: strip_blanks(v.getField("thing"))))
        else:
            found.append(_records(kind, values, filled(sentence), strip_blanks))
    return F.filter(F.concat(*found), lambda f: F.length(f.getField("fact")) >= C.MIN_FACT_CHARS)


def extract_facts(message: Column | str, strict_names: bool = False) -> Column:
    """Distinct fact sentences of a message, sorted."""
    details = fact_details(message, strict_names)
    return F.array_sort(F.array_distinct(F.transform(details, lambda f: f.getField("fact"))))
