"""Toxicity decisions and sanitising."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth import constants as C
from hearth.functions.text import as_column

SCORES = "map<string,double>"


def lexicon_scores(text: Column | str, words: list[str] = C.TOXIC_WORDS) -> Column:
    """``{word: 1.0}`` for the first listed word found as a whole word, else an empty map.

    Plain words are found in a single scan with one alternation; entries with
    other characters could overlap in a scan and get a search of their own.
    """
    lower = F.lower(F.coalesce(as_column(text), F.lit("")))
    words = [w.lower() for w in words]
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    if not words:
        return empty
    listed = F.array(*[F.lit(w) for w in words])
    if all(re.fullmatch(r"\w+", w) for w in words):
        pattern = r"(?U)\b(" + "|".join(words) + r")\b"
        found = F.array_intersect(listed, F.regexp_extract_all(lower, F.lit(pattern), F.lit(1)))
    else:
        hits = [F.when(lower.rlike(rf"(?U)\b{re.escape(w)}\b"), F.lit(w)) for w in words]
        found = F.array_compact(F.array(*hits))
    first = F.get(found, F.lit(0))
    return F.when(first.isNotNull(), F.create_map(first, F.lit(1.0))).otherwise(empty)


def max_score(scores: Column | str) -> Column:
    """Highest score of the map, 0 for an empty or missing one."""
    values = F.map_values(F.transform_values(as_column(scores), lambda _, v: v.cast("double")))
    return F.coalesce(F.array_max(values), F.lit(0.0))


def is_toxic_scores(scores: Column | str, threshold: float = C.TOXIC_THRESHOLD) -> Column:
    return max_score(scores) >= F.lit(float(threshold))


def sanitize(text: Column | str, toxic: Column | str, refusal: str = C.REFUSAL) -> Column:
    """The whole text is replaced when toxic."""
    return F.when(as_column(toxic), F.lit(refusal)).otherwise(as_column(text))


def guard(
    df: DataFrame,
    text: str,
    scores: Column | None = None,
    threshold: float = C.TOXIC_THRESHOLD,
    use_filter: Column | None = None,
    words: list[str] = C.TOXIC_WORDS,
    refusal: str = C.REFUSAL,
) -> DataFrame:
    """Add ``scores, max_score, toxic, final_text``; works on batch and stream alike.

    With ``scores`` the decision is a threshold on them, otherwise the word list
    decides. Rows with ``use_filter`` false pass unscored.
    """
    decided_by_score = scores is not None
    scored = scores if decided_by_score else lexicon_scores(text, words)
    if use_filter is not None:
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
        scored = F.when(use_filter, scored).otherwise(empty)
    out = df.withColumn("scores", scored).withColumn("max_score", max_score("scores"))
    toxic = (
        (F.col("max_score") >= F.lit(float(threshold))) & (F.coalesce(F.size("scores"), F.lit(0)) > 0)
        if decided_by_score
        else F.size("scores") > 0
    )
    return out.withColumn("toxic", toxic).withColumn("final_text", sanitize(text, "toxic", refusal))
