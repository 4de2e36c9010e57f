"""Corpus preparation: column inference, cleaning, de-duplication, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth import constants as C
from hearth.functions.labels import derive_emotion, in_taxonomy, normalize_emotion, strip_label_token
from hearth.functions.text import clean_text, is_blank, strip_blanks, text_or_empty, whole_word
from hearth.sources.tables import MissingColumns, require_columns


def infer_text(df: DataFrame, strip_synonyms: bool = False, null_literal: str = "") -> Column:
    """Text of a raw dialogue row, from whichever columns the table has."""
    if {"context", "utterance"} <= set(df.columns):
        context = strip_label_token(text_or_empty("context", null_literal), strip_synonyms)
        joined = F.concat(context, F.lit(C.PART_SEPARATOR), text_or_empty("utterance", null_literal))
        return strip_blanks(joined)
    for name in C.CORPUS_TEXT_COLUMNS:
        if name in df.columns:
            return text_or_empty(name, null_literal)
    raise MissingColumns(f"no text column; known ones: {', '.join(C.CORPUS_TEXT_COLUMNS)}")


def infer_index_text(df: DataFrame, null_literal: str = "") -> Column:
    """Text of a row to be indexed; this order of preference differs from the corpus one."""
    for names in C.INDEX_TEXT_COLUMNS:
        if set(names) <= set(df.columns):
            parts = [text_or_empty(n, null_literal) for n in names]
            if len(parts) == 1:
                return parts[0]
            return F.concat(parts[0], F.lit(C.PART_SEPARATOR), parts[1])
    raise MissingColumns("no text column to index")


def infer_emotion(df: DataFrame) -> Column:
    """Label column, else the first token of the context, else the default label."""
    for name in ("emotion", "label"):
        if name in df.columns:
            return F.col(name)
    if "context" in df.columns:
        return derive_emotion("context")
    return F.lit(C.DEFAULT_LABEL)


def clean_corpus(raw: DataFrame, max_chars: int = C.MAX_TEXT_CHARS, **options) -> DataFrame:
    """``(text, emotion)`` of every usable row; one narrow pass, no shuffle."""
    labelled = raw.select(infer_text(raw, **options).alias("text"), infer_emotion(raw).alias("emotion"))
    return labelled.filter(~is_blank(F.col("text"))).select(
        F.substring(clean_text("text"), 1, max_chars).alias("text"), normalize_emotion("emotion").alias("emotion")
    )


def dedup_corpus(corpus: DataFrame) -> DataFrame:
    """Distinct ``(text, emotion)``; copies collapse before the shuffle."""
    return corpus.select("text", "emotion").distinct()


def training_examples(df: DataFrame) -> DataFrame:
    """Training rows of a table with ``text`` and ``emotion``: trimmed, known labels, distinct."""
    require_columns(df, "text", "emotion")
    rows = df.select(
        strip_blanks(text_or_empty("text")).alias("text"),
        strip_blanks(F.lower(text_or_empty("emotion"))).alias("emotion"),
    )
    return dedup_corpus(rows.filter(in_taxonomy("emotion") & (F.col("text") != "")))


def keep_taxonomy(df: DataFrame, label: str = "emotion") -> DataFrame:
    return df.filter(in_taxonomy(label))


def unmapped_labels(df: DataFrame, taxonomy: DataFrame, label: str = "emotion") -> DataFrame:
    """Labels outside the taxonomy with their row counts."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"))
    return counts.join(taxonomy, "label", "left_anti")


def canonical_labels(df: DataFrame, synonyms: DataFrame, variant: str, token: str) -> DataFrame:
    """Add ``canonical``: the synonym of ``token`` if the variant lists one, else the token."""
    lookup = synonyms.filter(F.col("variant") == variant).select(F.col("raw").alias(token), "canonical")
    return df.join(lookup, token, "left").withColumn("canonical", F.coalesce("canonical", F.col(token)))


def typo_audit(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows holding each known typo before and after cleaning, in one pass over the text."""
    before, after = F.col(text), F.col("_fixed")
    fixed = df.select(text, clean_text(text).alias("_fixed"))
    counts = [F.count("*").alias("rows")]
    for i, typo in enumerate(C.TYPOS):
        counts.append(F.count_if(before.rlike(whole_word(typo))).alias(f"before_{i}"))
        counts.append(F.count_if(after.rlike(whole_word(typo))).alias(f"after_{i}"))
    totals = fixed.agg(*counts)
    entries = [
        F.struct(
            F.lit(typo).alias("typo"),
            F.col(f"before_{i}").alias("rows_before"),
            F.col(f"after_{i}").alias("rows_after"),
            F.col("rows").alias("rows"),
        )
        for i, typo in enumerate(C.TYPOS)
    ]
    return totals.select(F.inline(F.array(*entries)))


def label_distribution(df: DataFrame, label: str = "emotion") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("rows"))
