"""Emotion label normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth import constants as C
from hearth.functions.text import as_column, blank_tokens, clean_text, first_token, strip_blanks, text_or_empty


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def in_taxonomy(label: Column | str) -> Column:
    return as_column(label).isin(C.TAXONOMY)


def to_taxonomy(token: Column, synonyms: dict[str, str]) -> Column:
    canonical = F.coalesce(F.element_at(literal_map(synonyms), token), token)
    return F.when(in_taxonomy(canonical), canonical).otherwise(F.lit(C.DEFAULT_LABEL))


def normalize_emotion(label: Column | str) -> Column:
    """Corpus label to taxonomy: first token of the cleaned text; punctuation stays."""
    token = F.substring_index(F.lower(clean_text(label)), " ", 1)
    return to_taxonomy(token, C.CORPUS_SYNONYMS)


def normalize_model_label(label: Column | str) -> Column:
    """Classifier output to taxonomy: first token without punctuation around it."""
    edge = "[" + "".join(f"\\{c}" for c in C.MODEL_LABEL_PUNCTUATION) + "]+"
    token = first_token(F.lower(text_or_empty(label)))
    token = F.regexp_replace(token, f"^{edge}|{edge}$", "")
    known = F.when(in_taxonomy(token), token)
    return F.coalesce(known, to_taxonomy(token, C.MODEL_SYNONYMS))


def derive_emotion(context: Column | str) -> Column:
    """Label read from the first token of the context, when no label column exists."""
    return to_taxonomy(F.lower(first_token(text_or_empty(context))), C.CORPUS_SYNONYMS)


def strip_label_token(context: Column | str, strip_synonyms: bool = False) -> Column:
    """Drop a leading label from the context, so that it cannot leak into the text."""
    text = strip_blanks(text_or_empty(context))
    labels = C.TAXONOMY + (list(C.CORPUS_SYNONYMS) if strip_synonyms else [])
    tokens = blank_tokens(text)
    rest = F.array_join(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), " ")
    return F.when(F.lower(first_token(text)).isin(labels), rest).otherwise(text)


def taxonomy_table(spark: SparkSession) -> DataFrame:
    rows = [(x, x == C.DEFAULT_LABEL) for x in C.TAXONOMY]
    return spark.createDataFrame(rows, "label string, is_default boolean")


def synonym_table(spark: SparkSession) -> DataFrame:
    rows = [("corpus", k, v) for k, v in C.CORPUS_SYNONYMS.items()]
    rows += [("model", k, v) for k, v in C.MODEL_SYNONYMS.items()]
    return spark.createDataFrame(rows, "variant string, raw string, canonical string")
