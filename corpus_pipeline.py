"""The corpus pipeline: filter, deduplicate and pack documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents. Between stages the rows
are written as Parquet and read again. Null, empty and repeated rows are handled
as the operators' docstrings say: a text that is null or has no letter goes with
the languages, of equal rows one stays, an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm import langid, packing, quality, simhash, substrings
from hearth.session import materialised

NEAR_WORDS, NEAR_BITS = 3, 3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _same_columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a calibrated score that is accepted."""
    model = langid.fit(docs)
    scored = langid.identify(docs.select(F.struct("*").alias("row"), "text"), model)
    return scored.where("accepted").select("row.*")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer trained on weak labels does not reject."""
    scored = quality.judge(docs.select(F.struct("*").alias("row"), "text"), quality.fit(docs))
    return scored.where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that links of at most 3 differing fingerprint bits reach."""
    return simhash.keep_one(docs, words=NEAR_WORDS, radius=NEAR_BITS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words and more that occur elsewhere; n_chars follows."""
    found = substrings.dedup_substrings(docs, keep_space=True)
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return _same_columns(found, docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 2048."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
