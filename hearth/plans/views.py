"""Dialogue-shaped views of the supplied tables; whole tables, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth import constants as C
from hearth.functions.vectors import hash_embed
from hearth.operators.memory import pair_turns
from hearth.session import spread

TEST_LEXICON = ["idiot", "moron", "clown", "worthless"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, spread over the cores for work that is heavy per text."""
    return spread(table(spark, folder, "documents"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """User messages with their reply, a user and a time."""
    paired = pair_turns(spread(table(spark, folder, "conversations")))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")
    created = F.timestamp_seconds(F.unix_timestamp(start) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return paired.select(
        F.concat_ws("_", "conv_id", "turn").alias("turn_id"),
        (F.col("conv_id") % 20).cast("string").alias("user_id"),
        F.col("conv_id").cast("string").alias("conversation_id"),
        "user_message",
        "bot_response",
        F.when(F.col("conv_id") % 3 == 0, "sad").when(F.col("conv_id") % 3 == 1, "").alias("emotion"),
        created.alias("created_at"),
        "conv_id",
        "turn",
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Short messages that state facts in every known form."""
    customer, part, nation, region = (table(spark, folder, n) for n in ("customer", "part", "nation", "region"))
    key = F.col("c_custkey")
    kind = key % 10
    text = (
        F.when(kind == 0, F.concat(F.lit("Hi! My name is "), "p_name", F.lit(".")))
        .when(kind == 1, F.concat(F.lit("I live in "), F.lower("r_name"), F.lit(", near the coast.")))
        .when(kind == 2, F.concat(F.lit("I work as "), F.lower("c_mktsegment"), F.lit(" clerk.")))
        .when(kind == 3, F.concat(F.lit("I am "), (20 + key % 60).cast("string"), F.lit(" years old.")))
        .when(kind == 4, F.concat(F.lit("I love "), "p_name", F.lit("!")))
        .when(kind == 5, F.lit("my wife is named Eve."))
        .when(kind == 6, F.concat(F.lit("I studied "), F.lower("p_type"), F.lit(". I can swim")))
        .when(kind == 7, F.lit("I am sad today"))
        .when(kind == 8, F.lit("   "))
        .otherwise(F.lit("Nothing to report"))
    )
    rows = (
        spread(customer).join(part, customer.c_custkey == part.p_partkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
    )
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:30").cast("timestamp_ntz").cast("timestamp"))
    return rows.select(
        key.alias("message_id"),
        (key % 20).cast("string").alias("user_id"),
        text.alias("user_message"),
        F.timestamp_seconds(start + key * 60).alias("created_at"),
    )


def raw_dialogues(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as raw dialogue rows: labels in the context, artefacts and typos in the text."""
    doc = texts(spark, folder)
    c, e = F.col("doc_id") % 5, F.col("doc_id") % 6
    context = (
        F.when(c == 0, F.concat(F.lit("Sad "), "source"))
        .when(c == 1, F.concat(F.lit("joy "), "source"))
        .when(c == 2, F.col("source"))
        .when(c == 4, F.lit("terrified"))
    )
    marked = F.replace(F.replace("text", F.lit(". "), F.lit("_comma_ ")), F.lit("the "), F.lit("loosing "))
    emotion = (
        F.when(e == 0, "Sad ").when(e == 1, "happiness").when(e == 2, "sad,").when(e == 4, "embarassed").when(e == 5, "grief")
    )
    return doc.select(
        "doc_id",
        context.alias("context"),
        F.concat(F.lit("  "), marked, F.lit("\xa0Embarassed")).alias("utterance"),
        emotion.alias("emotion"),
    )


def reply_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Replies as references, and the same replies with some words exchanged as predictions."""
    pred = F.col("bot_response")
    for word, other in {" the ": " a ", " la ": " une ", " die ": " eine ", " en ": " "}.items():
        pred = F.replace(pred, F.lit(word), F.lit(other))
    rows = turns(spark, folder).filter(F.col("bot_response").isNotNull())
    return rows.select(F.col("turn_id").alias("row_id"), pred.alias("pred"), F.col("bot_response").alias("ref"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") % 20).alias("user_id")
    )


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    toxicity = (F.lit(0.6) * F.col("toxic") + F.lit(0.2) * F.col("quality")).cast("double")
    insult = (F.col("doc_id") % 10 / F.lit(10.0)).cast("double")
    return scored.select(
        "doc_id", "text", F.create_map(F.lit("toxicity"), toxicity, F.lit("insult"), insult).alias("scores")
    )


def emotion_pairs(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("doc_id")
    gold = F.when(key % 4 == 0, "sad").when(key % 4 == 1, "joyful").when(key % 4 == 2, "angry").otherwise("lonely")
    pred = F.when(key % 7 == 0, "neutral").when(key % 5 == 0, "sad").otherwise(gold)
    return table(spark, folder, "documents").select("doc_id", gold.alias("gold"), pred.alias("pred"))


def token_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as token vectors of sentence pairs, twenty vectors to a pair."""
    return table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 20).alias("row_id"),
        F.when(F.col("vec_id") % 2 == 0, "cand").otherwise("ref").alias("side"),
        F.col("vec_id").alias("pos"),
        F.col("embedding").alias("vec"),
        (F.floor(F.col("vec_id") / 20) % 7 == 0).alias("used_fallback"),
    )


def request_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """User messages as JSON request bodies in which keys are missing, null or blank by turns."""
    conv = F.col("conv_id")
    body = (
        F.when(conv % 7 == 0, F.to_json(F.struct(F.col("user_message").alias("message"))))
        .when(conv % 7 == 1, F.lit('{"message": "  ", "use_filter": false}'))
        .when(conv % 7 == 2, F.lit('{"use_filter": null, "user_id": "u"}'))
        .when(conv % 7 == 3, F.lit("not json"))
        .otherwise(
            F.to_json(
                F.struct(
                    F.concat(F.lit("  "), "user_message", F.lit(" ")).alias("message"),
                    (conv % 2 == 0).alias("use_filter"),
                    "user_id",
                    "conversation_id",
                )
            )
        )
    )
    return turns(spark, folder).select("turn_id", body.alias("body"))


def collection(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a vector collection."""
    return texts(spark, folder).select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("document"),
        hash_embed("text", prefix=C.PASSAGE_PREFIX).alias("embedding"),
    )


def turn_queries(spark: SparkSession, folder: str) -> DataFrame:
    """User messages as retrieval queries; the query id is the id of the turn's memory record."""
    t = turns(spark, folder)
    return t.select(
        F.concat_ws("_", "user_id", F.date_format("created_at", "yyyyMMddHHmmssSSSSSS")).alias("query_id"),
        "user_id",
        F.col("user_message").alias("message"),
        F.when(F.col("emotion") != "", F.col("emotion")).alias("emotion"),
        (F.col("conv_id") % 2 == 0).alias("use_filter"),
        "bot_response",
        F.col("created_at").alias("asked_at"),
        hash_embed("user_message", prefix=C.QUERY_PREFIX).alias("embedding"),
    )
