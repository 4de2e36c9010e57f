"""Conversation memory: turn and fact records, listing, statistics, deletion, prompt lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth import constants as C
from hearth.functions.facts import extract_facts
from hearth.functions.prompts import non_empty
from hearth.functions.text import cut, strip_blanks
from hearth.functions.vectors import hash_embed, relevance
from hearth.operators.nearest import nearest
from hearth.operators.ordering import top_per_group, with_next
from hearth.operators.store import KeyedStore, Saved

MEMORY_COLUMNS = [
    "id", "user_id", "conversation_id", "type", "document", "user_message",
    "bot_response", "emotion", "created_at", "embedding",
]
USER_BUCKETS = 256


def pair_turns(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               user: str = "user", assistant: str = "assistant") -> DataFrame:
    """Each user message with the assistant message right after it, null if none follows."""
    paired = with_next(messages, conv, turn, [role, text], "_next")
    reply = F.when(F.col(f"_next.{role}") == assistant, F.col(f"_next.{text}"))
    return paired.filter(F.col(role) == user).select(
        conv, turn, F.col(text).alias("user_message"), reply.alias("bot_response")
    )


def stamp(created_at: Column) -> Column:
    return F.date_format(created_at, "yyyyMMddHHmmssSSSSSS")


def _present(message: str) -> Column:
    return F.coalesce(strip_blanks(F.col(message)), F.lit("")) != ""


def turn_document(message: Column, reply: Column) -> Column:
    said = F.concat(F.lit(C.USER_SAID), message)
    return F.when(
        reply.isNotNull() & (reply != ""), F.concat(said, F.lit(C.ASSISTANT_SAID), reply)
    ).otherwise(said)


def _turn_record() -> Column:
    user, created = F.col("user_id").cast("string"), F.col("created_at")
    return F.struct(
        F.concat_ws("_", user, stamp(created)).alias("id"),
        user.alias("user_id"),
        non_empty(F.col("conversation_id").cast("string"), C.UNKNOWN).alias("conversation_id"),
        F.lit(C.TURN).alias("type"),
        turn_document(F.col("user_message"), F.col("bot_response")).alias("document"),
        F.substring("user_message", 1, C.METADATA_CHARS).alias("user_message"),
        F.substring(F.coalesce("bot_response", F.lit("")), 1, C.METADATA_CHARS).alias("bot_response"),
        non_empty(F.col("emotion"), C.UNKNOWN).alias("emotion"),
        created.alias("created_at"),
        F.col("user_message").alias("embed_text"),
    )


def _fact_record(fact: Column) -> Column:
    user, created = F.col("user_id").cast("string"), F.col("created_at")
    none = F.lit(None).cast("string")
    return F.struct(
        F.concat_ws("_", user, F.lit("fact"), stamp(created), F.substring(F.md5(fact), 1, 12)).alias("id"),
        user.alias("user_id"),
        none.alias("conversation_id"),
        F.lit(C.FACT).alias("type"),
        fact.alias("document"),
        none.alias("user_message"),
        none.alias("bot_response"),
        none.alias("emotion"),
        created.alias("created_at"),
        fact.alias("embed_text"),
    )


def _embedded(records: DataFrame, embed) -> DataFrame:
    embed = embed or (lambda text: hash_embed(text, prefix=C.QUERY_PREFIX))
    return records.withColumn("embedding", embed(F.col("embed_text"))).select(*MEMORY_COLUMNS)


def turn_records(turns: DataFrame, embed=None) -> DataFrame:
    """Memory records of turns ``(user_id, conversation_id, user_message, bot_response,
    emotion, created_at)``; turns with a blank message are skipped."""
    kept = turns.filter(_present("user_message"))
    return _embedded(kept.select(_turn_record().alias("r")).select("r.*"), embed)


def fact_records(facts: DataFrame, fact: str = "fact", embed=None) -> DataFrame:
    """Memory records of given facts ``(user_id, fact, created_at)``; blank ones are skipped."""
    kept = facts.filter(_present(fact))
    return _embedded(kept.select(_fact_record(F.col(fact)).alias("r")).select("r.*"), embed)


def extracted_fact_records(messages: DataFrame, message: str = "user_message", embed=None, strict_names: bool = False) -> DataFrame:
    """Fact records found in messages; they take the time of the message."""
    facts = messages.filter(_present(message)).select(
        "user_id", "created_at", F.explode(extract_facts(message, strict_names)).alias("fact")
    )
    return fact_records(facts, embed=embed)


def memory_records(turns: DataFrame, embed=None, strict_names: bool = False) -> DataFrame:
    """Turn and fact records of every turn in one pass over the input; streams too."""
    kept = turns.filter(_present("user_message"))
    facts = F.transform(extract_facts("user_message", strict_names), _fact_record)
    records = kept.select(F.explode(F.concat(F.array(_turn_record()), facts)).alias("r")).select("r.*")
    return _embedded(records, embed)


def new_records(records: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Records whose id is not stored yet; the stored record wins, and of several new ones the smallest row."""
    first = records.groupBy(key).agg(F.min(F.struct(*[c for c in records.columns if c != key])).alias("_row"))
    unique = first.select(key, "_row.*").select(*records.columns)
    return unique.join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    return existing.unionByName(new_records(records, existing, key))


def with_bucket(records: DataFrame, buckets: int = USER_BUCKETS) -> DataFrame:
    return records.withColumn("user_bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))


def write_memory(records: DataFrame, path: str, buckets: int = USER_BUCKETS) -> None:
    """Append records below folders of user buckets, which lookups by user prune.

    Rows are brought together by bucket first, so that a task does not open a
    file in every folder; adaptive execution splits the buckets of busy users.
    """
    with_bucket(records, buckets).hint("rebalance", "user_bucket").write.mode("append").partitionBy("user_bucket").parquet(path)


def read_user(memory: DataFrame, user_id: str, buckets: int = USER_BUCKETS) -> DataFrame:
    """Records of one user; reads a single bucket folder."""
    bucket = F.pmod(F.xxhash64(F.lit(user_id)), F.lit(buckets)).cast("int")
    return memory.filter((F.col("user_bucket") == bucket) & (F.col("user_id") == user_id))


def memory_store(spark: SparkSession, path: str, buckets: int = USER_BUCKETS) -> KeyedStore:
    """Memory below ``path``: one record per id, in buckets of users."""
    return KeyedStore(spark, path, key="id", bucket_by="user_id", buckets=buckets)


def save_memory(store: KeyedStore, records: DataFrame, txn: tuple[str, int] | None = None) -> Saved:
    """Store records once per id. How many turns and facts were saved is counted by the write itself."""
    kinds = {"turns": F.count_if(F.col("type") == C.TURN), "facts": F.count_if(F.col("type") == C.FACT)}
    return store.append(records.select(*MEMORY_COLUMNS), txn, **kinds)


def saved_per_user(store: KeyedStore, version: int) -> DataFrame:
    """``(user_id, turns, facts)`` that one save has stored; users with none have no row."""
    kinds = [F.count_if(F.col("type") == kind).alias(name) for name, kind in (("turns", C.TURN), ("facts", C.FACT))]
    return store.saved_in(version).groupBy("user_id").agg(*kinds)


def memory_stats(memory: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """``(user_id, total, conversations, facts)``; with ``users`` also those without records."""
    stats = memory.groupBy("user_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("type") == C.TURN).alias("conversations"),
        F.count_if(F.col("type") == C.FACT).alias("facts"),
    )
    if users is None:
        return stats
    zero = {"total": 0, "conversations": 0, "facts": 0}
    return users.select("user_id").distinct().join(stats, "user_id", "left").fillna(zero)


def listing_line() -> Column:
    message = F.coalesce(F.substring("user_message", 1, C.LISTING_MESSAGE_CHARS), F.lit(""))
    return (
        F.when(F.col("type") == C.FACT, F.concat(F.lit(C.FACT_ICON), F.col("document")))
        .when(
            F.col("type") == C.TURN,
            F.when(message != "", F.concat(F.lit(C.TURN_ICON), message, F.lit("..."))),
        )
        .otherwise(cut("document", C.LISTING_OTHER_CHARS))
    )


def memory_listing(memory: DataFrame, limit: int = C.LISTING_LIMIT) -> DataFrame:
    """The newest ``limit`` records of every user as lines; a turn without a message
    uses up its place but prints nothing."""
    newest = top_per_group(memory, ["user_id"], [F.desc("created_at"), F.col("id")], limit)
    lines = newest.select("user_id", "rank", "id", "type", listing_line().alias("line"))
    return lines.filter(F.col("line").isNotNull())


def clear_users(memory: DataFrame, cleared: DataFrame) -> DataFrame:
    """Records left after users were cleared; ``cleared`` is ``(user_id[, cleared_at])``.

    With ``cleared_at`` only records up to that time go, so the table can stay
    as an append-only list of deletions next to the memory.
    """
    if "cleared_at" not in cleared.columns:
        return memory.join(cleared.select("user_id").distinct(), "user_id", "left_anti")
    last = cleared.groupBy(F.col("user_id").alias("_user")).agg(F.max("cleared_at").alias("_cleared"))
    gone = (F.col("user_id") == F.col("_user")) & (F.col("created_at") <= F.col("_cleared"))
    return memory.join(last, gone, "left_anti")


def clear_conversations(messages: DataFrame, cleared: DataFrame, key: str = "conv_id") -> DataFrame:
    return messages.join(cleared.select(key).distinct(), key, "left_anti")


def retrieve_memories(queries: DataFrame, memory: DataFrame | KeyedStore, k: int = C.MEMORIES_PER_QUERY, asked_at: str | None = None, **options) -> DataFrame:
    """Top ``k`` memories of the asking user for queries ``(query_id, user_id, embedding)``.

    With ``asked_at``, a time column of the queries, only memories created before
    it count, as in a turn that retrieves before it is saved. Of a stored memory
    only the buckets of the asking users are scanned, for vectors and for texts.
    """
    if isinstance(memory, KeyedStore):
        memory = memory.read().join(F.broadcast(memory.touched(queries)), "bucket", "left_semi")
    hits = nearest(queries, memory, k, by="user_id", earlier=(asked_at, "created_at") if asked_at else None, **options)
    details = memory.select(
        "user_id", "id", F.col("document").alias("content"), "type", "user_message", "bot_response", "emotion", "created_at"
    )
    owned = hits.withColumn("relevance", relevance("distance")).join(queries.select("query_id", "user_id"), "query_id")
    return owned.join(details, ["user_id", "id"]).drop("user_id")


def _prompt_hits(hits: DataFrame, max_items: int, max_facts: int) -> DataFrame:
    """``(query_id, kept)``: the hits of every query that enter the prompt, facts first,
    then turns in what is left. The few hits of a query are gathered once, in rank order."""
    fields = [c for c in hits.columns if c not in ("query_id", "rank")]
    ranked = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    gathered = hits.groupBy("query_id").agg(ranked.alias("hits"))

    def of_type(kind: str) -> Column:
        return F.filter("hits", lambda h: h.getField("type") == kind)

    facts = F.slice(of_type(C.FACT), 1, max_facts)
    left = F.greatest(F.lit(max_items) - F.size(facts), F.lit(0))
    return gathered.select("query_id", F.concat(facts, F.slice(of_type(C.TURN), F.lit(1), left)).alias("kept"))


def memory_prompt_lines(hits: DataFrame, max_items: int = C.MEMORY_ITEMS, max_facts: int = C.MEMORY_FACTS) -> DataFrame:
    """Hits that enter the prompt, with ``slot`` from 1: facts first, then turns in what is left."""
    placed = _prompt_hits(hits, max_items, max_facts).select("query_id", F.posexplode("kept").alias("_place", "_hit"))
    return placed.select("query_id", "_hit.*", (F.col("_place") + 1).alias("slot"))


def _memory_line(hit: Column) -> Column:
    """The printed line of a hit; null for a turn without a message."""
    message = F.coalesce(hit.getField("user_message"), F.lit(""))
    reply = F.coalesce(hit.getField("bot_response"), F.lit(""))
    said = F.concat(F.lit(C.MEMORY_SAID), cut(message, C.MEMORY_MESSAGE_CHARS), F.lit('"'))
    answered = F.concat(F.lit(C.MEMORY_ANSWERED), cut(reply, C.MEMORY_REPLY_CHARS), F.lit('"'))
    return F.when(hit.getField("type") == C.FACT, F.concat(F.lit(C.MEMORY_FACT_LINE), hit.getField("content"))).when(
        message != "", F.concat(said, F.when(reply != "", answered).otherwise(F.lit("")))
    )


def memory_block(hits: DataFrame, max_items: int = C.MEMORY_ITEMS, max_facts: int = C.MEMORY_FACTS) -> DataFrame:
    """``(query_id, memory_block)``: prompt text of the retrieved memories; queries
    without hits have no row. One grouping of the hits, whose lines are then made in place."""
    printed = hits.select("query_id", "rank", "type", "content", "user_message", "bot_response")
    lines = F.array_compact(F.transform("kept", _memory_line))
    block = F.array_join(F.concat(F.array(F.lit(C.MEMORY_HEADER)), lines), "\n")
    return _prompt_hits(printed, max_items, max_facts).select("query_id", block.alias("memory_block"))


def conversation_summary(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Title and number of messages of every conversation, newest (highest id) first."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col(turn)))
    return messages.groupBy(conv).agg(
        F.coalesce(cut(first, C.TITLE_CHARS), F.lit("New chat")).alias("title"),
        F.count("*").alias("messages"),
    ).orderBy(F.desc(conv))
