"""Streams over chat turns: memory ingest, running statistics, guard, retrieval.

All sinks are files below folders the caller names; nothing is gathered on the
driver. A replayed micro-batch overwrites its own ``batch_id`` folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hearth import constants as C
from hearth.functions.safety import guard
from hearth.functions.vectors import hash_embed
from hearth.operators.memory import memory_records, memory_stats, retrieve_memories, save_memory, stamp
from hearth.operators.cells import CellIndex
from hearth.operators.nearest import nearest
from hearth.operators.store import MOST_VERSIONS, KeyedStore

TURN_SCHEMA = T.StructType(
    [
        T.StructField("turn_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("conversation_id", T.StringType()),
        T.StructField("user_message", T.StringType()),
        T.StructField("bot_response", T.StringType()),
        T.StructField("emotion", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def read_stream(spark: SparkSession, path: str, schema: T.StructType = TURN_SCHEMA, files_per_batch: int | None = None, **options) -> DataFrame:
    """File stream; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _start(writer, checkpoint: str, drain: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if drain else writer.start()


def _per_batch(path: str, job: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def ingest_memory(
    turns: DataFrame, store: KeyedStore, checkpoint: str, stats: str | None = None, drain: bool = True, merge_over: int = MOST_VERSIONS, **options
) -> StreamingQuery:
    """Turn and fact records stored once per id, however often or late a turn arrives.

    A micro-batch stores the records whose id no earlier one has stored; a replayed
    one finds itself done. No state is kept besides the table. Once more than
    ``merge_over`` micro-batches have left files of their own, the smallest are
    merged. With ``stats`` the counts of the new records per user are written
    there, see :func:`latest_stats`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        here = KeyedStore(batch.sparkSession, store.path, store.key, store.bucket_by, store.buckets)
        saved = save_memory(here, memory_records(batch, **options), txn=(checkpoint, batch_id))
        if stats:
            memory_stats(here.saved_in(saved.version)).write.mode("overwrite").parquet(f"{stats}/batch_id={batch_id}")
        here.merge(merge_over)

    return _start(turns.writeStream.foreachBatch(write), checkpoint, drain)


def latest_stats(written: DataFrame) -> DataFrame:
    """Statistics per user from the counts that :func:`ingest_memory` wrote batch by batch."""
    return written.groupBy("user_id").agg(*[F.sum(n).alias(n) for n in ("total", "conversations", "facts")])


def guard_replies(replies: DataFrame, text: str, path: str, checkpoint: str, drain: bool = True, **options) -> StreamingQuery:
    guarded = guard(replies, text, **options)
    writer = guarded.writeStream.outputMode("append").format("parquet").option("path", path)
    return _start(writer, checkpoint, drain)


def retrieve_for_turns(
    turns: DataFrame,
    memory: Callable[[], DataFrame | KeyedStore],
    collection: Callable[[], DataFrame | CellIndex],
    path: str,
    checkpoint: str,
    memories: int = C.MEMORIES_PER_QUERY,
    contexts: int = C.CONTEXTS_PER_QUERY,
    drain: bool = True,
) -> StreamingQuery:
    """Memories and contexts of every arriving turn, ``source`` naming which.

    Both tables are read anew per micro-batch; of a stored memory only the buckets
    of the asking users, of a stored index only the cells that can hold a hit. A
    turn sees the memories created before it; ``query_id`` is the id its own memory
    record has or will have.
    """

    def job(batch: DataFrame) -> DataFrame:
        queries = batch.select(
            F.concat_ws("_", "user_id", stamp(F.col("created_at"))).alias("query_id"),
            "user_id",
            F.col("created_at").alias("asked_at"),
            hash_embed("user_message", prefix=C.QUERY_PREFIX).alias("embedding"),
        )
        columns = ["query_id", "source", "rank", F.col("id").cast("string").alias("id"), "distance"]
        known = retrieve_memories(queries, memory(), memories, asked_at="asked_at").withColumn("source", F.lit("memory"))
        points = collection()
        hits = points.nearest(queries, contexts) if isinstance(points, CellIndex) else nearest(queries, points, contexts)
        found = hits.withColumn("source", F.lit("context"))
        return known.select(*columns).unionByName(found.select(*columns))

    return _start(turns.writeStream.foreachBatch(_per_batch(path, job)), checkpoint, drain)
