import json
from datetime import datetime

from pyspark.sql import functions as F

from hearth import constants as C
from hearth.functions import safety
from hearth.operators import memory as M
from hearth.session import scratch_path
from hearth.sources import requests as R
from hearth.streaming import turns as S


def turn_files(spark, copies=1):
    rows = [
        (f"t{i}", f"u{i % 3}", "c", f"I can swim {'x' * i}" if i % 2 else f"hello {i}", "worthless" if i % 4 == 0 else "fine", None,
         datetime(2024, 1, 1, 0, i))
        for i in range(20)
    ]
    path = scratch_path(spark, "test-turns")
    turns = spark.createDataFrame(rows, S.TURN_SCHEMA)
    for _ in range(copies):
        turns.repartition(3).write.mode("append").parquet(path)
    return path, turns


def test_ingest_equals_batch_and_drops_repeats(spark):
    path, turns = turn_files(spark, copies=2)
    out, state = M.memory_store(spark, scratch_path(spark, "out")), scratch_path(spark, "state")
    S.ingest_memory(S.read_stream(spark, path, files_per_batch=2), out, state).awaitTermination()
    columns = ["id", "type", "document", "user_message", "created_at"]
    got = sorted(map(str, out.read().select(columns).collect()))
    assert got == sorted(map(str, M.memory_records(turns).select(columns).collect()))


def test_ingest_goes_on_where_it_stopped(spark):
    path, turns = turn_files(spark)
    out, state = M.memory_store(spark, scratch_path(spark, "out")), scratch_path(spark, "state")
    S.ingest_memory(S.read_stream(spark, path), out, state).awaitTermination()
    before = out.read().count()
    turns.write.mode("append").parquet(path)
    late = turns.limit(1).withColumn("user_id", F.lit("new")).withColumn("created_at", F.lit(datetime(2024, 1, 1, 0, 30)))
    late.write.mode("append").parquet(path)
    S.ingest_memory(S.read_stream(spark, path), out, state).awaitTermination()
    assert out.read().count() == before + M.memory_records(late).count()


def test_late_turns_are_stored(spark):
    path, state = scratch_path(spark, "late"), scratch_path(spark, "state")
    out = M.memory_store(spark, scratch_path(spark, "out"))
    for hour in (0, 10, 20, 1, 10):
        row = (f"t{hour}", "u", "c", "hello", None, None, datetime(2024, 1, 1, hour))
        spark.createDataFrame([row], S.TURN_SCHEMA).write.mode("append").parquet(path)
        S.ingest_memory(S.read_stream(spark, path), out, state).awaitTermination()
    assert sorted(r.created_at.hour for r in out.read().collect()) == [0, 1, 10, 20]


def test_running_stats_count_repeats_once(spark):
    path, turns = turn_files(spark, copies=2)
    out = M.memory_store(spark, scratch_path(spark, "out"))
    stats, state = scratch_path(spark, "stats"), scratch_path(spark, "state")
    S.ingest_memory(S.read_stream(spark, path, files_per_batch=1), out, state, stats=stats).awaitTermination()
    got = {tuple(r) for r in S.latest_stats(spark.read.parquet(stats)).collect()}
    assert got == {tuple(r) for r in M.memory_stats(M.memory_records(turns)).collect()}


def test_guard_equals_batch(spark):
    path, turns = turn_files(spark)
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    words = ["worthless"]
    S.guard_replies(S.read_stream(spark, path), "bot_response", out, state, words=words).awaitTermination()
    columns = ["turn_id", "toxic", "final_text"]
    got = sorted(map(tuple, spark.read.parquet(out).select(columns).collect()))
    assert got == sorted(map(tuple, safety.guard(turns, "bot_response", words=words).select(columns).collect()))
    assert sum(r[1] for r in got) == 5


def test_requests_parse_on_a_stream(spark):
    path, out, state = (scratch_path(spark, n) for n in ("bodies", "out", "state"))
    bodies = [json.dumps({"message": "hi"}), "nothing", json.dumps({"message": " "})]
    spark.createDataFrame([(b,) for b in bodies], "body string").write.parquet(path)
    stream = R.accepted(R.parse_requests(spark.readStream.schema("body string").parquet(path)))
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()
    assert [r.message for r in spark.read.parquet(out).collect()] == ["hi"]


def test_retrieval_sees_only_own_memory(spark):
    path, turns = turn_files(spark)
    memory = M.memory_records(turns)
    collection = memory.select("id", "embedding")
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    S.retrieve_for_turns(S.read_stream(spark, path), lambda: memory, lambda: collection, out, state, 3, 2).awaitTermination()
    hits = spark.read.parquet(out)
    assert hits.groupBy("query_id", "source").count().filter("count > 3").isEmpty()
    asked = memory.filter(F.col("type") == C.TURN).select(F.col("id").alias("query_id"), "user_id", "created_at")
    known = memory.select("id", F.col("user_id").alias("owner"), F.col("created_at").alias("saved_at"))
    own = hits.filter("source = 'memory'").join(asked, "query_id").join(known, "id")
    assert own.count() == hits.filter("source = 'memory'").count() > 0
    assert own.filter("user_id <> owner OR saved_at >= created_at").isEmpty()
    assert hits.filter("source = 'context'").count() == 40


def test_twenty_batches_leave_a_bounded_number_of_versions(spark):
    path, state = scratch_path(spark, "many"), scratch_path(spark, "state")
    rows = [(f"t{i}", f"u{i % 3}", "c", f"hello {i}", None, None, datetime(2024, 1, 1, 0, i)) for i in range(20)]
    turns = spark.createDataFrame(rows, S.TURN_SCHEMA)
    turns.repartition(20, "turn_id").write.option("maxRecordsPerFile", 1).parquet(path)
    store = M.memory_store(spark, scratch_path(spark, "out"), buckets=2)
    S.ingest_memory(S.read_stream(spark, path, files_per_batch=1), store, state, merge_over=4).awaitTermination()
    listing = store.listing()
    assert listing.done[state][0] >= 19 and len(listing.live) <= 5
    assert store.read().count() == M.memory_records(turns).count()


def test_guard_query_reads_a_table_of_several_files(spark):
    """The documents may be one file or a folder of files."""
    from hearth.plans.queries import QUERIES

    folder = scratch_path(spark, "tables")
    rows = [(1, "you clown", "en"), (2, "all is well", "en"), (3, None, None), (3, "all is well", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(f"{folder}/labels.parquet")
    got = sorted(map(str, (tuple(r) for r in QUERIES["stream_guard"](spark, folder).collect())))
    assert got == sorted(map(str, [(1, True, C.REFUSAL), (2, False, "all is well"), (3, False, None), (3, False, "all is well")]))
