from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearth import constants as C
from hearth.operators import memory as M
from hearth.operators import ordering as O
from hearth.session import scratch_path

T0 = datetime(2024, 1, 1)
TURNS = "user_id string, conversation_id string, user_message string, bot_response string, emotion string, created_at timestamp"


def turns(spark, rows):
    full = [(u, c, m, b, e, datetime(2024, 1, 1, 0, i)) for i, (u, c, m, b, e) in enumerate(rows)]
    return spark.createDataFrame(full, TURNS)


def test_turn_records(spark):
    rows = M.turn_records(turns(spark, [("u", None, "hi", None, None), ("u", "c", "x" * 1200, "y", "sad"), ("u", "", " \xa0", "y", "")]))
    first, second = rows.orderBy("created_at").collect()
    assert (first.document, first.conversation_id, first.emotion, first.bot_response) == ("User said: hi", "unknown", "unknown", "")
    assert first.id == "u_20240101000000000000" and first.type == C.TURN
    assert second.document == "User said: " + "x" * 1200 + "\nAssistant responded: y"
    assert len(second.user_message) == 1000 and len(second.embedding) == 64


def test_one_pass_equals_two(spark):
    t = turns(spark, [("u", "c", "My name is Ann. I can swim", "ok", "sad"), ("v", "c", "hello", None, None)])
    both = M.memory_records(t)
    apart = M.turn_records(t).unionByName(M.extracted_fact_records(t))
    assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))
    assert both.filter(F.col("type") == C.FACT).count() == 2


def test_given_facts_and_upsert(spark):
    facts = spark.createDataFrame([("u", "likes tea", T0), ("u", "  ", T0), ("u", "likes tea", T0)], "user_id string, fact string, created_at timestamp")
    records = M.fact_records(facts)
    assert records.count() == 2
    stored = M.upsert(records.limit(0), records)
    assert stored.count() == 1 and M.upsert(stored, records).count() == 1


def test_stats_and_listing(spark):
    t = turns(spark, [("u", "c", f"message {i} " + "z" * 60, "ok", None) for i in range(5)] + [("v", "c", "I can swim", None, None)])
    memory = M.memory_records(t)
    users = spark.createDataFrame([("u",), ("v",), ("w",)], "user_id string")
    stats = {r.user_id: (r.total, r.conversations, r.facts) for r in M.memory_stats(memory, users).collect()}
    assert stats == {"u": (5, 5, 0), "v": (2, 1, 1), "w": (0, 0, 0)}
    lines = M.memory_listing(memory, 3).filter("user_id = 'u'").orderBy("rank").collect()
    assert [r.rank for r in lines] == [1, 2, 3]
    assert lines[0].line == C.TURN_ICON + ("message 4 " + "z" * 60)[:50] + "..."
    fact = M.memory_listing(memory).filter("user_id = 'v'").filter(F.col("type") == C.FACT).first()
    assert fact.line == C.FACT_ICON + "User knows swim"


def hits(spark, facts, turns):
    rows = [("q", i + 1, f"f{i}", f"fact {i}", C.FACT, None, None) for i in range(facts)]
    rows += [("q", facts + i + 1, f"t{i}", "doc", C.TURN, f"said {i}", f"reply {i}") for i in range(turns)]
    schema = "query_id string, rank int, id string, content string, type string, user_message string, bot_response string"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("facts, turns, kept", [(6, 9, (4, 4)), (1, 9, (1, 7)), (0, 9, (0, 8)), (2, 3, (2, 3))])
def test_prompt_quota(spark, facts, turns, kept):
    lines = M.memory_prompt_lines(hits(spark, facts, turns))
    by_type = {r["type"]: r["count"] for r in lines.groupBy("type").count().collect()}
    assert (by_type.get(C.FACT, 0), by_type.get(C.TURN, 0)) == kept
    slots = sorted(r.slot for r in lines.collect())
    assert slots == list(range(1, sum(kept) + 1))


def test_memory_block(spark):
    block = M.memory_block(hits(spark, 1, 1)).first()["memory_block"]
    assert block.split("\n") == [C.MEMORY_HEADER, "- fact 0", '- Previously you said: "said 0"', '  I responded: "reply 0"']
    silent = hits(spark, 0, 1).withColumn("user_message", F.lit(""))
    assert M.memory_block(silent).first()["memory_block"] == C.MEMORY_HEADER
    assert M.memory_block(hits(spark, 0, 0).filter("false")).count() == 0
    long = hits(spark, 0, 1).withColumn("user_message", F.lit("a" * 101)).withColumn("bot_response", F.lit("b" * 81))
    assert M.memory_block(long).first()["memory_block"].endswith("a" * 100 + '..."\n  I responded: "' + "b" * 80 + '..."')


def test_memory_block_groups_once(spark):
    plan = M.memory_block(hits(spark, 3, 3).repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(query_id") == 1 and "Join" not in plan


def test_small_quota(spark):
    assert M.memory_prompt_lines(hits(spark, 3, 3), max_items=2, max_facts=3).filter(F.col("type") == C.TURN).isEmpty()


def test_retrieve_only_own_memories(spark):
    t = turns(spark, [("u", "c", f"tea number {i}", None, None) for i in range(4)] + [("v", "c", "tea number 0", None, None)])
    memory = M.turn_records(t)
    queries = memory.select(F.col("id").alias("query_id"), "user_id", "embedding")
    found = M.retrieve_memories(queries, memory, 2, skip_self=True)
    assert found.filter(F.split("query_id", "_")[0] != F.split("id", "_")[0]).isEmpty()
    assert found.groupBy("query_id").count().filter("count > 2").isEmpty()
    assert found.filter("query_id = id").isEmpty()


def test_clear_users(spark):
    memory = M.turn_records(turns(spark, [("u", "c", "one", None, None), ("v", "c", "two", None, None), ("u", "c", "three", None, None)]))
    assert M.clear_users(memory, spark.createDataFrame([("u",)], "user_id string")).count() == 1
    until = spark.createDataFrame([("u", datetime(2024, 1, 1, 0, 1))], "user_id string, cleared_at timestamp")
    assert sorted(r.document for r in M.clear_users(memory, until).collect()) == ["User said: three", "User said: two"]


def test_written_memory(spark):
    path = scratch_path(spark, "memory-test")
    records = M.turn_records(turns(spark, [(f"user{i % 9}", "c", f"message {i}", None, None) for i in range(27)]))
    M.write_memory(records, path, buckets=6)
    stored = spark.read.parquet(path)
    one = M.read_user(stored, "user3", buckets=6)
    assert one.count() == 3
    scan = [x for x in one._jdf.queryExecution().toString().split("\n") if "PartitionFilters" in x]
    assert "user_bucket" in scan[-1].split("PartitionFilters")[1].split("]")[0]


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_turn_pairs_in_stretches(spark, span):
    rows = [(1, i * 2, "user" if i % 3 else "assistant", f"t{i}") for i in range(12)] + [(2, 0, "user", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.next for r in O.with_next(df, "conv_id", "turn", ["text"], "next", span).collect()}
    for i in range(12):
        following = got[(1, i * 2)]
        assert (following.text if following else None) == (f"t{i + 1}" if i < 11 else None)
    assert got[(2, 0)] is None
    paired = {r.turn: r.bot_response for r in M.pair_turns(df).filter("conv_id = 1").collect()}
    assert paired[4] == "t3" and paired[2] is None


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7 + 3).alias("key")).repartition(7)
    got = O.with_dense_index(df, "key").orderBy("key").collect()
    assert [r["index"] for r in got] == list(range(1000))


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_dense_index_of_repeated_and_missing_keys(spark, ranges):
    rows = [(f"k{i % 37:02d}", i) for i in range(300)] + [(None, 300), (None, 301)] + [("k05", i) for i in range(400, 700)]
    df = spark.createDataFrame(rows, "key string, n int").repartition(5)
    got = O.with_dense_index(df, "key", ranges=ranges).orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(len(rows)))
    assert [r.key for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    assert sorted(r.n for r in got) == sorted(n for _, n in rows)
    assert O.with_dense_index(df.limit(0), "key", ranges=ranges).count() == 0


def test_dense_index_shuffles_texts_once_and_writes_nothing(spark, tmp_path):
    spark.range(500).select("id", F.repeat(F.lit("x"), 50).alias("text")).write.parquet(f"{tmp_path}/t")
    made = O.with_dense_index(spark.read.parquet(f"{tmp_path}/t"), "id")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and f"{tmp_path}/t" in plan
    assert made.inputFiles()[0].startswith(f"file://{tmp_path}/t") or f"{tmp_path}/t" in made.inputFiles()[0]


def test_preview(spark):
    df = spark.createDataFrame([("u", i, f"l{i}") for i in range(25)] + [("v", 1, "x")], "user_id string, o int, line string")
    got = {r.user_id: r for r in O.preview_with_overflow(df, "user_id", [F.col("o")], "line", 20).collect()}
    assert got["u"].overflow == "...and 5 more" and got["u"].shown.split("\n") == [f"l{i}" for i in range(20)]
    assert (got["v"].hidden, got["v"].overflow) == (0, "")


def test_conversation_summary(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u" * 40), (2, 0, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in M.conversation_summary(df).collect()]
    assert got == [(2, "New chat", 1), (1, "u" * 30 + "...", 2)]
