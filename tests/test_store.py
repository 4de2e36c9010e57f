from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearth.operators import memory as M
from hearth.operators.store import KeyedStore, vacuum
from hearth.session import scratch_path


def records(spark, rows):
    return spark.createDataFrame(rows, "id string, user_id string, n long, metadata map<string,string>")


def store_at(spark, buckets=8):
    return KeyedStore(spark, scratch_path(spark, "store"), bucket_by="user_id", buckets=buckets)


def rows_of(store):
    return sorted((r.id, r.user_id, r.n, r.metadata.get("w") if r.metadata else None) for r in store.read().collect())


def test_existing_id_wins_and_counts_are_exact(spark):
    store = store_at(spark)
    with pytest.raises(ValueError):
        store.read()
    first = store.append(records(spark, [("a", "u", 1, {"w": "1"}), ("b", "v", 2, None), ("a", "u", 0, {"w": "0"})]), odd=F.count_if(F.col("n") % 2 == 1))
    assert (first.offered, first.saved, first.skipped, first.counts) == (3, 2, 1, {"odd": 0})
    again = store.append(records(spark, [("a", "u", 9, {"w": "9"}), ("c", "w", 3, {})]), odd=F.count_if(F.col("n") % 2 == 1))
    assert (again.offered, again.saved, again.skipped, again.counts) == (2, 1, 1, {"odd": 1})
    nothing = store.append(records(spark, [("c", "w", 4, {})]))
    assert (nothing.saved, nothing.skipped) == (0, 1)
    assert store.append(records(spark, [])).offered == 0
    assert rows_of(store) == [("a", "u", 0, "0"), ("b", "v", 2, None), ("c", "w", 3, None)]
    assert [r.id for r in store.saved_in(again.version).collect()] == ["c"]
    assert store.saved_in(nothing.version).count() == 0
    with pytest.raises(ValueError):
        store.append(spark.range(1).selectExpr("'x' AS id", "'u' AS user_id"))


def test_empty_first_append(spark):
    store = store_at(spark)
    store.append(records(spark, []))
    assert store.read().count() == 0
    assert store.append(records(spark, [("a", None, 1, None)])).saved == 1
    assert rows_of(store) == [("a", None, 1, None)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_touched_buckets_are_scanned(spark):
    store = store_at(spark)
    store.append(records(spark, [(f"i{n}", f"u{n}", n, None) for n in range(40)]))
    asked = spark.createDataFrame([("u3",), ("u5",), ("absent",)], "user_id string")
    found = store.of(asked)
    assert sorted(r.id for r in found.collect()) == ["i3", "i5"]
    assert "dynamicpruning" in plan_of(found).lower()
    one = store.of_one("u7")
    assert [r.id for r in one.collect()] == ["i7"]
    filters = [x for x in plan_of(one).split("\n") if "PartitionFilters" in x][-1]
    assert "bucket" in filters.split("PartitionFilters")[1].split("]")[0]


def test_delete_survives_a_run_that_breaks_off(spark, monkeypatch):
    store = store_at(spark, buckets=4)
    store.append(records(spark, [(f"i{n}", f"u{n % 10}", n, None) for n in range(40)]))
    before = rows_of(store)
    names = spark.createDataFrame([("u1",), ("u2",)], "user_id string")

    def breaks(state):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(store, "_commit", breaks)
        with pytest.raises(RuntimeError):
            store.delete(names)
    # between the steps: the files are there, the table is as it was
    assert rows_of(store) == before
    assert vacuum(store) == [2]
    store.delete(names)
    left = [r for r in before if r[1] not in ("u1", "u2")]
    assert rows_of(store) == left
    store.delete(names)
    assert rows_of(store) == left
    # the deleted user may come back
    assert store.append(records(spark, [("i1", "u1", 5, None)])).saved == 1
    assert ("i1", "u1", 5, None) in rows_of(store)
    store.delete(spark.createDataFrame([(f"u{n}",) for n in range(10)], "user_id string"))
    assert rows_of(store) == []


def test_an_overtaken_writer_fails(spark):
    store = store_at(spark)
    store.append(records(spark, [("a", "u", 1, None)]))
    state = store.listing()
    store.append(records(spark, [("b", "u", 1, None)]))
    state.number += 1
    with pytest.raises(Exception, match="exists"):
        store._commit(state)
    assert len(rows_of(store)) == 2


def test_merged_versions_hold_the_same_rows(spark):
    store = store_at(spark, buckets=2)
    for n in range(7):
        store.append(records(spark, [(f"i{n}", f"u{n % 3}", n, None), ("i0", "u0", 99, None)]), txn=("batch", n))
        if n == 3:
            store.delete(spark.createDataFrame([("u1",)], "user_id string"))
    before = rows_of(store)
    assert [r[0] for r in before] == ["i0", "i2", "i3", "i5", "i6"] or [r[0] for r in before] == ["i0", "i2", "i3", "i4", "i5", "i6"]
    assert store.merge(most=4) and len(store.listing().live) <= 4
    assert rows_of(store) == before
    assert not store.merge(most=4)
    assert vacuum(store) and rows_of(store) == before
    # a transaction that was committed is not repeated
    assert store.append(records(spark, [("new", "u", 1, None)]), txn=("batch", 6)).saved == 0
    assert store.append(records(spark, [("new", "u", 1, None)]), txn=("batch", 7)).saved == 1


def test_memory_is_saved_once_and_counted_per_user(spark):
    rows = [(f"u{i % 2}", "c", "I can swim" if i % 2 else f"hello {i}", "fine", None, datetime(2024, 1, 1, 0, i)) for i in range(6)]
    turns = spark.createDataFrame(rows, "user_id string, conversation_id string, user_message string, bot_response string, emotion string, created_at timestamp")
    store = M.memory_store(spark, scratch_path(spark, "memory"))
    saved = M.save_memory(store, M.memory_records(turns))
    assert (saved.saved, saved.counts) == (9, {"turns": 6, "facts": 3})
    assert {tuple(r) for r in M.saved_per_user(store, saved.version).collect()} == {("u0", 3, 0), ("u1", 3, 3)}
    again = M.save_memory(store, M.memory_records(turns))
    assert (again.saved, again.skipped, again.counts) == (0, 9, {"turns": 0, "facts": 0})
    assert M.saved_per_user(store, again.version).count() == 0
