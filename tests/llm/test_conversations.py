"""Conversation repair against exhaustive search, and on awkward rows."""

import hashlib
import heapq
import random

import pytest

from hearth.llm import conversations
from hearth.llm.queries import op13_conversation_repair

ROLES = ["user", "assistant", "system", "user", "assistant", "tool", ""]
TEXTS = ["a.", "b.", "c!", "d", "", "e?", "f", " \t"]
EMPTY = hashlib.sha256(b"").hexdigest()


def exhaustive(turns):
    """Least (cost, audit) by uniform-cost search over all edit sequences."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in (0, 3):
            return cost, audit
        wanted, after = ("a", 3) if state == 2 else ("u", 2)
        heapq.heappush(heap, (cost + 2, audit + "I", i, after))
        if i < len(turns):
            role, _, drop, extra = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if not drop:
                kept = role[:1] == wanted
                heapq.heappush(heap, (cost + extra + 2 * (not kept), audit + ("K" if kept else "R"), i + 1, after))
                if state == 0 and role[:1] == "s":
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, 1))


@pytest.mark.parametrize("segment", [256, 5, 2, 1])
def test_equals_exhaustive_search(monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    pick = random.Random(segment)
    for _ in range(250):
        rows = [(i, pick.choice(ROLES), pick.choice(TEXTS)) for i in range(pick.randint(0, 9))]
        conversation, seen, turns = conversations.Conversation(), set(), []
        for turn, role, text in rows:
            again = (role, text) in seen
            seen.add((role, text))
            conversation.add(turn, role, text, again)
            blank = not text.strip()
            turns.append((role, text, blank or again, int(not blank and not again and text[-1] not in ".!?")))
        assert conversation.result()[5:7] == exhaustive(turns)


def test_long_conversation_in_segments():
    conversation, turns = conversations.Conversation(), []
    pick = random.Random(7)
    for i in range(700):
        role, text = pick.choice(["user", "assistant"]), f"{i}."
        conversation.add(i, role, text, False)
        turns.append((role, text, False, 0))
    assert conversation.result()[5:7] == exhaustive(turns)


AWKWARD = [
    (1, 0, "system", "be kind."), (1, 1, "user", "hello?"), (1, 2, "assistant", "yes."),
    (2, 0, "user", "hello?"), (2, 0, "user", "hello?"), (2, 5, "assistant", "cut of"),
    (3, None, None, None), (3, 2, "user", " \t\n"), (3, 2, "", "x."),
    (None, 1, "user", "no id."), (None, 2, "assistant", "none."),
    (4, 1, "assistant", "long " * 40000 + "."), (4, 1, "assistant", "été \x1c 中."),
    (5, None, "user", "first."), (5, 3, "user", "first."), (5, 4, "assistant", "second"),
]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def test_awkward_rows(spark):
    found = {r["conv_id"]: r for r in conversations.repair(rows_of(spark, AWKWARD)).collect()}
    assert set(found) == {1, 2, 3, 4, 5, None}
    assert found[1]["audit"] == "KKK" and found[1]["cost"] == 0
    assert found[1]["repaired_sha256"] == hashlib.sha256(b"system:be kind.\nuser:hello?\nassistant:yes.").hexdigest()
    assert (found[2]["duplicate"], found[2]["truncated"], found[2]["gaps"], found[2]["audit"], found[2]["cost"]) == (1, 1, 4, "KDK", 4)
    assert (found[3]["blank"], found[3]["gaps"], found[3]["cost"], found[3]["audit"]) == (2, 0, 9, "DDD")
    assert found[3]["repaired_sha256"] == EMPTY
    assert found[None]["audit"] == "KK"
    assert found[4]["illegal"] == 1
    # a null turn comes first, so the repeat is the later one
    assert (found[5]["duplicate"], found[5]["audit"]) == (1, "KDK")


def test_repaired_turns_make_the_digest(spark):
    rows = rows_of(spark, AWKWARD)
    repairs = conversations.repair(rows)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in repairs.collect()}
    texts = {}
    for r in sorted(conversations.repaired_turns(rows, repairs).collect(), key=lambda r: r["place"]):
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv_id, digest in digests.items():
        assert hashlib.sha256("\n".join(texts.get(conv_id, [])).encode()).hexdigest() == digest


def test_empty_table_and_clashing_columns(spark, saved):
    clash = rows_of(spark, AWKWARD).selectExpr("*", "'x' AS audit", "1 AS cost", "'y' AS own_id", "0 AS digest", "0 AS first", "0 AS copies")
    folder = saved(conversations=clash)
    assert op13_conversation_repair(spark, folder).count() == 6
    empty = saved(conversations=clash.limit(0))
    assert op13_conversation_repair(spark, empty).count() == 0


def test_every_row_dropped(spark, saved):
    from zlib import crc32

    dropped = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 == 0)
    folder = saved(conversations=rows_of(spark, [(dropped, 0, "user", "hello.")]))
    row = op13_conversation_repair(spark, folder).first()
    assert row.asDict() == {"conv_id": dropped, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": EMPTY}
