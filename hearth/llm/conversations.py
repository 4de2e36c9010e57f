"""Conversation structure repair by Wagner-Fischer target alignment.

A well-formed conversation alternates: an optional system turn, then pairs of a
user and an assistant turn, or nothing at all. The turns of a conversation are
aligned to the alternating target string of every feasible length; edits are
Keep (0), Rerole to user or assistant (2), Delete (3, required for a blank or
duplicate turn) and Insert of an empty user or assistant turn (2), and a
truncated turn that is not deleted adds 1. All targets end alike, so one matrix
over the suffixes serves every length. Its cells lie in the Ukkonen band that
the cost of a greedy repair, the incumbent, leaves possible. Of all lengths of
least cost the audits are traced back and the least in ASCII order is taken.

Conversations are streamed in turn order through sorted partitions. A
conversation is aligned segment by segment of ``SEGMENT`` turns, for every state
of the grammar at the segment's ends; the states' best audits so far are
extended by the segment's, which is exact, since audits of equal cost over the
same turns are never prefixes of each other. A task holds one segment, the
audits and one running digest per state, however long a conversation is.

Rows are ordered by turn, nulls first, then role, then text. A null role or text
stands for one space; a null conversation id is a conversation of its own. Of
repeated rows all but the first are duplicates. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.llm.common import bound_batches

SEGMENT = 256
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
FAR = 1 << 30

# what was put out so far: nothing, a system turn, an odd turn that wants a reply, whole pairs
NOTHING, SYSTEM, WAITING, PAIRS = range(4)
STATES = (NOTHING, SYSTEM, WAITING, PAIRS)

Turn = tuple[str, str, bool, int]  # role, text, must be deleted, cost of not deleting it


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults chosen by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes the marks ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", space)
    changed = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", space))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).when(kind == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), copies.alias("copies")).select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def _own(rows: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def _digest() -> Column:
    return F.sha2(F.concat(F.col("role"), F.lit("\0"), F.col("text")).cast("binary"), 256)


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in conversation order; ``again`` marks a role and text that an earlier turn number has."""
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    keyed = rows.withColumn("digest", _digest())
    # only contents that occur again travel back, so a text that a hot conversation repeats is one row here
    seen = keyed.groupBy("conv_id", "digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = seen.select(F.col("conv_id").alias("seen_id"), F.col("digest").alias("seen_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("seen_id")) & (F.col("digest") == F.col("seen_digest"))
    marked = keyed.join(seen, same, "left").withColumn("again", F.coalesce(F.col("first") < at, F.lit(False)))
    found = marked.select("conv_id", "turn", "role", "text", "again").repartition("conv_id")
    return found.sortWithinPartitions("conv_id", "turn", "role", "text")


def suffix_costs(turns: list[Turn], last: str, limit: int) -> np.ndarray:
    """Cost of aligning the last i turns to the last j roles of the alternating string that ends with ``last``.

    Cells that no alignment within ``limit`` passes are FAR.
    """
    n = len(turns)
    width = n + limit // INSERT + 1
    roles = np.array(["ua"[(p + (last == "a")) % 2] for p in range(width)])
    steps = np.arange(width + 1)
    table = np.full((n + 1, width + 1), FAR, np.int64)
    table[0] = np.where(steps * INSERT <= limit, steps * INSERT, FAR)
    for i in range(1, n + 1):
        role, _, drop, extra = turns[n - i]
        low, high = max(0, i - limit // DELETE), min(width, i + limit // INSERT)
        above = table[i - 1, low : high + 1]
        row = above + DELETE
        if not drop:
            change = np.where(roles == role[:1], 0, REROLE)
            start = max(low, 1)
            np.minimum(row[start - low :], table[i - 1, start - 1 : high] + change[start - 1 : high] + extra, out=row[start - low :])
        # an insert follows from the cell to the left: a running minimum
        slope = INSERT * steps[: high - low + 1]
        row = np.minimum.accumulate(row - slope) + slope
        table[i, low : high + 1] = np.where(row <= limit, row, FAR)
    return table


def trace(table: list[list[int]], turns: list[Turn], last: str, i: int, j: int) -> str:
    """The ASCII-least audit of the cell (i, j)."""
    n, audit = len(turns), []
    while i or j:
        cost = table[i][j]
        if i and table[i - 1][j] + DELETE == cost:
            audit.append("D")
            i -= 1
        elif j and table[i][j - 1] + INSERT == cost:
            audit.append("I")
            j -= 1
        else:
            role, _, _, extra = turns[n - i]
            wanted = "ua"[(j - 1 + (last == "a")) % 2]
            audit.append("K" if role[:1] == wanted else "R")
            i, j = i - 1, j - 1
    return "".join(audit)


def greedy_cost(turns: list[Turn], expected: str) -> int:
    """Cost of deleting what must go, rerolling what is out of place and inserting what the end lacks: no optimum is dearer."""
    cost = INSERT * 2
    for role, _, drop, extra in turns:
        if drop:
            cost += DELETE
        else:
            cost += extra + (REROLE if role[:1] != expected else 0)
            expected = "a" if expected == "u" else "u"
    return cost


def align(turns: list[Turn], starts: set[int]) -> dict[tuple[int, int], tuple[int, str]]:
    """Least cost and ASCII-least audit of a segment for every pair of states it can lead from and to."""
    n = len(turns)
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(start: int, end: int, cost: int, audit: str) -> None:
        if (start, end) not in best or (cost, audit) < best[start, end]:
            best[start, end] = (cost, audit)

    for state in starts:
        offer(state, state, DELETE * n, "D" * n)
    # system turns that may open the conversation: all before them go
    heads = [(r, DELETE * r + t[3]) for r, t in enumerate(turns) if t[0][:1] == "s" and not t[2]] if NOTHING in starts else []
    for r, cost in heads:
        offer(NOTHING, SYSTEM, cost + DELETE * (n - r - 1), "D" * r + "K" + "D" * (n - r - 1))
    wanted = {state: "a" if state == WAITING else "u" for state in starts}
    limit = max(greedy_cost(turns, first) for first in set(wanted.values()))
    for last, end in (("u", WAITING), ("a", PAIRS)):
        table = suffix_costs(turns, last, limit).tolist()
        for first in set(wanted.values()):
            lengths = range(1 if first == last else 2, len(table[n]), 2)
            found = _least([(table[n][j], n, j, "") for j in lengths], table, turns, last)
            for state in (s for s in starts if wanted[s] == first):
                offer(state, end, *found)
        if heads:
            lengths = range(1 if last == "u" else 2, len(table[n]), 2)
            offer(NOTHING, end, *_least([(cost + table[n - r - 1][j], n - r - 1, j, "D" * r + "K") for r, cost in heads for j in lengths], table, turns, last))
    return best


def _least(options: list[tuple[int, int, int, str]], table: list[list[int]], turns: list[Turn], last: str) -> tuple[int, str]:
    """Least cost of (cost, i, j, audit before) and the least audit of that cost; FAR costs have none."""
    cost = min(o[0] for o in options)
    if cost >= FAR:
        return cost, "~"
    return cost, min(before + trace(table, turns, last, i, j) for c, i, j, before in options if c == cost)


class _Digest:
    """SHA-256 of the repaired turns so far."""

    def __init__(self):
        self.state, self.empty = hashlib.sha256(), True

    def copy(self) -> "_Digest":
        other = _Digest.__new__(_Digest)
        other.state, other.empty = self.state.copy(), self.empty
        return other

    def add(self, role: str, text: str) -> None:
        self.state.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False


def _extend(digest: _Digest, turns: list[Turn], audit: str, state: int) -> _Digest:
    """The digest after a segment."""
    digest = digest.copy()
    at = 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        role, text = (turns[at][0], turns[at][1]) if letter != "I" else ("", "")
        if letter == "K" and state == NOTHING and role[:1] == "s":
            state = SYSTEM
        else:
            wanted = "a" if state == WAITING else "u"
            state = PAIRS if wanted == "a" else WAITING
            role = role if letter == "K" else NAMES[wanted]
        digest.add(role, text)
        at += letter != "I"
    return digest


class Conversation:
    """Counts and best repairs of one conversation, fed turn by turn."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.before = None
        self.held: list[Turn] = []
        self.best: dict[int, tuple[int, str, _Digest]] = {NOTHING: (0, "", _Digest())}

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        here = (turn, role, text)
        again = again or here == self.before
        if turn is not None:
            self.distinct += self.before is None or self.before[0] != turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in LEGAL
        self.before = here
        words = text.rstrip(SPACES)
        blank = not words
        duplicate = again and not blank
        truncated = not blank and not duplicate and words[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.held.append((role, text, blank or duplicate, TRUNCATED if truncated else 0))
        if len(self.held) == SEGMENT:
            self.settle()

    def settle(self) -> None:
        """Extend the best repairs by the turns held."""
        turns, self.held = self.held, []
        chosen: dict[int, tuple[int, str, int, str]] = {}
        for (start, end), (cost, audit) in align(turns, set(self.best)).items():
            total, before, _ = self.best[start]
            if cost < FAR and (end not in chosen or (total + cost, before + audit) < chosen[end][:2]):
                chosen[end] = (total + cost, before + audit, start, audit)
        self.best = {end: (cost, whole, _extend(self.best[start][2], turns, audit, start)) for end, (cost, whole, start, audit) in chosen.items()}

    def result(self) -> tuple:
        if self.held:
            self.settle()
        cost, audit, digest = min((self.best[s] for s in (NOTHING, PAIRS) if s in self.best), key=lambda b: b[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.state.hexdigest()


FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): faults, cost, audit and digest of the repaired turns."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *[f.split()[0] for f in FIELDS.split(", ")]]
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, current, id_type, done = None, None, None, []

        def flush() -> pa.RecordBatch:
            columns = [pa.array([d[0] for d in done], id_type), *[pa.array([d[1][i] for d in done], t) for i, t in enumerate(types)]]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for own, turn, role, text, again in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if current is None or own != key:
                    if current is not None:
                        done.append((key, current.result()))
                    key, current = own, Conversation()
                current.add(turn, role, text, again)
            if done:
                yield flush()
        if current is not None:
            done.append((key, current.result()))
            yield flush()

    bound_batches(rows.sparkSession)
    return _ordered(_own(rows)).mapInArrow(run, f"conv_id {kind}, {FIELDS}")


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the turns of every repaired conversation, inserted ones with a null turn."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, audit in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                letters = np.frombuffer(audit.encode(), np.uint8)
                keep = letters != ord("D")
                row = np.cumsum(letters != ord("I"))
                row = np.where(letters == ord("I"), -1, row)[keep]
                columns = [pa.array([own.as_py()] * len(row), own.type), pa.array(np.arange(len(row))), pa.array(row), pa.array([chr(x) for x in letters[keep]], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["own_id", "place", "row", "edit"])

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = _own(rows).withColumn("number", F.row_number().over(order))
    wanted = repairs.select("conv_id", "audit").mapInArrow(edits, f"own_id {kind}, place long, row long, edit string")
    joined = wanted.join(numbered, wanted.own_id.eqNullSafe(numbered.conv_id) & (F.col("row") == F.col("number")), "left")
    opens = joined.where("place = 0 and edit = 'K' and left(role, 1) = 's'").select(F.col("own_id").alias("system_id"), F.lit(1).alias("shift"))
    joined = joined.join(opens, joined.own_id.eqNullSafe(opens.system_id), "left")
    first = (F.col("place") - F.coalesce("shift", F.lit(0))) % 2 == 0
    role = F.when(F.col("edit") == "K", F.col("role")).when(first, "user").otherwise("assistant")
    return joined.select(F.col("own_id").alias("conv_id"), "place", "edit", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
