"""Substring dedup against a direct count of word windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

from hearth.llm import substrings
from hearth.llm.queries import QUERIES


def brute(rows, window):
    split = [(r, (t or "").encode().split()) for r, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for r, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((r, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def corpus(window, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    shared = [" ".join(rng.choices(vocabulary, k=window + rng.randrange(-1, 12))) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))]
        if i % 3 == 0:
            parts.append(rng.choice(shared))
        if i % 10 == 0:
            parts *= 2
        rows.append((i, "\n".join(parts), None, None, None))
    return rows + rows[:20] + [(900, None, None, None, None), (901, "same " * (window + 1), None, None, None), (None, "x y", None, None, None)]


def test_removes_exactly_the_repeated_windows(documents):
    for window in (1, 2, 7, 35):
        rows = corpus(window)
        got = substrings.dedup_substrings(documents(rows), window).select("doc_id", "n_words", "n_removed", "text")
        assert sorted(map(tuple, got.collect()), key=str) == brute([(r[0], r[1]) for r in rows], window)


def test_query_digest(documents, saved, spark):
    rows = corpus(35, 5)
    got = QUERIES["op5_substring_dedup"](spark, saved(documents=documents(rows))).collect()
    want = [(r, n, g, hashlib.sha256(t.encode()).hexdigest()) for r, n, g, t in brute([(r[0], r[1]) for r in rows], 35)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_awkward_rows_and_clashing_names(documents):
    docs = documents(clash=("n_words", "__bundle", "bundle", "shard", "phase"))
    got = substrings.dedup_substrings(docs, 5, keep_space=True).collect()
    assert len(got) == docs.count()
    assert [r.text for r in got if r.doc_id == 3] == [None]
    assert [r.text for r in got if r.doc_id == 2] == ["", ""]
    assert [r.n_removed for r in got if r.doc_id == 8] == [30000]
    assert substrings.dedup_substrings(documents([])).count() == 0


def test_packing_of_requests():
    import numpy as np

    low = np.array([0, 5, 5, 2**63, 2**64 - 1], dtype=np.uint64)
    twice = np.array([True, False, True, False, True])
    a, b, c = substrings._unpack(substrings._pack(low, twice, low[::-1]))
    assert (a == low).all() and (b == twice).all() and (c == low[::-1]).all()
