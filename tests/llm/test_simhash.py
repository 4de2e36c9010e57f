"""SimHash fingerprints, links and classes against direct computation."""

from __future__ import annotations

import random

import numpy as np
import xxhash

from hearth.llm import simhash
from hearth.llm.components import connected_components
from hearth.llm.queries import QUERIES


def slow_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(fps, ids, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprint_and_hash_equal_spark(spark):
    texts = ["", "one", "One two", "a b c", "x y z w x y z w", "été ÉTÉ b c d e"]
    assert [int(simhash.fingerprint(t.encode(), 3)[0]) for t in texts] == [slow_fingerprint(t) for t in texts]
    got = spark.sql("SELECT xxhash64('one two three') AS h").first().h
    assert got % 2**64 == int(simhash.fingerprint(b"ONE two three", 3)[0])


def test_near_pairs_finds_all():
    rng = np.random.default_rng(1)
    for radius in (1, 3, 6):
        base = rng.integers(0, 2**64, 40, dtype=np.uint64)
        fps = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(4)] + [base])
        for sizes in ([200], [70, 1, 64, 65]):
            got = {(int(x), int(y)) for a, b in simhash.near_pairs(fps[:, None], np.array(sizes), radius) for x, y in zip(a, b, strict=True)}
            run = np.repeat(np.arange(len(sizes)), sizes)
            want = {(i, j) for i in range(200) for j in range(i + 1, 200) if run[i] == run[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
            assert got == want


def test_links_keep_all_classes(spark, monkeypatch):
    rng = random.Random(2)
    fps = []
    for _ in range(120):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            fps.append(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
    fps = sorted(set(fps)) + [0, 7]
    frame = spark.createDataFrame([(f.to_bytes(8, "little"), i) for i, f in enumerate(fps)], "fp binary, doc_id long")
    got = {bytes(r.fp): r.component_id for r in simhash.classes(frame, 3).collect()}
    assert [got[f.to_bytes(8, "little")] for f in fps] == slow_classes(fps, list(range(len(fps))), 3)


def test_large_buckets_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    fps = [(1 << i) for i in range(60)] + [0]
    frame = spark.createDataFrame([(f.to_bytes(8, "little"), i) for i, f in enumerate(fps)], "fp binary, doc_id long")
    assert {r.component_id for r in simhash.classes(frame, 3).collect()} == {0}


def test_query_against_brute_force(documents, saved, spark):
    from tests.llm.conftest import AWKWARD

    rng = random.Random(5)
    words = [f"v{i}" for i in range(300)]
    rows = [r for r in AWKWARD if r[0] is not None]
    for i in range(20):
        text = rng.choices(words, k=200)
        for j in range(3):
            text[rng.randrange(200)] = "changed"
            rows.append((100 + i * 3 + j, " ".join(text), None, None, None))
    got = QUERIES["op8_simhash"](spark, saved(documents=documents(rows))).collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, slow_classes(fps, [r[0] for r in rows], 3), strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_keep_one(documents):
    docs = documents(clash=("fp", "component_id", "a"))
    got = simhash.keep_one(docs).select("doc_id").collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 3, 6, 7, 8]
    assert simhash.keep_one(documents([])).count() == 0
    assert simhash.near_duplicates(documents([])).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (5, 6)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1050)}
