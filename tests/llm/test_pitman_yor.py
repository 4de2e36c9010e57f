"""The Pitman-Yor model against a plain version that seats one customer after the other in dictionaries."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hearth.llm import pitman_yor as P

TEXTS = [
    (1, "the cat saw the dog", True),
    (2, "The dog saw a cat and the cat ran", True),
    (3, "a dog and a cat and a dog", True),
    (4, "the cat saw the dog", True),
    (5, "the bird saw a cat qzx", False),
    (6, None, True),
    (7, "qqqq the dog", False),
    (8, "", False),
]


def seat_one(key, n, base, others, discount, salt):
    assert n <= 32
    tables = min(n, 1)
    for seated in range(1, n):
        fresh = (P.STRENGTH + discount * (others + tables)) * base
        draw = P._uniform(np.array([key], dtype=np.uint64), salt * 4096 + 2 * seated)[0]
        tables += bool(draw < fresh / (fresh + seated - discount * tables))
    return tables


def discount_of(counts):
    one, two = (sum(n == k for n in counts) for k in (1, 2))
    return min(0.95, max(0.05, (one + 0.5) / (one + 2 * two + 1)))


def spell_plainly(learnt):
    """The probabilities of bytes after contexts, a dictionary per sample."""
    order = P.ORDER
    customers = {order: Counter()}
    for word, n in learnt.items():
        padded = P.PAD * order + word + P.PAD
        for i in range(len(word) + 1):
            customers[order][padded[i : i + order + 1]] += n > 0
    tables = {order: {k: min(n, 1) for k, n in customers[order].items()}}
    for level in range(order - 1, -1, -1):
        customers[level] = Counter()
        for k, t in tables[level + 1].items():
            customers[level][k[1:]] += t
        tables[level] = {k: min(n, 1) for k, n in customers[level].items()}
    discounts = {level: discount_of(customers[level].values()) for level in customers}

    def predict():
        p, base, others = {}, {}, {}
        for level in range(order + 1):
            all_c, all_t = Counter(), Counter()
            for k in tables[level]:
                all_c[k[:-1]] += customers[level][k]
                all_t[k[:-1]] += tables[level][k]
            d = discounts[level]
            for k, t in tables[level].items():
                base[k] = p[k[1:]] if level else 1 / 256
                others[k] = all_t[k[:-1]] - t
                p[k] = (customers[level][k] - d * t + (P.STRENGTH + d * all_t[k[:-1]]) * base[k]) / (P.STRENGTH + all_c[k[:-1]])
        return p, base, others

    samples, (p, base, others) = [], predict()
    for sweep in range(P.BURN_IN + P.SAMPLES):
        for level in range(order, -1, -1):
            if level < order:
                customers[level] = Counter()
                for k, t in tables[level + 1].items():
                    customers[level][k[1:]] += t
            tables[level] = {
                k: seat_one(int.from_bytes(k, "big"), customers[level][k], base[k], others[k], discounts[level], sweep * (order + 1) + level)
                for k in tables[level]
            }
        p, base, others = predict()
        if sweep >= P.BURN_IN:
            samples.append(p)
    return samples


def score_plainly(texts):
    tokens = {key: [*(text or "").lower().encode().split(), P.END] for key, text, _ in texts}
    pairs = {key: list(zip([P.END, *own], own)) for key, own in tokens.items()}
    number = {w: i for i, w in enumerate(sorted({w for own in tokens.values() for w in own}, key=lambda w: (xxhash.xxh3_64_intdigest(w), w)))}
    asked = {p for own in pairs.values() for p in own}
    counts = Counter(p for key, _, learns in texts if learns for p in pairs[key])
    learnt = {w: sum(n for (_, v), n in counts.items() if v == w) for _, w in asked}
    opened = {w: sum(v == w for _, v in counts) for w in learnt}
    d_pair, d_up = discount_of(counts.values()), discount_of(opened.values())
    customers = Counter()
    for (u, _), n in counts.items():
        customers[u] += n
    found = []
    for s, p in enumerate(spell_plainly(learnt)):
        base = {}
        for w in learnt:
            padded = P.PAD * P.ORDER + w + P.PAD
            base[w] = math.prod(p[padded[i : i + P.ORDER + 1]] for i in range(len(w) + 1))
        up_c, up_t = dict(opened), {w: min(n, 1) for w, n in opened.items()}
        all_t = Counter(u for u, _ in counts)

        def above(w):
            return (up_c[w] - d_up * up_t[w] + (P.STRENGTH + d_up * sum_t) * base[w]) / (P.STRENGTH + sum_c)

        sum_c, sum_t = sum(up_c.values()), sum(up_t.values())
        for sweep in range(P.WORD_SWEEPS):
            salt = 1000 + 2 * (sweep * P.SAMPLES + s)
            tables = {}
            for u, w in asked:
                n = counts[u, w]
                key = (xxhash.xxh3_64_intdigest(w) + (number[u] + 1) * 0x9E3779B97F4A7C15) % 2**64
                tables[u, w] = seat_one(key, n, above(w), max(0, all_t[u] - min(n, 1)), d_pair, salt)
            served = Counter()
            for (_, w), t in tables.items():
                served[w] += t
            up_t = {w: seat_one(xxhash.xxh3_64_intdigest(w), served[w], base[w], max(0, sum_t - min(served[w], 1)), d_up, salt + 1) for w in learnt}
            up_c = {w: served[w] for w in learnt}
            all_t = Counter()
            for (u, _), t in tables.items():
                all_t[u] += t
            sum_c, sum_t = sum(up_c.values()), sum(up_t.values())
        found.append({(u, w): (counts[u, w] - d_pair * tables[u, w] + (P.STRENGTH + d_pair * all_t[u]) * above(w)) / (P.STRENGTH + customers[u]) for u, w in asked})
    return {key: sum(math.log10(sum(f[p] for f in found) / len(found)) for p in own) for key, own in pairs.items()}


@pytest.mark.parametrize("copies", [1, 2])
def test_scores_equal_a_plain_model(spark, copies):
    rows = [r for r in TEXTS for _ in range(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learns boolean").repartition(3)
    expected = score_plainly(rows)
    found = P.score(docs, F.col("learns")).collect()
    assert len(found) == len(rows)
    for row in found:
        assert math.isclose(row.score, expected[row.doc_id], rel_tol=1e-5), row


@pytest.mark.parametrize("split_at", [1, 3])
def test_frequent_words_may_lie_in_several_shards(spark, split_at):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, learns boolean").repartition(3)
    expected = score_plainly(TEXTS)
    found = P.score(docs, F.col("learns"), split_at=split_at).collect()
    assert len(found) == len(TEXTS)
    for row in found:
        assert math.isclose(row.score, expected[row.doc_id], rel_tol=1e-5), row


def test_the_word_before_counts_not_its_last_byte(spark):
    """Learnt after "lime" and not after "cube": words that end in the same byte are different contexts."""
    learnt = [(k, "a lime tart and a cube root", True) for k in range(20)]
    docs = spark.createDataFrame([*learnt, (100, "a lime tart", False), (101, "a cube tart", False)], "doc_id long, text string, learns boolean")
    score = {r.doc_id: r.score for r in P.score(docs, F.col("learns")).collect()}
    after_a = {r.doc_id: r.score for r in P.score(docs.where("doc_id < 100").union(spark.createDataFrame([(100, "a lime", False), (101, "a cube", False)], docs.schema)), F.col("learns")).collect()}
    assert (score[100] - after_a[100]) - (score[101] - after_a[101]) > 1  # of tart and the end after it


def test_unknown_words_are_spelled(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(40_000))
    asked = [(10, "the dog", False), (11, "the qzx", False), (12, f"the {long}", False), (13, "the catdog", False)]
    docs = spark.createDataFrame([*TEXTS, *asked], "doc_id long, text string, learns boolean")
    score = {r.doc_id: r.score for r in P.score(docs, F.col("learns")).collect()}
    assert all(map(math.isfinite, score.values()))
    assert score[10] > score[13] > score[11] > score[12]
    assert score[12] < -10_000  # a float could not hold the probability of its spelling


def test_every_context_is_a_distribution(spark):
    """Known words in every context and one word with all the spelling that they leave sum to 1."""
    words = [b"a", b"bb", b"c", b"dd", b"rest"]
    base = np.array([[0.2, 0.1, 0.05, 0.05, 0.6], [0.1, 0.1, 0.3, 0.1, 0.4]]).T
    counts = [[3, 0, 1], [1, 1, 0], [0, 9, 2], [25, 0, 0], [0, 0, 0]]
    rows = [(0, w, sum(n), [7, 8, 9], n, [math.log(x) for x in b]) for w, n, b in zip(words, counts, base.tolist())]
    table = P.written(spark.createDataFrame(rows, P.WORDS + ", base array<double>"), "test-words")
    sums = defaultdict(float)
    for row in P.word_model(table).collect():
        for context, logp in zip(row.contexts, row.logp):
            sums[context] += 10**logp
    assert len(sums) == 3 and all(math.isclose(s, 1, rel_tol=1e-6) for s in sums.values())


def tables_exactly(n, base, others, discount):
    """Distribution of the number of tables of n customers of a dish."""
    p = {1: 1.0}
    for seated in range(1, n):
        after = defaultdict(float)
        for t, chance in p.items():
            fresh = (P.STRENGTH + discount * (others + t)) * base
            new = fresh / (fresh + seated - discount * t)
            after[t + 1] += chance * new
            after[t] += chance * (1 - new)
        p = after
    return p


@pytest.mark.parametrize("n, tolerance", [(2, 0.02), (9, 0.02), (32, 0.02), (500, 0.03)])
@pytest.mark.parametrize("base", [0.0005, 0.05, 0.4])
def test_seating_follows_the_restaurant(n, tolerance, base):
    """Numbers of tables are distributed as those of customers seated one by one, queues over 32 nearly so."""
    rows = 20_000
    found = P.seat(np.arange(rows), np.full(rows, n), np.full(rows, base), np.full(rows, 40.0), 0.6, 5)
    exact = tables_exactly(n, base, 40.0, 0.6)
    mean = sum(t * p for t, p in exact.items())
    assert abs(found.mean() / mean - 1) < tolerance
    seen, worst, below = Counter(found.tolist()), 0.0, 0.0
    for t in range(1, n + 1):
        below += exact.get(t, 0.0) - seen[t] / rows
        worst = max(worst, abs(below))
    assert worst < tolerance


def test_a_second_draw_is_made_only_where_needed(monkeypatch):
    """Random numbers cost most of a sweep: a group of which few are expected to open tables takes one."""
    drawn, uniform = [], P._uniform
    monkeypatch.setattr(P, "_uniform", lambda key, salt: drawn.append(len(key)) or uniform(key, salt))
    P.seat(np.arange(100), np.full(100, 32), np.full(100, 1e-6), np.full(100, 40.0), 0.6, 5)
    assert sum(drawn) == 31 * 100
    drawn.clear()
    P.seat(np.arange(100), np.full(100, 64), np.full(100, 1e-6), np.full(100, 40.0), 0.6, 5)
    assert sum(drawn) == (31 + 14) * 100  # the others come in 8 groups of two and 6 of at most three customers


def test_queues_do_not_depend_on_those_beside_them():
    rng = np.random.default_rng(4)
    key, n, salt = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 3000, 300), rng.integers(0, 50, 300)
    base, others = rng.uniform(1e-6, 0.5, 300), rng.uniform(0, 500, 300)
    found = P.seat(key, n, base, others, 0.6, salt)
    each = [P.seat(key[i : i + 1], n[i : i + 1], base[i : i + 1], others[i : i + 1], 0.6, int(salt[i]))[0] for i in range(300)]
    assert found.tolist() == each


def test_a_bundle_holds_the_tokens_of_its_documents_once():
    texts = [b"A cat\x0b\x0csat", b"", b" \t\n\r ", b"on the\x1cmat\x00", b"the cat", "été 中文\u00a0A".encode(), b"a" * 100_000]
    bundle = P._Bundle()
    for i, text in enumerate(texts):
        bundle.add(i, i % 2 == 0, text)
    rows = bundle.emit(7, 3, P.pa.int64()).to_pylist()
    assert sum(r["payload"] is not None for r in rows if r["shard"] < 0) == 1
    assert [(r["id"], r["held_out"]) for r in rows if r["shard"] == P.DOCUMENT] == [(i, i % 2 == 1) for i in range(len(texts))]
    tokens, sizes, words = P.tokens_of(texts)
    expected = [[*t.lower().split(), P.END] for t in texts]
    assert sizes.tolist() == [len(x) for x in expected]
    assert words.take(P.pa.array(tokens)).to_pylist() == [w for x in expected for w in x]


@pytest.mark.parametrize("largest", [1, 50, 2**40, 2**62])
def test_distinct_numbers_and_places(largest):
    values = np.random.default_rng(3).integers(0, largest, 1000) // 3
    for x in (values, values[:1], values[:0]):
        assert all(np.array_equal(a, b) for a, b in zip(P._distinct(x), np.unique(x, return_inverse=True), strict=True))
    assert all(np.array_equal(a, b) for a, b in zip(P._unpacked(P._packed(values, values[:0])), (values, values[:0]), strict=True))
