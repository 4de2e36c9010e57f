import math
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearth.functions.overlap import IRREGULAR, STEP2, STEP3, STEP4, lcs_length, porter_stem, stems, tokens_13a
from hearth.functions.labels import normalize_model_label
from hearth.operators import metrics
from hearth.plans import jobs
from hearth.plans.oracle import stemming, with_ctes


def pairs(spark, rows):
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(rows)], "row_id long, pred string, ref string")


def test_tokens_13a(one):
    assert one(tokens_13a("x"), x="Hi, it's 3.5 (ok)-- &amp; 7-8.\n") == ["Hi", ",", "it's", "3.5", "(", "ok", ")", "--", "&", "7", "-", "8", "."]


def test_bleu_golden(spark):
    report = metrics.bleu(pairs(spark, [("the cat sat on mat", "the cat sat on the mat")])).first()
    assert report.brevity_penalty == pytest.approx(0.818731, abs=1e-6)
    assert report.bleu == pytest.approx(57.893007, abs=1e-6)
    same = metrics.bleu(pairs(spark, [("a b c d", "a b c d"), ("", "")])).first()
    assert same.bleu == pytest.approx(100) and same.samples == 2
    assert metrics.bleu(pairs(spark, [("a b c", "a b c")])).first().bleu == 0
    assert metrics.bleu(pairs(spark, [("x", "y")])).first().bleu == 0


def plain_bleu(rows):
    match, total, sys_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for pred, ref in rows:
        p, r = pred.split(), ref.split()
        sys_len, ref_len = sys_len + len(p), ref_len + len(r)
        for n in range(1, 5):
            grams = [Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (p, r)]
            match[n - 1] += sum((grams[0] & grams[1]).values())
            total[n - 1] += sum(grams[0].values())
    if not any(match) or not all(total):
        return 0.0
    smooth, logs = 1.0, 0.0
    for m, t in zip(match, total):
        if m == 0:
            smooth *= 2
        logs += math.log(m / t if m else 1 / (smooth * t))
    bp = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len)
    return 100 * bp * math.exp(logs / 4)


@pytest.mark.parametrize("words", [3, 40])
def test_bleu_against_plain_python(spark, words):
    rng = random.Random(words)
    rows = [
        tuple(" ".join(f"w{rng.randrange(words)}" for _ in range(rng.randrange(12))) for _ in range(2)) for _ in range(40)
    ]
    for parts in (1, 5):
        got = metrics.bleu(pairs(spark, rows).repartition(parts)).first()
        assert got.bleu == pytest.approx(plain_bleu(rows), abs=1e-9)


def test_bleu_needs_no_key(spark):
    rows = pairs(spark, [("the cat sat on mat", "the cat sat on the mat"), ("a b c d", "a b c d")])
    same_id = rows.withColumn("row_id", F.lit(1))
    assert metrics.bleu(same_id).first() == metrics.bleu(rows).first()
    assert metrics.bleu(same_id).first().samples == 2
    empty = metrics.bleu(rows.filter("false")).first()
    assert (empty.bleu, empty.samples) == (0.0, 0)


def test_fallback_counts(spark):
    rows = pairs(spark, [("a", "b"), ("", "b")]).withColumn("used", F.col("row_id") == 1)
    assert metrics.bleu(rows, fallback="used").first().fallback_responses == 1
    assert metrics.rouge_l(rows, fallback="used").first().fallback_responses == 1


def test_rouge_golden(spark):
    row = metrics.rouge_l_rows(pairs(spark, [("the cat on mat", "the cat sat on the mat")])).first()
    assert (row.precision, row.recall, row.f1) == pytest.approx((1.0, 2 / 3, 0.8))
    empty = metrics.rouge_l_rows(pairs(spark, [("", "a"), ("?!", "b")])).agg(F.max("f1")).first()
    assert empty[0] == 0
    stemmed = pairs(spark, [("running cats", "run cat")])
    assert metrics.rouge_l_rows(stemmed).first().f1 == pytest.approx(1.0)
    assert metrics.rouge_l_rows(stemmed, stem=False).first().f1 == 0


def test_rouge_sides_swap(spark):
    a = metrics.rouge_l_rows(pairs(spark, [("a b c d e", "b d x")])).first()
    b = metrics.rouge_l_rows(pairs(spark, [("b d x", "a b c d e")])).first()
    assert (a.precision, a.recall) == (b.recall, b.precision)


def test_lcs_against_table():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(90))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert lcs_length(a, b) == table[-1][-1]


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"),
        ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"),
        ("generalization", "gener"), ("electricity", "electr"), ("hopefulness", "hope"), ("adoption", "adopt"),
        ("replacement", "replac"), ("probate", "probat"), ("controlling", "control"), ("dying", "die"), ("enjoy", "enjoy"),
        ("spied", "spi"), ("died", "die"), ("oscillators", "oscil"),
    ],
)
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_alignment_golden(spark):
    rows = spark.createDataFrame([("sad", "sad"), ("sad", "neutral"), ("joyful", "joyful")], "gold string, pred string")
    got = metrics.emotion_alignment(rows).first()
    assert got.accuracy == pytest.approx(2 / 3)
    assert (got.precision_macro, got.recall_macro, got.f1_macro) == pytest.approx((2 / 3, 0.5, 0.555556), abs=1e-6)
    assert got.samples == 3


def test_toxicity_golden(spark):
    rows = spark.createDataFrame([({"t": 0.9},), ({"t": 0.2, "u": 0.1},), ({"t": 0.6},)], "scores map<string,double>")
    got = metrics.toxicity_reduction(rows).first()
    assert got.avg_toxicity_raw == pytest.approx(0.566667, abs=1e-6)
    assert got.avg_toxicity_post == pytest.approx(0.066667, abs=1e-6)
    assert got.absolute_reduction == pytest.approx(0.5)
    assert got.percent_reduction == pytest.approx(88.235294, abs=1e-6)
    assert (got.toxic_raw_count, got.toxic_post_count) == (2, 0)
    off = metrics.toxicity_reduction(rows, use_filter=False, count_threshold=0.0).first()
    assert off.absolute_reduction == 0 and off.toxic_post_count == 3
    none = metrics.toxicity_reduction(rows.select(F.lit(None).cast("map<string,double>").alias("scores"))).first()
    assert none.percent_reduction == 0 and none.toxic_raw_count == 0


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_greedy_match_against_numpy(spark, block_rows):
    import numpy as np

    rng = np.random.default_rng(3)
    rows, expected = [], []
    for row_id, (nc, nr) in enumerate([(40, 30), (2, 1), (1, 3), (4, 0), (0, 2)]):
        c, r = rng.normal(size=(nc, 4)), rng.normal(size=(nr, 4))
        rows += [(row_id, "cand", i, v.tolist()) for i, v in enumerate(c)]
        rows += [(row_id, "ref", i, v.tolist()) for i, v in enumerate(r)]
        if nc and nr:
            sims = c @ r.T
            p, q = sims.max(1).mean(), sims.max(0).mean()
            expected.append((p, q, 2 * p * q / (p + q)))
        else:
            expected.append((0.0, 0.0, 0.0))
    tokens = spark.createDataFrame(rows, "row_id long, side string, pos long, vec array<double>")
    got = metrics.greedy_match(tokens, block_rows=block_rows).orderBy("row_id").collect()
    assert [tuple(x)[1:] for x in got] == [pytest.approx(e) for e in expected]


def test_report_rows(spark):
    from hearth.sources.tables import metric_report

    report = spark.createDataFrame([("m", 3)], "metric string, samples long")
    assert [tuple(r) for r in metric_report(report).collect()] == [("metric", "m"), ("samples", "3")]




def test_labels_predicted_by_a_stored_model(spark, tmp_path):
    """Counts of a small naive Bayes model against direct computation; gold labels as they are and mapped."""
    rows = [("sun and joy", "joyful"), ("joy joy", "joyful"), ("rain and tears", "sad"), ("tears", "sad"), ("tears and rain", "sad")]
    jobs.save_classifier(jobs.fit_bayes_classifier(spark.createDataFrame(rows, "text string, emotion string")), f"{tmp_path}/m")
    model = jobs.load_classifier(f"{tmp_path}/m")
    pairs = [("joy", "Joyful "), ("tears of rain", "sad"), ("unknown words", "happy"), (" ", "sad"), (None, "sad"), ("joy and joy", None), ("and", "sad")]
    table = spark.createDataFrame(pairs, "text string, reference_emotion string")

    def guess(text):
        words = {w for t, _ in rows for w in t.split()}
        scores = {}
        for label in ("sad", "joyful"):  # the more frequent label wins a tie
            own = [w for t, e in rows if e == label for w in t.split()]
            n = sum(e == label for _, e in rows)
            known = [w for w in text.split() if w in words]
            scores[label] = math.log((n + 1) / (len(rows) + 2)) + sum(math.log((own.count(w) + 1) / (len(own) + len(words))) for w in known)
        return max(scores, key=scores.get)

    usable = [(t.strip(), g.strip().lower()) for t, g in pairs if t and t.strip() and g]
    report = jobs.emotion_report(table, model).first()
    assert report.samples == len(usable) == 4
    assert report.accuracy == pytest.approx(sum(guess(t) == g for t, g in usable) / len(usable))
    predicted = {r.text: r.predicted for r in jobs.classify(model, table.filter("trim(text) <> ''")).collect()}
    assert predicted == {t: guess(t) for t in predicted}
    # gold labels outside the taxonomy are brought into it
    mapped = jobs.emotion_report(table, model, map_gold=True).first()
    gold = {g: spark.range(1).select(normalize_model_label(F.lit(g))).first()[0] for _, g in usable}
    assert mapped.accuracy == pytest.approx(sum(guess(t) == gold[g] for t, g in usable) / len(usable))
    # a limit counts pairs without nulls, blank ones included, which go afterwards
    assert jobs.emotion_report(table, model, limit=3, order_by=["text"]).first().samples == 2


def test_stems_equal_the_sql_rules():
    """The rules of the stemmer, written once more as SQL, over made-up words with every suffix."""
    rng = random.Random(4)
    endings = ["", "s", "ed", "ing", "ied", "ies", "eed", "sses", "y", "e", "ll", *STEP4, *(old for old, _ in STEP2 + STEP3)]
    words = {"".join(rng.choices("abcdeilnorstyvwx", k=rng.randint(1, 6))) + rng.choice(endings) + rng.choice(["", "s", "ed", "ly"]) for _ in range(5000)}
    words = sorted(words | set(IRREGULAR) | {"yyyes", "toyyyed", "happily", "generalizations"})
    con = duckdb.connect()
    con.register("tokens", pa.table({"token": words}))
    assert dict(con.execute(with_ctes("SELECT token, w FROM stems", *stemming("tokens"))).fetchall()) == dict(zip(words, stems(words)))
