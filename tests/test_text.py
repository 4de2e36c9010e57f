import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearth import constants as C
from hearth.functions import facts, labels, prompts, safety, text, vectors
from hearth.operators import corpus


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("  I feel embarassed_comma_ and LOOSING it_period_ \r\n ok_exclamation_ ", "I feel embarrassed, and losing it. ok!"),
        ("sweatings\0 defenitely", "sweating definitely"),
        ("a\xa0\u3000b", "a b"),
        ("a\x1c\x1f\x85\u2028b", "a b"),
        ("unloosing", "unloosing"),
        ("éloosing loosingé loosing", "éloosing loosingé losing"),
        ("loo\u017fing", "losing"),
        ("DEFEN\u0130TELY", "definitely"),
        ("   ", ""),
        (None, ""),
        ("loosing loosing", "losing losing"),
    ],
)
def test_clean_text(one, raw, clean):
    assert one(text.clean_text("x"), x=raw) == clean
    assert one(text.is_blank(text.text_or_empty("x")), x=raw) == (clean == "")


def test_clean_text_is_idempotent(spark):
    rows = spark.createDataFrame([("a  b_comma_ loosing",), ("\n x \t",)], "x string")
    once = text.clean_text("x")
    assert rows.filter(text.clean_text(once) != once).isEmpty()


@pytest.mark.parametrize(
    "raw, in_corpus, from_model",
    [
        ("Sad ", "sad", "sad"),
        ("sad,", "neutral", "sad"),
        ("happiness", "joyful", "neutral"),
        ("disgust", "neutral", "disgusted"),
        ("embarassed", "embarrassed", "neutral"),
        ("(joy) indeed", "neutral", "joyful"),
        ("", "neutral", "neutral"),
        (None, "neutral", "neutral"),
    ],
)
def test_labels(one, raw, in_corpus, from_model):
    assert one(labels.normalize_emotion("x"), x=raw) == in_corpus
    assert one(labels.normalize_model_label("x"), x=raw) == from_model


def test_taxonomy():
    assert len(C.TAXONOMY) == len(set(C.TAXONOMY)) == 35
    assert set(C.CORPUS_SYNONYMS.values()) | set(C.MODEL_SYNONYMS.values()) <= set(C.TAXONOMY)


def test_strip_label_token(one):
    assert one(labels.strip_label_token("x"), x="  Sad  my  dog ") == "my dog"
    assert one(labels.strip_label_token("x"), x="joy my dog") == "joy my dog"
    assert one(labels.strip_label_token("x", strip_synonyms=True), x="joy my dog") == "my dog"
    assert one(labels.strip_label_token("x"), x="sad") == ""
    assert one(labels.strip_label_token("x"), x=None) == ""


@pytest.mark.parametrize(
    "message, found",
    [
        ("My name is Ann Lee. I live in Paris, France.", ["User lives in Paris", "User's name is Ann Lee"]),
        ("I am 30 years old.", ["User is 30 years old"]),
        ("I'm a nurse.", ["User works as nurse"]),
        ("I am sad today", ["User's name is sad today"]),
        ("I love pizza!", ["User love pizza"]),
        ("my wife's name is Eve.", ["User has family member"]),
        ("I studied physics. I can code", ["User knows code", "User studied physics"]),
        ("hello", []),
        (None, None),
    ],
)
def test_extract_facts(one, message, found):
    assert one(facts.extract_facts("x"), x=message) == found


def test_strict_names_and_values(one):
    assert one(facts.extract_facts("x", strict_names=True), x="i am sad today") == []
    assert one(facts.extract_facts("x", strict_names=True), x="CALL ME Ann") == ["User's name is Ann"]
    details = one(facts.fact_details("x"), x="my wife is named Eve.")
    assert [(d.kind, d.value) for d in details] == [("family", "Eve")]


def test_cuts(one):
    assert one(text.snippet("x"), x="a" * 160) == "a" * 160
    assert one(text.snippet("x"), x="a\n" * 100) == "a " * 78 + "a..."
    assert one(text.title("x"), x="b" * 31) == "b" * 30 + "..."


def test_lexicon(one):
    assert one(safety.lexicon_scores("x", ["a", "b"]), x="b then A") == {"a": 1.0}
    assert one(safety.lexicon_scores("x", ["a", "b"]), x="abba") == {}
    assert one(safety.lexicon_scores("x", ["a", "b"]), x="") == {}
    assert one(safety.lexicon_scores("x", ["a b", "b c"]), x="a b c") == {"a b": 1.0}
    assert one(safety.lexicon_scores("x", ["b c", "a b"]), x="a b c") == {"b c": 1.0}


def test_score_map(spark):
    rows = spark.createDataFrame([(1, {"a": 0.5, "b": 0.1}), (2, {"a": 0.4}), (3, {}), (4, None)], "id int, s map<string,double>")
    got = rows.select("id", safety.max_score("s"), safety.is_toxic_scores("s")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 0.5, True), (2, 0.4, False), (3, 0.0, False), (4, 0.0, False)]
    at_zero = safety.guard(rows.withColumn("t", F.lit("x")), "t", scores=F.col("s"), threshold=0.0).orderBy("id")
    assert [r.toxic for r in at_zero.collect()] == [True, True, False, False]


def test_fallback_and_prompt(one):
    reply = one(prompts.fallback_response("e", "r"), e=None, r="off")
    assert "(fallback: off)" in reply and C.FALLBACK_LABEL in reply
    assert "fallback" not in one(prompts.fallback_response("e", "r"), e="sad", r=None)
    prompt = one(prompts.prompt_text("m", "e", "c", F.lit(True)), m="hi", e="", c=None)
    assert C.PROMPT_EMOTION + "unknown" in prompt and C.NO_CONTEXT in prompt and C.PROMPT_MESSAGE + "hi\n" in prompt


@pytest.mark.parametrize("dim", [64, 200])
def test_hash_embed(one, dim):
    import hashlib
    import math
    import re

    message = "query: Héllo wörld, hello 42 hello"
    counts = [0] * dim
    for token in re.findall(r"[^\W_]+", message.lower()):
        counts[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
    norm = math.sqrt(sum(c * c for c in counts))
    got = one(vectors.hash_embed("x", dim, "query: "), x=message[7:])
    assert got == pytest.approx([c / norm for c in counts], abs=1e-6)
    assert set(one(vectors.hash_embed("x", dim), x="...")) == {0.0}


def test_hash_embed_of_many_rows_and_nulls(spark, monkeypatch):
    texts = [None, "", "a b", "b", "a a b"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r.id: r.v for r in df.select("id", vectors.hash_embed("text", 5).alias("v")).collect()}
    for i, text in enumerate(texts):
        assert (got[i] is None) if text is None else got[i] == got[i % 5] and len(got[i]) == 5
    lists = pa.array([[0, 1, 1], None, [], [4]], pa.list_(pa.int32()))
    assert vectors._unit_counts(lists, 5).to_pylist()[1:] == [None, [0.0] * 5, [0.0] * 4 + [1.0]]
    # a slice that starts behind other rows
    assert vectors._unit_counts(lists.slice(2), 5).to_pylist() == [[0.0] * 5, [0.0] * 4 + [1.0]]


def test_embed_with_user_model(spark):
    def load():
        import numpy as np

        return lambda texts: np.array([[len(t), 0.0, 0.0] for t in texts])

    rows = spark.createDataFrame([("abc",), (None,)], "x string")
    got = [r[0] for r in rows.select(vectors.embed_with(load, "x", "q: ")).collect()]
    assert got == [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0]]


def test_clean_corpus_columns(spark):
    both = spark.createDataFrame([("sad my dog", "died_comma_ yes"), (None, None)], "context string, utterance string")
    assert [tuple(r) for r in corpus.clean_corpus(both).collect()] == [("my dog died, yes", "sad")]
    only = spark.createDataFrame([("hi", "joy")], "text string, label string")
    assert [tuple(r) for r in corpus.clean_corpus(only).collect()] == [("hi", "joyful")]
    plain = spark.createDataFrame([("hi",)], "dialogue string")
    assert corpus.clean_corpus(plain).first()["emotion"] == "neutral"
    with pytest.raises(ValueError):
        corpus.clean_corpus(spark.createDataFrame([("hi",)], "other string"))
    long = spark.createDataFrame([("x" * 1199 + " yz",)], "text string")
    assert corpus.clean_corpus(long).first()["text"] == "x" * 1199 + " "
