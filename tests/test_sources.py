import json

import pytest
from pyspark.sql import functions as F

from hearth import constants as C
from hearth.sources import requests as R
from hearth.sources import tables as S


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content.encode() if isinstance(content, str) else content)
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_comma_quotes_and_missing(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'text,response\n"a, b","x"\nNA,null\n"",""\nshort\ntoo,many,fields\n')
    assert rows(S.scan_csv(spark, path)) == [("a, b", "x"), (None, None), (None, None), ("short", None)]
    assert rows(S.scan_csv(spark, path, keep_bad=True)) == [("too,many,fields",)]


def test_dropped_records_come_back_as_text(spark, tmp_path):
    path = write(tmp_path, "bad.csv", 'text;response\na;b\n"e; f";g;h\nshort\nx;y;\nq;r;s;t\n')
    assert rows(S.scan_csv(spark, path)) == [("a", "b"), ("short", None), ("x", "y")]
    assert sorted(rows(S.scan_csv(spark, path, keep_bad=True))) == [('"e; f";g;h',), ("q;r;s;t",)]


@pytest.mark.parametrize("sep", [";", "\t", "|"])
def test_other_delimiters(spark, tmp_path, sep):
    path = write(tmp_path, "b.csv", f"context{sep}utterance\nsad, very{sep}oh\n")
    assert rows(S.scan_csv(spark, path)) == [("sad, very", "oh")]


def test_records_over_lines(spark, tmp_path):
    path = write(tmp_path, "c.csv", 'text,emotion\n"two\nlines",sad\none,joy\n')
    assert S.has_multiline_records(spark, path)
    assert rows(S.scan_csv(spark, path)) == [("two\nlines", "sad"), ("one", "joy")]


def test_inner_quotes(spark, tmp_path):
    path = write(tmp_path, "d.csv", 'text,response\n"soon entitle "Agents"","fine"\n')
    assert rows(S.scan_csv(spark, path)) == [('soon entitle "Agents"', "fine")]


def test_undecodable_bytes(spark, tmp_path):
    path = write(tmp_path, "e.csv", b"text,emotion\na\xffb,sad\n")
    assert rows(S.scan_csv(spark, path)) == [("ab", "sad")]


def test_splits(spark, tmp_path):
    write(tmp_path, "train.csv", "context,utterance,emotion\nc,u,sad\n")
    write(tmp_path, "valid.csv", "utterance;context\nu2;c2\n")
    df = S.scan_corpus_splits(spark, str(tmp_path))
    assert sorted(rows(df.select("context", "utterance", "emotion")), key=str) == [("c", "u", "sad"), ("c2", "u2", None)]
    with pytest.raises(FileNotFoundError):
        S.scan_corpus_splits(spark, str(tmp_path / "none"))


def test_corpus_build_from_files(spark, tmp_path):
    from hearth.plans.jobs import build_corpus

    write(tmp_path, "train.csv", "context,utterance\nsad day,it rained_comma_ a lot\nsad day,it rained_comma_ a lot\n,\n")
    assert rows(build_corpus(spark, str(tmp_path))) == [("day it rained, a lot", "sad")]


def test_load_pairs_order_of_steps(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "  ", "y"), (3, " a ", "b "), (4, "c", "d")], "n int, text string, response string")
    got = S.load_pairs(df, limit=2, order_by=["n"])
    assert rows(got) == [(3, "a", "b")]
    assert S.load_pairs(df).count() == 2
    with pytest.raises(S.MissingColumns):
        S.load_pairs(df.drop("response"))
    with pytest.raises(ValueError):
        S.load_pairs(df, limit=2)
    labelled = df.select("text", F.lit(" Sad").alias("reference_emotion"))
    assert {r.reference_emotion for r in S.load_emotion_pairs(labelled).collect()} == {"sad"}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "q", b\\', " x "), ("é,", "y")], "text string, emotion string")
    path = str(tmp_path / "out")
    S.write_csv(df, path)
    assert sorted(rows(S.read_written_csv(spark, path, "text string, emotion string"))) == sorted(rows(df))


def test_requests(spark):
    bodies = [
        {"message": " hi "}, {"message": "", "use_filter": True}, {"message": "m", "use_filter": None, "user_id": "u"},
        {"message": "m", "use_filter": False, "conversation_id": "c"}, {"message": "m", "use_filter": 0},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(9, "oops"), (10, None)], "n int, body string")
    got = {r.n: r for r in R.parse_requests(df).collect()}
    assert (got[0].message, got[0].use_filter, got[0].user_id, got[0].conversation_id) == ("hi", True, "default", "")
    assert [n for n, r in got.items() if not r.accepted] == [1, 9, 10]
    assert (got[2].use_filter, got[2].user_id) == (False, "u")
    assert (got[3].use_filter, got[3].conversation_id, got[4].use_filter) == (False, "c", False)
    assert R.accepted(R.parse_requests(df)).count() + R.rejected(R.parse_requests(df)).count() == 7


def test_result_json(spark):
    fields = {f: F.lit(None).cast("string") for f in C.RESULT_FIELDS}
    fields["toxicity_scores"] = F.create_map(F.lit("a"), F.lit(1.0))
    df = spark.range(1).select(*[c.alias(n) for n, c in fields.items()])
    body = json.loads(df.select(R.result_json(df)).first()[0])
    assert list(body) == C.RESULT_FIELDS and body["emotion"] is None and body["toxicity_scores"] == {"a": 1.0}
    assert len(json.loads(df.select(R.result_json(df, C.SHORT_RESULT_FIELDS)).first()[0])) == 5
    with pytest.raises(ValueError):
        R.result_json(df.drop("emotion"))


def test_escaped_quotes_across_lines(spark, tmp_path):
    path = tmp_path / "two_lines.csv"
    path.write_text('text,response\n"a\\"b\nc\\"d",y\n')
    assert S.has_multiline_records(spark, str(path))
    assert [tuple(r) for r in S.scan_csv(spark, str(path)).collect()] == [('a"b\nc"d', "y")]
