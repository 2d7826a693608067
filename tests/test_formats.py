"""Formatters, judge pools, stand-in encoders and small helpers."""

import pytest
from pyspark.sql import functions as F

from promptmix.operators import formats, generate, judge, metrics, spans

PATTERNS = {"PERSON": "Ann|Leo", "GPE": "Oslo"}


def test_masked_pairs(spark):
    rows = [
        (1, "Ann flew to Oslo on Mon. 3", "<PII> flew to <PII> on <PII> 3"),
        (2, "nothing hidden", "nothing hidden"),
        (3, None, "x"),
        (4, "你好世界 Ann", "<PII>"),
        (5, "你 Leo met Bob now", "你 <PII> met <PII> now"),
    ]
    df = spark.createDataFrame(rows, "id int, text string, masked string")
    got = {r.id: r.masked_text for r in formats.format_masked_pairs(df, "id", "text", "masked", spans.RegexRecogniser(PATTERNS)).collect()}
    assert got == {
        1: "<redacted> Ann (PERSON) </redacted> flew to Oslo on <redacted> Mon. (DATE) </redacted> 3",
        2: "nothing hidden",
        5: " <redacted> Leo (PERSON) </redacted> met Bob now",
    }
    assert formats.format_masked_pairs(df, "id", "text", "masked", limit=2).count() == 2


def test_labelled(spark):
    rows = [(1, "Ann of Oslo", "en", [("givenname", 0, 3), ("city", 7, 99), ("x", 2, 5)]), (2, "Ann", "de", []), (3, None, "en", [])]
    df = spark.createDataFrame(rows, "id int, text string, lang string, m array<struct<label:string,start:int,end:int>>")
    got = formats.format_labelled(df, "id", "text", "m", "lang").collect()
    assert [r.masked_text for r in got] == ["<redacted> Ann (PERSON) </redacted><redacted>  o (X) </redacted>f <redacted> Oslo (LOCATION) </redacted>"]


def test_overlaps_repeat_in_the_compatible_writer(spark):
    df = spark.createDataFrame([("abcdef", [("A", 0, 4), ("B", 2, 6)])], "t string, e array<struct<entity_type:string,start:int,end:int>>")
    assert df.select(formats.marked_with_overlaps(F.col("t"), F.col("e")).alias("r")).first().r == "<redacted> abcd (A) </redacted><redacted> cdef (B) </redacted>"


def test_judge_pool(spark):
    def answer(prompt):
        if prompt == "bad":
            raise ValueError
        return prompt.upper()

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "p string")
    assert [r.x for r in df.select(judge.CallableJudge(answer, 2).answers(F.col("p"), F.col("p")).alias("x")).collect()] == ["A", None, "C"]


def test_stand_in_vectors_and_similarity(spark):
    df = spark.createDataFrame([("a b c d e", "a b c d e"), ("a b c d f", "a b c d f")], "x string, y string")
    row = metrics.similarity_row(df, "x", "y").first()
    assert all(v == pytest.approx(1.0) for v in row)
    truths = spark.createDataFrame([("the cat", ["dog", "cat"]), ("x", ["y"])], "p string, t array<string>")
    assert metrics.with_truths(truths, "p", "t").first().score == 50.0


def test_small_helpers(spark):
    assert spark.range(1).select(generate.quota(10, F.lit(4)), generate.quota(1, F.lit(9))).first()[:] == (2, 1) and generate.oversampled(10, 1.25) == 12 and generate.oversampled(10, 0.5) == 10
    row = spark.createDataFrame([("<s>bo</s>", "EMAIL", "Ann@x.y"), ("bo", "NAME", "ANN")], "w string, k string, r string")
    got = row.select(generate.without_specials(F.col("w")).alias("s"), generate.for_type(generate.without_specials(F.col("w")), F.col("k"), F.col("r")).alias("f")).collect()
    assert [(r.s, r.f) for r in got] == [("bo", "Bo@x.y"), ("bo", "BO")]
