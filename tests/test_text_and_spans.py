"""Text functions C1 to C14, P2 to P5, and spans R1 to R9, N1 to N12."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptmix.functions import places, text
from promptmix.operators import spans


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("value", "ratio"), [("你好世界", 1.0), ("你好 ab", 0.5), ("hello", 0.0), ("", 0.0), ("  ", 0.0), (None, 0.0)])
def test_cjk_ratio(spark, value, ratio):
    assert one(spark, value, text.cjk_ratio) == ratio


@pytest.mark.parametrize(("value", "found"), [("see you Mon.", True), ("MAY 3", True), ("maybe", False), ("Thurs", True), ("summary", False), ("sat", True), ("", False), (None, False)])
def test_calendar_words(spark, value, found):
    assert one(spark, value, text.has_calendar_word) is found


@pytest.mark.parametrize(("word", "root"), [("manuel7pavlov@x.test", "manuelpavlov"), ("A1234pavlov", "pavlov"), ("a1b2", "ab"), ("123", ""), ("", "")])
def test_root(spark, word, root):
    assert one(spark, word, text.root_key) == root


@pytest.mark.parametrize(("word", "yes"), [("a.b@c.de", True), (" a@b.c ", True), ("a@b", False), ("@b.c", False), ("a b@c.d", False)])
def test_email(spark, word, yes):
    assert one(spark, word, text.is_email) is yes and text.looks_like_email(word) is yes


def test_casing():
    assert text.cased_like("ann lee", "BOB") == "ANN LEE" and text.cased_like("o'neil mary-jane", "Bob") == "O'Neil Mary-Jane"
    assert text.cased_word_by_word("jo ann lee", "Bob SMITH") == "Jo ANN lee" and text.cased_word_by_word("x", "a@b.c") == "x"


def test_strip_special(spark):
    rows = spark.createDataFrame([("a-b", "cd"), ("a-b", "c-d"), ("--", "cd"), ("ab", "cd")], "f string, r string")
    assert [r.x for r in rows.select(text.strip_special_if_plain(F.col("f"), F.col("r")).alias("x")).collect()] == ["ab", "a-b", "--", "ab"]


def test_normal_forms(spark):
    assert one(spark, "The cat,  and A dog!", text.normal_answer) == "cat and dog"
    assert one(spark, "éa an anéç the çan", text.normal_answer) == "éa anéç çan"
    assert one(spark, "你好， 世界。ABC", text.normal_chinese_answer) == "你好世界abc"
    assert one(spark, "a_b (c) é.", text.normal_text) == "a b c é."
    assert one(spark, "\n\n first \nsecond", text.first_line) == "first"
    assert one(spark, "<PII> it's; ok", text.words_and_signs) == ["<PII>", "it", "s", ";", "ok"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab1😀 é", max_size=12), min_size=1, max_size=5))
def test_places_are_code_points(spark, values):
    import re

    df = spark.createDataFrame([(v,) for v in values], "v string")
    for v, row in zip(values, df.select("v", places.places(F.col("v"), "[ab]+").alias("p")).collect(), strict=True):
        assert [(p.start, p.end, p.word) for p in row.p] == [(m.start(), m.end(), m[0]) for m in re.finditer("[ab]+", row.v)]


def test_parse_affix_and_template(spark):
    ner = "Pay <redacted> $3,200.00 (MONEY) </redacted> to\n<redacted> X (WORK_OF_ART) </redacted>, <redacted> *** (ID) </redacted>."
    row = spark.createDataFrame([(ner,)], "ner string").select(spans.parsed(F.col("ner")).alias("s"), spans.template(F.col("ner")).alias("t"), spans.affixes(F.lit("$3,200.00")).alias("a"), spans.affixes(F.lit("***")).alias("b")).first()
    assert [(s.word, s.type) for s in row.s] == [("$3,200.00", "MONEY"), ("X", "WORK_OF_ART"), ("***", "ID")]
    assert row.t == "Pay <redacted> to <redacted>, <redacted>."
    assert tuple(row.a) == ("$", "3,200.00", "") and tuple(row.b) == ("", "***", "")


def test_prefix_and_splice(spark):
    ner = "a <redacted> B (X) </redacted> c <redacted> D (Y) </redacted>"
    df = spark.createDataFrame([(ner,)], "ner string")
    tpl = spans.template(F.col("ner"))
    real = F.transform(spans.parsed(F.col("ner")), lambda s: s["word"])
    row = df.select(spans.prompt_with_target(tpl, F.lit(1), real).alias("i"), spans.prompt_with_target(tpl, F.lit(1), real, "real").alias("r"), spans.spliced(F.col("ner"), F.array(F.lit("$1"), F.lit("\\x"))).alias("s")).first()
    assert row.i == "a <redacted> c [TARGET]" and row.r == "a B c [TARGET]" and row.s == "a $1 c \\x"


def test_labels(spark):
    assert one(spark, " city", spans.mapped_label) == "LOCATION" and one(spark, "other", spans.mapped_label) == "OTHER"
    assert spans.merged_labels({"A": "B"}, ["A: C", "bad", "D:E"]) == {"A": "C", "D": "E"}


def test_best_label(spark):
    s = spark.createDataFrame([(1, 0, 10), (1, 20, 30), (2, 0, 5)], "doc_id long, start int, end int")
    e = spark.createDataFrame([(1, 0, 0, 4, "A"), (1, 1, 4, 8, "B"), (1, 2, 18, 21, "C"), (1, 3, 21, 40, "D")], "doc_id long, idx int, start int, end int, label string")
    assert {(r.doc_id, r.start): r.label for r in spans.best_labels(s, e).collect()} == {(1, 0): "A", (1, 20): "D", (2, 0): None}


def test_clip_and_redact(spark):
    schema = "text string, e array<struct<start:int,end:int,label:string>>"
    df = spark.createDataFrame([("abcdefghij", [(5, 2, "X"), (2, 6, "givenname"), (4, 20, "Q"), (0, 1, "Z")])], schema)
    row = df.withColumn("n", spans.normalised(F.col("e"))).withColumn("c", spans.clipped(F.col("n"), F.length("text"))).withColumn("r", spans.redacted(F.col("text"), F.col("c"), ("Z",))).first()
    assert [tuple(x) for x in row.c] == [(0, 1, "Z"), (2, 6, "PERSON"), (6, 10, "Q")]
    assert row.r == "ab<redacted> cdef (PERSON) </redacted><redacted> ghij (Q) </redacted>"


def test_difference():
    assert spans.difference("call Ann now", "call <PII> now") == [(5, 8)]
    assert spans.difference("same", "same") == [] and spans.difference("all", "<PII>") == [(0, 3)]


def test_trim_and_split():
    phrase = ' "the Big Ben and Tower & 5%, '
    found = spans.refine(phrase, [{"entity_type": "P", "start": 0, "end": len(phrase), "score": 1.0}] * 2)
    assert [x["text"] for x in found] == ["Big Ben", "Tower", "5%"]
    assert spans.refine("of the", [{"entity_type": "P", "start": 0, "end": 6, "score": 1.0}]) == []


def test_recogniser_threshold_and_ignore(spark):
    df = spark.createDataFrame([("mail a.b@c.de or 10.0.0.1",)], "t string")
    kinds = lambda r: [x.entity_type for x in df.select(r.entities(F.col("t")).alias("e")).first().e]
    assert kinds(spans.RegexRecogniser()) == ["EMAIL", "IP"]
    assert kinds(spans.RegexRecogniser(ignored=("IP",), labels={"EMAIL": "MAIL"})) == ["MAIL"]
    assert kinds(spans.RegexRecogniser(score=0.4, threshold=0.5)) == []
