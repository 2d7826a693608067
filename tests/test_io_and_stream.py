"""Sources, sinks, the staged pipeline, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from promptmix.operators import spans
from promptmix.plans import pipeline
from promptmix.sources import io
from promptmix.streaming import redact

LINES = '{"text": "a", "masked_text": "b"}\n\nbroken\n{"text": "c"}\n'


def test_three_ways_with_bad_lines(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text(LINES)
    assert sorted(r.text for r in io.read_jsonl(spark, str(path), io.MASKED, "drop").collect()) == ["a", "c"]
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_jsonl(spark, str(path), io.MASKED).collect()
    kept = io.read_jsonl(spark, str(path), io.MASKED, "keep")
    io.write_with_bad_lines(kept, str(tmp_path / "out"))
    assert "broken" in {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}


def test_aliases_and_limits(spark):
    df = spark.createDataFrame([("", "t", None, "m", "x"), ("o", "t", "n", None, "ner_statistics")], "original_text string, text string, ner_text string, masked_text string, type string")
    assert [(r.a, r.b) for r in df.select(io.field(df, "original").alias("a"), io.field(df, "ner").alias("b")).collect()] == [("t", "m"), ("o", "n")]
    assert io.without_statistics(df).count() == 1
    assert [r.id for r in io.read_limit(spark.range(9), "id", 2).collect()] == [0, 1] and io.read_limit(spark.range(9), "id", 0).count() == 9


def test_sample_shapes(spark):
    rows = ['["plain", ["pair", 0.5], {"text": "obj", "prob": 0.25}, {"text": "bare"}]', "[]", None]
    got = [[tuple(s) for s in r.s] for r in spark.createDataFrame([(x,) for x in rows], "v string").select(io.samples_of(F.col("v")).alias("s")).collect()]
    assert got == [[("plain", 1.0), ("pair", 0.5), ("obj", 0.25), ("bare", 1.0)], [], []]


def test_summary_file(spark, tmp_path):
    path, one = str(tmp_path / "d" / "s.json"), spark.createDataFrame([(1,)], "n int")
    assert io.append_summary(one, path) == [{"n": 1}] and io.append_summary(one, path) == [{"n": 1}, {"n": 1}]
    assert len(io.append_summary(one, path)) == 3
    (tmp_path / "d" / "s.json").write_text("oops")
    assert io.append_summary(one, path) == [{"n": 1}] and json.loads((tmp_path / "d" / "s.json").read_text()) == {"n": 1}


def test_pipeline_stages_can_be_resumed(spark, tmp_path):
    df = spark.createDataFrame([("1", "mail ann.lee@mail1.example.com or call +1 (555) 010-9999"), ("2", "nothing"), ("3", None)], "doc_id string, text string")
    direct = {r.doc_id: (r.samples, r.rouge1) for r in pipeline.run(df).collect()}
    staged = {r.doc_id: (r.samples, r.rouge1) for r in pipeline.run(df, stage_dir=str(tmp_path)).collect()}
    assert direct == staged and set(direct) == {"1"} and direct["1"][0] == 5 and 0 < direct["1"][1] < 1
    assert spark.read.parquet(f"{tmp_path}/generation").count() == 1


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    source = tmp_path / "table"
    spark.read.parquet(f"{sf_dir}/conversations.parquet").repartition(3).write.parquet(str(source))
    stream = redact.redact(redact.stream_table(spark, str(source), 1)).where(spans.has_spans(F.col("redacted")))
    got = redact.run_to_table(stream, "redacted_turns", str(tmp_path / "c"))
    want = redact.redact(spark.read.parquet(str(source))).where(spans.has_spans(F.col("redacted")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
