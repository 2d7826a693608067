"""Engines with a fallback, data sets from folders, sampler helpers, finished lists, and further scores."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptmix.operators import generate, metrics, sampling, spans
from promptmix.sources import io


def engine():
    def find(text):
        return [("PER", i, i + 3, 0.9 if i else 0.4) for i in range(len(text)) if text.startswith("Ann", i)] + [("FAC", 0, 1, 1.0)]

    return find


def broken():
    raise OSError("no model")


@pytest.mark.parametrize("build", [engine, spans.with_fallback(broken, engine), spans.with_fallback(engine, broken)])
def test_engine_maps_labels_and_has_a_threshold(spark, build):
    df = spark.createDataFrame([(0, "Ann met Ann"), (1, None), (2, "")], "i int, t string")
    rows = {r.i: r.e for r in df.select("i", spans.EngineRecogniser(build, ignored=("BUILDING",)).entities(F.col("t")).alias("e")).collect()}
    assert [(x.entity_type, x.start, x.end, x.text) for x in rows[0]] == [("PERSON", 8, 11, "Ann")] and rows[1] == rows[2] == []
    low = df.where("i = 0").select(F.explode(spans.EngineRecogniser(build, threshold=0.1).entities(F.col("t"))).alias("x")).select("x.entity_type").collect()
    assert sorted(r.entity_type for r in low) == ["BUILDING", "PERSON", "PERSON"]


def test_folder_source(spark, tmp_path):
    (tmp_path / "en").mkdir()
    for name, rows in (("train-0", [{"a": 1, "b": "x"}, {"a": 2}]), ("train-1", [{"a": 3, "b": "z", "c": 0}]), ("test", [{"a": 9}])):
        (tmp_path / "en" / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    spark.dataSource.register(io.FolderSource)
    read = lambda split: spark.read.format("records").schema("a int, b string").option("path", str(tmp_path)).option("config", "en").option("split", split).load()
    assert sorted((r.a, r.b) for r in read("train").collect()) == [(1, "x"), (2, None), (3, "z")] and read("test").count() == 1


def test_spacing_and_suffixes(spark):
    df = spark.createDataFrame([([" a", "b", " c"], " x", ["the", " cat", " sat", " down"], [" sa", " down"]), (["b"], " x", ["the", " cat"], [" dog"])], "c array<string>, t string, w array<string>, s array<string>")
    got = df.select(sampling.spaced_like(F.col("c"), F.col("t")).alias("a"), sampling.before_suffix(F.col("w"), F.col("s")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [([" a", " c"], ["the", " cat"]), ([" x"], ["the", " cat"])]


def test_pooled_vectors(spark):
    vectors = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 3.0]), ("z", [0.0, 0.0])], "token string, v array<double>")
    words = spark.createDataFrame([("ab", ["a", "b"]), ("a?", ["a", "?"]), ("z", ["z"]), ("?", ["?"])], "word string, tokens array<string>")
    got = {r.word: r.v for r in sampling.pooled_vectors(words, vectors).collect()}
    assert got["ab"] == pytest.approx([0.5**0.5] * 2) and got["a?"] == [1.0, 0.0] and got["z"] == [0.0, 0.0] and "?" not in got


def test_beams_behind_other_prefixes(spark):
    lm = sampling.bigrams(spark.createDataFrame([("x b c",), ("y b c",), ("y d c",), ("r b c",)], "text string"))
    texts = spark.createDataFrame([(1, ["r", "b", "c"])], "id int, w array<string>")
    prefixes = spark.createDataFrame([(1, ["x"]), (1, ["y"])], "id int, path array<string>")
    got = {(tuple(r.path), round(r.weight, 6)) for r in sampling.beams(texts, lm, 9, 2, prefixes=prefixes).collect()}
    assert got == {(("x", "b", "c"), 1.0), (("y", "b", "c"), 0.5), (("y", "d", "c"), 0.5)}


def test_completed_lists(spark):
    found = [("Ivo Petrak", "NAME"), ("petrak", "NAME"), ("ivo.petrak@m.test", "EMAIL"), ("42%", "PERCENT"), ("Ivo Petrak", "NAME"), ("Oslo", "GPE")]
    pools = [["ann lee", "ann-lee", "Ivo Petrak"], ["q"], ["w"], ["e"], ["r"], []]
    df = spark.createDataFrame([(found, pools)], "s array<struct<word:string,type:string>>, p array<array<string>>")
    got = df.select(generate.completed(F.col("s"), F.col("p"), 3).alias("l")).first().l
    assert [len(x) for x in got] == [3] * 6 and got[0] == got[4] == ["Ann Lee", "AnnLee", "Ann Lee"]
    assert got[1][0] == "lee" and got[2][0].endswith("@m.test") and got[3] == ["37%"] * 3 and got[5] == ["Oslo"] * 3
    paths = spark.createDataFrame([([["a", "b"], ["c", "d"], ["e"]],)], "p array<array<string>>")
    assert paths.select(generate.merged_paths(F.col("p"), 6).alias("m")).first().m == ["a", "b", "c", "d", "e"]
    assert paths.select(generate.merged_paths(F.col("p"), 2).alias("m")).first().m == ["a", "c", "e"]


def test_further_scores(spark):
    df = spark.createDataFrame([("我 爱你", "我爱他", "a b\nc d", "c d\na x")], "x string, y string, p string, q string")
    row = df.select(metrics.rouge_l_zh("x", "y").alias("zh"), metrics.rouge_lsum("p", "q").alias("sum"), metrics.rouge_l("p", "q").alias("l")).first()
    assert row.zh == pytest.approx(2 / 3) and row.sum == pytest.approx(0.75) and row.l == pytest.approx(0.5)
    vectors = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0]], [[1.0, 0.0]]), ([], [[1.0, 1.0]])], "a array<array<double>>, b array<array<double>>")
    got = [r.v for r in vectors.select(metrics.vector_score("a", "b").alias("v")).collect()]
    assert got[0].precision == pytest.approx(0.5) and got[0].recall == pytest.approx(1.0) and got[0].f1 == pytest.approx(2 / 3) and got[1].f1 == 0.0


def test_subsequence_places():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = (rng.integers(0, 4, rng.integers(0, 9)).tolist() for _ in "ab")
        found = sorted(metrics.subsequence_places(a, b))
        rest = iter(b)
        assert len(found) == metrics.common_subsequence(a, b) and all(a[i] in rest for i in found)
