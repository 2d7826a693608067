"""What is made in arrays over a batch equals what is made one by one."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptmix.functions import digits, rules
from promptmix.operators import assemble, judge, metrics, overlaps, sampling, spans
from promptmix.plans import pipeline

WORDS = ["a", "b", "The", "the", "cat", "x-1", "$3,4.", "é", "Q?", "  ", "\t", "y\ng", "Customer#000001"]


def test_shifted_lists():
    draw = random.Random(1)
    shapes = ["Customer#%09d", "NATION_%d", "%d", "May %d, 1998", "é%d", "x" * 60 + "%d", "no%dz"]
    words = [draw.choice(shapes) % draw.randrange(10**6) for _ in range(500)] + ["", "none"]
    docs = [str(draw.randrange(10**7)) for _ in words[1:]] + [None]
    for n in (5, 11):
        wanted = [rules.shifted(w, hashlib.md5("|".join(x for x in (d, w, str(j)) if x is not None).encode()).hexdigest()) for w, d in zip(words, docs, strict=True) for j in range(n)]
        assert digits.variants(pa.array(words), pa.array(docs, pa.string()), n).to_pylist() == wanted


@pytest.mark.parametrize("kind", ["normal", "plain"])
def test_overlaps_equal_single_pairs(kind):
    draw = random.Random(2)
    make = lambda n: draw.choice(["  ", " "]).join(draw.choice(WORDS) for _ in range(draw.choice([0, 1, 2, 3, 5, 9, 20, n])))
    originals = ["\x1c a", "z" * 300 + " a", *[make(90) for _ in range(200)]]
    of = np.repeat(np.arange(len(originals)), 3)
    texts = [make(70) if draw.random() < 0.3 else originals[i].replace("a", "b", 1) for i in of]
    counts, means = overlaps.pairs(pa.array(texts), pa.array(originals), of, kind, kind == "plain", 4)
    single = [overlaps.one_pair(x, originals[i], kind, kind == "plain") for x, i in zip(texts, of, strict=True)]
    assert counts.tolist() == [c for c, _ in single]
    assert np.abs(means - np.array([m for _, m in single])).max() < 1e-12


def test_records_sum_within_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e", ["a b c d e", "a b c d"]), (2, "x", []), (3, None, ["x"])], "id int, o string, v array<string>")
    row = metrics.records_bleu(df, "o", "v").first()
    assert (row.c_len, row.r_len, row.m1, row.m4) == (9, 10, 9, 3)
    assert [tuple(r) for r in metrics.records_f1(df, "o", "v", "id").collect()] == [(1, pytest.approx((1 + 8 / 9) / 2, abs=1e-6), 2)]
    assert metrics.similarity_row(df, "v", "o").first().recall == pytest.approx(0.9)


def test_texts_of_all_samples(spark):
    rows = [(1, "Hi <redacted> Ann (PERSON) </redacted>,  <redacted> 7 (ID) </redacted> and <redacted> Ann (PERSON) </redacted>.", [["Bo", "Cy"], [], ["Bo", "Di"]]), (2, "plain", []), (3, None, None), (4, "<redacted> é (ID) </redacted>", [["1", "2", "3"]])]
    df = spark.createDataFrame(rows, "doc_id int, ner string, fakes array<array<string>>")
    for mode in ("progressive", "gqs"):
        some = df.where("ner is not null").withColumn("m", assemble.mapping(df))
        wanted = {r.doc_id: r.t for r in some.select("doc_id", F.array(*[assemble.rebuilt(F.col("ner"), F.col("m"), F.lit(i), mode) for i in range(4)]).alias("t")).collect()} | {3: None}
        assert {r.doc_id: r.t for r in df.select("doc_id", assemble.all_rebuilt(F.col("ner"), F.col("fakes"), 4, mode).alias("t")).collect()} == wanted
    chosen = lambda i: F.transform("fakes", lambda w: assemble.fake_of(w, F.lit(i)))
    full = df.where("doc_id <> 1")
    wanted = [r.t for r in full.where("ner is not null").select(F.array(*[spans.spliced(F.col("ner"), chosen(i)) for i in range(4)]).alias("t")).collect()]
    assert [r.t for r in full.select(assemble.variants(F.col("ner"), F.col("fakes"), 4).alias("t")).collect() if r.t] == wanted


def test_counters_make_the_records_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"text {i}"

    records = spark.range(50).select(F.col("id").alias("doc_id"), text("id").alias("original"), F.array(F.lit("f")).alias("fakes"))
    row = judge.counters(records, 1, 10).first()
    assert (row.loaded, row.processed, row.valid, row.skipped) == (50, 10, 10, 0) and made.value == 50


def test_long_texts_meet_without_a_fold(spark):
    rows = [(1, "a b a " * 2000, "b a a c " * 1500), (2, "", "x"), (3, None, "x")]
    made = pipeline.evaluate(spark.createDataFrame(rows, "doc_id int, text string, original_text string"))
    assert "lambdafunction" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: r.rouge1 for r in made.collect()}
    assert got == {1: pytest.approx(2 * 4500 / 12000, abs=1e-6), 2: 0.0, 3: 0.0}


def test_beams_keep_candidates_at_the_edge_of_the_band(spark):
    # Ratios of counts that are 1.5 as a ratio, though q * 1.5 is less than p.
    edge = next((c / t, d / u) for t in range(1, 60) for u in range(1, 60) for c in range(1, t) for d in range(1, u) if abs(c / t / (d / u) - 1) <= 0.5 and c / t > d / u * 1.5)
    lm = spark.createDataFrame([("a", "b", edge[1]), ("a", "x", edge[0])], "prev string, next string, p double")
    texts = spark.createDataFrame([(1, ["a", "b"])], "id int, w array<string>")
    assert sorted(tuple(r.path) for r in sampling.beams(texts, lm, 9, 2).collect()) == [("a", "b"), ("a", "x")]


def test_beams_meet_lists_where_they_lie(spark):
    lm = spark.createDataFrame([("z", f"x{i}", 1 / 600) for i in range(600)] + [("y", "z", 1.0)], "prev string, next string, p double")
    model = sampling.laid_out(lm)
    sizes = [r.n for r in model.where("prev = 'z'").selectExpr("size(nexts) n").collect()]
    assert sum(sizes) == 600 and 1 < len(sizes) < 10  # words of one probability are met as lists, long lists in parts
    paths = spark.createDataFrame([(1, ["z", "x1"], [1 / 600], ["z"], "z", 1.0, 0, 1, "x1", 1 / 600)], "id int, w array<string>, qs array<double>, path array<string>, last string, weight double, n long, k int, word string, q double")
    plan = sampling.beam_step(paths, model, 8, 2, 42, True, 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(prev" not in plan and "Window" not in plan


def test_beams_of_repeated_and_missing_ids(spark):
    names = [f"x{i}" for i in range(600)]
    lm = spark.createDataFrame([("z", x, 1 / 600) for x in names] + [("y", "z", 1.0)], "prev string, next string, p double")
    texts = spark.createDataFrame([(1, ["z", "x3"]), (1, ["z", "x4"]), (2, ["y", "z", "x5"]), (2, ["u"]), (None, ["z", "x6"])], "id int, w array<string>")

    def drawn(key, paths):
        return sorted(paths, key=lambda p: (hashlib.md5(f"42:{key}:{p}".encode()).hexdigest(), p))[:8]

    # As in the SQL: texts of one id share its paths; without an id there is no hash, and paths come in their order.
    want = [(1, p) for p in drawn("1:1", [f"z {x}" for x in names] * 2)] + [(2, p) for p in drawn("2:2", [f"y z {x}" for x in names])] + [(2, "u")]
    want += [(None, p) for p in sorted(f"z {x}" for x in names)[:8]]
    for few in (True, False):
        got = [(r.id, " ".join(r.path)) for r in beams_with(few, texts, lm).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def beams_with(few, texts, lm):
    """The beams with paths sent to the model's lists, or joined with them because they are too many to be sent."""
    kept = sampling.SENT_BYTES
    try:
        sampling.SENT_BYTES = kept if few else 0
        return sampling.beams(texts, lm, 8, 2)
    finally:
        sampling.SENT_BYTES = kept
