"""Sampling, generation, assembly, judging and metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptmix.operators import assemble, generate, judge, metrics, sampling


def test_exact_sample(spark):
    df = spark.range(50)
    first = [r.id for r in sampling.exact_sample(df, "id", 7, 1).collect()]
    assert len(set(first)) == 7 and first == [r.id for r in sampling.exact_sample(df.repartition(5), "id", 7, 1).collect()]
    assert sampling.exact_sample(df, "id", 0).count() == 50 and sampling.exact_sample(df, "id", 99).count() == 50


def test_bands(spark):
    rows = [(0.5, 1.0, True), (1.5, 1.0, True), (0.49, 1.0, False), (1.51, 1.0, False)]
    df = spark.createDataFrame(rows, "p double, q double, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", sampling.in_relative_band(F.col("p"), F.col("q"), 2)).collect())
    rows = [(0.201, 0.25, True), (0.2, 0.25, False), (0.3009, 0.25, True), (0.302, 0.25, False)]
    df = spark.createDataFrame(rows, "p double, q double, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", sampling.in_absolute_band(F.col("p"), F.col("q"), 10)).collect())


def test_bigrams(spark):
    df = spark.createDataFrame([("A b a c",), ("a b",), ("one",), ("",), (None,)], "text string")
    assert {(r.prev, r.next): (r.c, round(r.p, 6)) for r in sampling.bigrams(df).collect()} == {("a", "b"): (2, 0.666667), ("b", "a"): (1, 1.0), ("a", "c"): (1, 0.333333)}


@pytest.mark.parametrize("block", [3, 100])
def test_nearest_in_blocks(spark, block):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(20, 4))
    v[5], v[6] = v[4], 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.rank): r.neighbour for r in sampling.nearest(df, 3, block_rows=block).collect()}
    unit = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) == 0, 1, np.linalg.norm(v, axis=1, keepdims=True))
    cos = np.round(unit @ unit.T, 6)
    for i in range(20):
        want = sorted((j for j in range(20) if j != i), key=lambda j: (-cos[i, j], j))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == want


def test_distinct_candidates(spark):
    df = spark.createDataFrame([("k", "a-b", 0, 0.9), ("k", "ab", 1, 0.5), ("k", "AB", 2, 0.4), ("k", "é", 3, 0.1), ("k", "ü", 4, 0.5)], "k string, w string, seq int, p double")
    assert {r.w for r in sampling.distinct_candidates(df, "k", "w", "seq", F.lit(0.5), "p", 2).collect()} == {"AB", "a-b"}
    assert "ab" not in {r.w for r in sampling.distinct_candidates(df, "k", "w", "seq", F.lit(0.5), "p", 9).collect()}
    assert sampling.distinct_candidates(df, "k", "w", "seq", F.lit(0.5), "p", 9).count() == 3


def test_neighbour_words(spark):
    df = spark.createDataFrame([(["red", "car"], [["blue", "green"], ["bus", "van"]], "1")], "w array<string>, p array<array<string>>, k string")
    found = df.select(sampling.neighbour_words(F.col("w"), F.col("p"), 3, F.col("k")).alias("r")).first().r
    assert 1 <= len(found) <= 3 and len(set(found)) == len(found) and all(x.split()[0] in ("blue", "green") for x in found)


def test_rewrites():
    assert generate.rewrite_email("ivo.Petrak@mail.test", "Ann Lee") == "ann.Lee@mail.test"
    fake = generate.rewrite_email("ivo17@mail.test", "Ann")
    assert fake.startswith("ann") and fake.endswith("@mail.test") and fake[3] != "1" and fake[4] != "7"
    assert generate.rewrite_email("a@b.c", "123") == "user@b.c"
    assert generate.replace_root("IVO_petrak", "ivopetrak", "ann lee") == "ann_lee"
    assert generate.replace_root("Ivo Petrak", "ivopetrak", "annelee") == "Ann elee"
    assert generate.replace_root("Zed", "nothere", "bob") == "Bob"
    assert generate.adapt("Petrak", "petrak", "Ann Lee", "ivopetrak") == "Lee" and generate.adapt("Ivo", "ivo", "Ann Lee", "ivopetrak") == "Ann"


def test_soft_chain_reuses_and_adapts():
    spans_ = [{"word": "Ivo Petrak", "type": "NAME"}, {"word": "ivo.petrak@m.test", "type": "EMAIL"}, {"word": "Ivo Petrak", "type": "NAME"}, {"word": "42%", "type": "PERCENT"}]
    out = generate.soft_chain(spans_, [["Ann Lee", "Bo Ray"]] * 4)
    assert out[0] == out[2] == ["Ann Lee", "Bo Ray"] and out[1] == ["ann.lee@m.test", "bo.ray@m.test"] and out[3] == ["37%", "39%"]


def test_finished_pads_and_drops_the_real_word(spark):
    df = spark.createDataFrame([(1, ["a", "b", "b", "c"], "A", [1.0, 0.5, 0.9, 0.9]), (2, ["x"], "x", [1.0]), (3, [], "y", [])], "k int, words array<string>, real string, probs array<double>")
    got = df.orderBy("k").select(generate.finished(F.col("words"), F.col("real"), F.col("probs"), 4).alias("w")).collect()
    assert [r.w for r in got] == [["c", "b", "c", "b"], ["x"] * 4, ["y"] * 4]


def test_position_beam_covers_all_words(spark):
    df = spark.createDataFrame([(1, [["a", "b"], ["c", "d", "e"], [], ["f"]]), (2, [])], "k int, pools array<array<string>>")
    wide = {r.k: sorted(r.p) for r in df.select("k", generate.position_beam(F.col("pools"), F.col("k"), 99).alias("p")).collect()}
    assert wide == {1: sorted([x, y, "f"] for x in "ab" for y in "cde"), 2: [[]]}
    narrow = df.select("k", generate.position_beam(F.col("pools"), F.col("k"), 2).alias("p")).where("k = 1").first().p
    assert len(narrow) == 2 and all(p in wide[1] for p in narrow)


def test_beams_equal_brute_force(spark):
    import hashlib

    texts = ["the cat sat on the mat", "the dog sat on a cat", "a cat saw the dog on the mat and sat", "the mat", "dog"]
    lm = sampling.bigrams(spark.createDataFrame([(t,) for t in texts * 2], "text string"))
    p = {(r.prev, r.next): r.p for r in lm.collect()}
    items = {i: t.split() for i, t in enumerate([*texts, "unseen words here", ""])}
    want = []
    for i, words in items.items():
        now = [([words[0]], 1.0)] if words else []
        for k in range(1, len(words)):
            every = []
            for path, weight in now:
                q = p.get((words[k - 1], words[k]))
                met = [(b, x) for (a, b), x in p.items() if q and a == path[-1] and abs(x / q - 1) <= 0.5]
                every += [([*path, b], weight * x / q) for b, x in met] or [([*path, words[k]], weight)]
            now = sorted(every, key=lambda e: (hashlib.md5(f"42:{k}:{i}:{' '.join(e[0])}".encode()).hexdigest(), e[0]))[:3]
        want += [(i, " ".join(path), round(w, 6)) for path, w in now]
    df = spark.createDataFrame([(i, w) for i, w in items.items()], "id int, w array<string>")
    got = sampling.beams(df, sampling.written(lm), 3, 2)
    assert sorted((r.id, " ".join(r.path), round(r.weight, 6)) for r in got.collect()) == sorted(want)
    padded = sampling.beams(df, lm, 4, 2, reference_first=True, pad=True).groupBy("id").agg(F.count("*").alias("n"), F.min(F.array_join("path", " ")).alias("a")).collect()
    assert {r.id: r.n for r in padded} == dict.fromkeys(range(6), 4)
    stopped = sampling.beams(df, lm, 3, 2, stops=("sat",)).collect()
    assert all("sat" not in r.path[:-1] for r in stopped)


def test_overlaps_equal_counters(spark):
    from collections import Counter

    rng = np.random.default_rng(8)
    rows = [(rng.integers(0, 5, rng.integers(0, 12)).tolist(), rng.integers(0, 5, rng.integers(0, 12)).tolist()) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = df.select(metrics.multiset_overlap(F.col("a"), F.col("b")).alias("n")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        assert r.n == sum((Counter(a) & Counter(b)).values())


def test_trigram_cosine(spark):
    rows = [("abc", "abc"), ("", ""), ("abc", "xyz"), ("ABAB", "abab"), ("aaaa", "aa"), (None, "a")]
    got = [r.c for r in spark.createDataFrame(rows, "a string, b string").select(metrics.trigram_cosine("a", "b").alias("c")).collect()]
    # "  aaaa  " holds each of four border grams once and aaa twice; "  aa  " the border grams alone.
    assert got[:5] == pytest.approx([1, 1, 0, 1, 4 / math.sqrt(8 * 4)]) and got[5] is None


def test_without_nearest_keeps_the_last(spark):
    df = spark.createDataFrame([(1, r) for r in range(1, 41)] + [(2, 1)], "vec_id int, rank int")
    assert sorted(r["rank"] for r in sampling.without_nearest(df, 0.05).where("vec_id = 1").collect()) == list(range(3, 41))
    assert sampling.without_nearest(df, 0.05).where("vec_id = 2").count() == sampling.without_nearest(df, 1.0).where("vec_id = 1").count() == 1


def test_numbered(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("v")).repartition(7)
    assert sorted((r.v, r.place) for r in sampling.numbered(df, ["v"], "place").collect()) == [(i, i) for i in range(100)]
    assert sorted((r.place, r.v) for r in sampling.numbered(df, ["v DESC"], "place", 5).collect()) == [(i, 99 - i) for i in range(5)]
    assert sampling.numbered(df.limit(0), ["v"], "place").count() == 0


def test_assembly(spark):
    ner = "<redacted> A (X) </redacted>, <redacted> B (Y) </redacted>; <redacted> A (X) </redacted>"
    df = spark.createDataFrame([(1, ner, [["a1", "a2"], ["b1"], ["a1", "a2"]]), (2, "plain", [])], "doc_id int, ner string, fakes array<array<string>>")
    got = {(r.doc_id, r.sample_idx): r.text for r in assemble.samples(df, 3).collect()}
    assert got == {(1, 0): "a1, b1; a1", (1, 1): "a2, b1; a2", (1, 2): "a1, b1; a1", (2, 0): "plain"}
    row = df.where("doc_id = 1").withColumn("m", assemble.mapping(df)).select("m", assemble.rebuilt(F.col("ner"), F.col("m"), F.lit(0)).alias("p"), assemble.rebuilt(F.col("ner"), F.col("m"), F.lit(0), "gqs").alias("g")).first()
    assert row.m == {"A": ["a1", "a2"], "B": ["b1"]} and row.p == "a1, b1; a1" and row.g == "a1, b1; a2"


def test_probability_and_order(spark):
    df = spark.createDataFrame([(1, [[0.5, 1.0], [0.5]])], "doc_id int, p array<array<double>>").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("sample_idx"), "p")
    rows = df.withColumn("prob", assemble.probability(F.col("p"), F.col("sample_idx")))
    assert sorted(r.prob for r in rows.collect()) == [0.25, 0.5]
    assert {(r.prob, r.sample_idx) for r in assemble.sorted_index(rows).collect()} == {(0.5, 0), (0.25, 1)}


@pytest.mark.parametrize(
    ("answer", "status", "value"),
    [("2", "answered", 2), ("-1", "undecided", None), ("- 1", "undecided", None), ("1-1", "answered", 1), ("Option 12.", "error", None), ("选项2", "error", None), ("选项一", "answered", 1), ("无法判断", "undecided", None), ("Undecided", "undecided", None), ("0", "error", None), ("10 or 2", "error", None), ("", "error", None), (None, "error", None), ("三", "answered", 3)],
)
def test_answers(spark, answer, status, value):
    row = spark.createDataFrame([(answer,)], "a string").select(judge.parsed_answer(F.col("a"), F.lit(3)).alias("p")).first().p
    assert (row.status, row.predicted) == (status, value)


def test_marker(spark):
    df = spark.createDataFrame([("think</think> 2",), ("2",)], "a string")
    assert [r.x for r in df.select(judge.after_marker(F.col("a"), "</think>").alias("x")).collect()] == [" 2", None]


def test_summaries(spark):
    pairs = [("a", "correct"), ("a", "correct"), ("b", "incorrect"), ("b", "incorrect"), ("c", "correct"), ("c", "incorrect"), ("d", "correct"), ("e", "correct"), ("e", "error")]
    row = judge.pair_summary(spark.createDataFrame(pairs, "pair_id string, outcome string")).first()
    assert (row.pairs, row.correct, row.incorrect, row.undecided, row.missing, row.accuracy, row.undecided_rate) == (5, 1, 1, 3, 1, 0.5, 0.6)
    mixes = spark.createDataFrame([("correct", 2), ("incorrect", 2), ("undecided", 4), ("error", 4)], "outcome string, num_options int")
    row = judge.mix_summary(mixes).first()
    assert (row.incorrect_plus_undecided_rate, row.correct_rate) == (0.666667, 0.333333)
    assert {(r.num_options, r.accuracy) for r in judge.mix_by_size(mixes).collect()} == {(2, 0.5), (4, 0.0)}
    row = judge.mix_summary(mixes.where("outcome = 'error'")).first()
    assert row.correct_rate is None


def test_tasks_and_counters(spark):
    df = spark.createDataFrame([(1, "real", ["f1", "f2", "f3"]), (2, " ", ["f"]), (3, "other", []), (4, "more", ["g"])], "doc_id int, original string, fakes array<string>")
    tasks = judge.pair_tasks(df, 2).collect()
    assert len(tasks) == 6 and all(("----- Option 1 -----\nreal" in t.prompt) == (t.real_option_id == 1) for t in tasks if t.doc_id == 1)
    mixes = judge.mix_tasks(df, 2, combinations=3).collect()
    assert len(mixes) == 3 and all(m.num_options == 3 and f"----- Option {m.real_option_id} -----\nreal" in m.prompt for m in mixes)
    row = judge.counters(df, 1, 1).first()
    assert (row.loaded, row.processed, row.valid, row.skipped) == (4, 1, 1, 0)
    row = judge.counters(df, 1, 9).first()
    assert (row.loaded, row.processed, row.valid, row.skipped) == (4, 4, 2, 2)


def test_metrics(spark):
    assert metrics.sensitive_words(["call", "Ann", "now"], ["CALL", "<PII>", "now"]) == ["Ann"]
    assert metrics.common_subsequence(list("abcbdab"), list("bdcaba")) == 4 and metrics.common_subsequence([], ["a"]) == 0
    assert metrics.rouge_l_f("a b c", "a c d") == pytest.approx(2 / 3) and metrics.rouge_l_f("", "a") == 0.0
    assert metrics.code_similarity("`x\n# c\nfoo(1)", "foo(2)") == 0.83
    df = spark.createDataFrame([("has 3 and 4", "3", "b", ["a", "b", "ab"], "the the cat", "the cat")], "p string, t string, c string, cl array<string>, x string, y string")
    row = df.select(metrics.count_score(F.col("p"), F.col("t")).alias("n"), metrics.retrieval_score(F.col("p"), F.lit("Paragraph 4")).alias("r"), metrics.classification_score(F.lit("ab b"), F.lit("ab"), F.col("cl")).alias("k"), metrics.token_f1(F.col("x"), F.col("y")).alias("f"), metrics.contains_any(F.lit("\nThe Cat sat\nno"), F.array(F.lit("cat"))).alias("c")).first()
    assert (row.n, row.r, row.k, row.f, row.c) == (0.5, 0.5, 1.0, 1.0, 1.0)
    row = spark.range(1).select(metrics.confusion(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")), F.lit(5)).alias("c"), metrics.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("s")).first()
    assert tuple(row.c) == (1, 1, 1, 2) and row.s == pytest.approx(math.sqrt(0.5))


def test_bleu(spark):
    df = spark.createDataFrame([("a b c d e".split(), "a b c d e".split()), ("a b c d".split(), "a b c d x".split())], "c array<string>, r array<string>")
    row = metrics.corpus_bleu(df, "c", "r").first()
    assert row.m1 == 9 and row.bleu == pytest.approx(math.exp(1 - 10 / 9), abs=1e-6)
    assert metrics.corpus_bleu(df.limit(0), "c", "r").first().bleu == 0.0
