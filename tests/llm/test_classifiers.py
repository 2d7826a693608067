"""Language id, toxicity and quality: held-out accuracy on the test tables, bounds, and odd texts."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptmix.llm import langid, quality, queries, toxicity

DIR = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "123 !!"), (4, "x" * 300_000), (5, "a"), (5, "a"), (None, "b")]


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(1))


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = queries.op2_language_id(spark, DIR).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, "the cat sat " * 5, "en") for i in range(9)] + [(20 + i, "der hund lief und " * 5, "de") for i in range(9)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.annotate(odd(spark), model).collect()}
    assert got[1, None] == got[2, ""] == got[3, "123 !!"] == ("und", 0.0) and got[5, "a"][0] in ("de", "en")
    assert langid.annotate(odd(spark), langid.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_binding_tells_order_apart():
    encoder = langid.Encoder()
    vectors = encoder.gram_vectors(np.sort(np.array([0x61 << 42 | 0x62 << 21 | 0x63, 0x63 << 42 | 0x62 << 21 | 0x61], dtype=np.uint64))).astype(int)
    assert abs(vectors[0] @ vectors[1]) < 0.25 * langid.DIMENSIONS and set(np.unique(vectors)) == {-1, 1}


@pytest.mark.parametrize(("name", "label", "modulus", "remainder", "cut", "least"), [("op5_toxicity", "toxic", 5, 0, 0.5, 0.9), ("op9_quality", "quality", 4, 2, 0.7, 0.95)])
def test_held_out_accuracy(spark, name, label, modulus, remainder, cut, least):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, DIR).collect()
    assert len(rows) == 1000 and all(r.held_out == (fold(r.doc_id, modulus) == remainder) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in held]) >= least


def test_toxicity_corrects_for_unlabelled_positives():
    rng = np.random.default_rng(0)
    clean, toxic = (lambda: rng.choice(np.arange(10, 60), 8, replace=False)), (lambda: np.append(rng.choice(np.arange(10, 60), 8, replace=False), rng.integers(0, 3)))
    positive = [np.sort(toxic()) for _ in range(200)]
    unlabelled = [np.sort(toxic() if i % 5 == 0 else clean()) for i in range(1000)]
    words = np.arange(60)
    pack = lambda docs: (np.array([len(d) for d in docs]), np.concatenate(docs))
    model = toxicity.fit(words, pack(positive), pack(unlabelled), 0.2)
    assert min(model.weights.get(i, 0) for i in range(3)) > 1
    assert max(model.weights.get(i, 0) for i in range(10, 60)) < 1


def test_toxicity_of_odd_texts(spark):
    model = toxicity.Model(-2.0, {zlib.crc32(b"bad"): 5.0})
    rows = toxicity.annotate(odd(spark), model).collect()
    assert len(rows) == len(ODD) and len({r.toxicity for r in rows}) == 1
    kept = toxicity.remove_toxic(odd(spark).unionByName(odd(spark).limit(1).withColumn("text", F.lit("BAD, bad"))), model)
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(1, 1)], [(1, None)], [(1, 1), (2, 1)], [(3, 1), (3, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(0 <= r.toxicity < 0.5 for r in toxicity.annotate(docs, model).collect()), labels
        assert toxicity.remove_toxic(docs, model).count() == 2


# Plain versions of the three, over whole tables.

SMALL = "/root/testdata/sf0.001"


def small(spark, *columns):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    return docs, labels


def test_language_query_equals_plain_profiles(spark):
    docs, _ = small(spark)
    letters, bound = {}, {}

    def vector(gram):
        if gram not in bound:
            out = np.ones(langid.DIMENSIONS)
            for place, c in enumerate(gram):
                if c not in letters:
                    letters[c] = langid.letter_vector(ord(c), 20, langid.DIMENSIONS)
                # The first letter is rotated most.
                out = out * np.roll(letters[c], langid.N - 1 - place)
            bound[gram] = out
        return bound[gram]

    def profile(text):
        words = "".join(c if c.isalpha() else " " for c in text or "").lower().split()
        line = f" {' '.join(words)} "
        total = sum((n * vector(g) for g, n in Counter(line[i : i + langid.N] for i in range(len(line) - langid.N + 1)).items()), np.zeros(langid.DIMENSIONS)) if words else None
        return None if total is None else total / np.linalg.norm(total)

    profiles = {i: profile(r.text) for i, r in docs.items()}
    prototypes = {}
    for i, r in docs.items():
        if fold(i, 4) != 2 and r.lang is not None and profiles[i] is not None:
            prototypes[r.lang] = prototypes.get(r.lang, 0) + profiles[i]
    names = sorted(prototypes)
    rows = {r.doc_id: r for r in queries.op2_language_id(spark, SMALL).collect()}
    for i, p in profiles.items():
        if p is None:
            assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
            continue
        cosines = np.array([prototypes[n] @ p / np.linalg.norm(prototypes[n]) for n in names])
        soft = np.exp(langid.SHARPNESS * (cosines - cosines.max()))
        assert rows[i].lang_pred == names[int(cosines.argmax())] and rows[i].score == pytest.approx(soft.max() / soft.sum(), abs=1e-4)


def test_toxic_risk_and_its_derivatives():
    rng = np.random.default_rng(3)
    for shift in (0.0, -6.0):  # the clean term is positive, then negative
        fp, fu = rng.normal(1, 1, 7), rng.normal(shift, 1, 9)
        gp, gu = toxicity.step(fp, fu, 0.4)
        negative = toxicity.risk(fp, fu, 0.4)[1] < 0
        assert negative == (shift < 0)
        whole = lambda p, u: -toxicity.risk(p, u, 0.4)[1] if negative else sum(toxicity.risk(p, u, 0.4))  # noqa: B023, E731
        for x, g in ((fp, gp), (fu, gu)):
            for i in range(len(x)):
                values = []
                for d in (1e-5, -1e-5):
                    old = x[i]
                    x[i] += d
                    values.append(whole(fp, fu))
                    x[i] = old
                assert (values[0] - values[1]) / 2e-5 == pytest.approx(g[i], abs=1e-6)


def test_toxicity_query_equals_plain_training(spark):
    docs, labels = small(spark)

    def features(text):
        words = set("".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127 else " " for c in (text or "").translate({k: k + 32 for k in range(65, 91)})).split(" ")) - {""}
        return {h for w in words for h in [zlib.crc32(w.encode()), *(zlib.crc32(w[:k].encode(), 1) for k in (4, 5, 6) if len(w) > k)]}

    of = {i: features(r.text) for i, r in docs.items()}
    use = {i for i in docs if fold(i, 5) != 0}
    known = {i: r.toxic for i, r in labels.items() if fold(i, 5) != 0 and r.toxic is not None}
    once = lambda ids: list({(i, docs[i].text): i for i in ids}.values())
    positive, unlabelled = once(i for i in use if known.get(i) == 1), once(use)
    count = Counter(h for i in positive for h in of[i])
    need = max(1, min(toxicity.MIN_POSITIVES, len(positive) // 4))
    names = sorted(h for h, n in count.items() if n >= need)
    assert 0 < len(names) < toxicity.MAX_FEATURES
    xp, xu = (np.array([[float(h in of[i]) for h in names] for i in ids]) for ids in (positive, unlabelled))
    prior = np.mean(list(known.values()))
    w, b, m, v = np.zeros(len(names)), np.log(prior / (1 - prior)), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    sig = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, toxicity.EPOCHS + 1):
        fp, fu = xp @ w + b, xu @ w + b
        clean = np.log1p(np.exp(fu)).mean() - prior * np.log1p(np.exp(fp)).mean()
        gp, gu = -prior * sig(fp) / len(fp), sig(fu) / len(fu)
        gp, gu = (gp - prior * sig(-fp) / len(fp), gu) if clean >= 0 else (-gp, -gu)
        g = np.append(xp.T @ gp + xu.T @ gu, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        size = np.sqrt(v / (1 - 0.999**t)) + 1e-4
        move = 0.1 * m / (1 - 0.9**t) / size
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - 0.1 * toxicity.L1 / size[:-1])
    rows = {r.doc_id: r for r in queries.op5_toxicity(spark, SMALL).collect()}
    for i in docs:
        assert rows[i].score == pytest.approx(sig(b + sum(x for h, x in zip(names, w, strict=True) if h in of[i])), abs=1e-3)


def test_quality_query_equals_plain_densities(spark):
    docs, labels = small(spark)
    train = [(quality.features(docs[i].text), r.quality) for i, r in labels.items() if fold(i, 4) != 2 and r.quality is not None and i in docs]
    parts = [np.array([x for x, y in train if y == k]) for k in (0, 1)]
    spread = lambda p: sum(np.outer(x - p.mean(0), x - p.mean(0)) for x in p) / len(p)
    pooled = sum(spread(p) * len(p) for p in parts) / len(train)
    covs = [(1 - quality.TO_IDENTITY) * ((1 - quality.TO_POOLED) * spread(p) + quality.TO_POOLED * pooled) + quality.TO_IDENTITY * np.diag(np.diag(pooled) + 1e-6) for p in parts]
    rows = {r.doc_id: r for r in queries.op9_quality(spark, SMALL).collect()}
    for i, r in docs.items():
        x = np.array(quality.features(r.text))
        score = [np.log(len(p) / len(train)) - 0.5 * (x - p.mean(0)) @ np.linalg.solve(c, x - p.mean(0)) - 0.5 * np.linalg.slogdet(c)[1] for p, c in zip(parts, covs, strict=True)]
        assert rows[i].score == pytest.approx(1 / (1 + np.exp(np.clip(score[0] - score[1], -30, 30))), abs=1e-6)


def test_quality_statistics_of_a_text():
    text = "Ab, ab! x1\nAb, é?\nx1"
    got = quality.features(text)
    odds = lambda part, whole: np.log((part + 0.5) / (whole - part + 0.5))
    assert got == pytest.approx([np.log1p(20), np.log(16 / 7), odds(2, 9), odds(2, 20), odds(4, 20), odds(0, 20), odds(2, 20), odds(1, 9), odds(4, 6), odds(2, 6), odds(3, 3), np.log(7)])


def test_a_rare_language_is_learnt_beside_a_common_one(spark):
    docs = spark.createDataFrame([(i, f"the cat sat on mat {i}", "en") for i in range(400)] + [(1000 + i, f"der hund lief und sprang {i}", "de") for i in range(3)], "doc_id long, text string, lang string")
    assert langid.train(docs, max_rows=20).names == ["de", "en"]


def test_hot_ids_and_contradictions_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"bad word{i} text") for i in range(600)] + [(2 + i, f"fine words {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), *[(2 + i, i % 2, 0) for i in range(60)]], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, max_positive=40, max_unlabelled=40)
    assert 0 < toxicity.annotate(docs, model).where("toxicity >= 0.5").count()
    assert len(quality.train(docs, labels, max_rows=200).means) == 2
    assert quality.train(docs, labels.unionByName(labels)).log_prior == quality.train(docs, labels.orderBy("quality")).log_prior


def test_quality_of_odd_texts_and_one_class(spark):
    one = quality.fit(np.zeros((3, 12)), np.array([1, 1, 1]))
    assert {r.quality_score for r in quality.annotate(odd(spark), one).collect()} == {1.0}
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 1, (200, 12)), rng.normal(2, 3, (200, 12))))
    y = np.repeat([1, 0], 200)
    model = quality.fit(x, y)
    p = 1 / (1 + np.exp(-model.log_odds(x)))
    assert ((p > 0.5) == (y == 1)).mean() > 0.95


def test_log_density_is_gaussian():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 12)), np.array([0, 1] * 25)
    model = quality.fit(x, y)
    point = rng.normal(size=(1, 12))
    want = []
    for mean, factor, prior in zip(model.means, model.factors, model.log_prior, strict=True):
        cov, d = factor @ factor.T, point[0] - mean
        want.append(prior - 0.5 * d @ np.linalg.inv(cov) @ d - 0.5 * np.linalg.slogdet(cov)[1])
    assert model.log_odds(point)[0] == pytest.approx(want[1] - want[0])
