"""Decontamination and the n-gram Jaccard join against brute force, with the odd cases."""

import random

import pytest
from pyspark.sql import functions as F

from promptmix.llm import decontaminate, neardup
from promptmix.llm.common import words_of

SCHEMA = "doc_id long, text string, lang string"


def documents(spark, texts, partitions=3):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA).repartition(partitions)


def test_words():
    assert words_of("Ab-c É_x 9\x7fz") == [b"ab", b"c", "É".encode(), b"x", b"9", b"z"] and words_of(None) == []


@pytest.mark.parametrize("window", [2, 3, 10])
@pytest.mark.parametrize("seed", range(8))
def test_suffix_arrays_find_what_brute_force_finds(seed, window):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5)]
    items = [(str(i), " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 15, 30])))) for i in range(5)]
    texts = [" ".join(rng.choices([*words, "zz"], k=rng.choice([0, 5, 60]))) for _ in range(8)] + [None, "", f"{items[4][1]} x {items[3][1]}"]
    needles = decontaminate.Needles([(a, words_of(b)) for a, b in items], window)
    got = decontaminate.search_shard(needles, texts)
    want = decontaminate.brute_force(texts, items, window)
    for g, w, text in zip(got, want, texts, strict=True):
        assert (g[0], sum(e - s for s, e in g[1]), len(g[2])) == w[:3]
        assert (g[3], needles.names[g[4]] if g[3] else None, g[5]) == longest(text, items, window)


def longest(text, items, window):
    """The longest match of at least a window, the first in the text, of the first item; by trying all of them."""
    words, best = words_of(text), (0, None, -1)
    for p in range(len(words)):
        for name, item in items:
            held = words_of(item)
            for j in range(len(held)):
                k = 0
                while p + k < len(words) and j + k < len(held) and words[p + k] == held[j + k]:
                    k += 1
                if k > best[0] and k >= min(window, len(held)):
                    best = (k, name, p)
    return best


def test_spans_agree_as_far_as_words_do():
    import numpy as np

    rng = np.random.default_rng(6)
    a, b = rng.integers(1, 4, 200), rng.integers(1, 4, 90)
    i, j = rng.integers(0, 200, 500), rng.integers(0, 90, 500)
    got = decontaminate.agreement(decontaminate.Spans(a), i, decontaminate.Spans(b), j, np.zeros(500, dtype=np.int64), np.minimum(200 - i, 90 - j))
    for x, y, n in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
        k = 0
        while x + k < 200 and y + k < 90 and a[x + k] == b[y + k]:
            k += 1
        assert k == n


def test_suffix_array_order():
    import numpy as np

    rng = np.random.default_rng(1)
    ids = rng.integers(1, 3, 60)
    order = decontaminate.suffix_array(ids, 64)
    assert order.tolist() == sorted(range(60), key=lambda i: ids[i:].tolist())


def test_longest_match_and_blocks(spark):
    item = " ".join(f"b{i}" for i in range(14))
    texts = ["x " + " ".join(item.split()[:12]) + " y", item, None, "", "clean text here", item]
    bench = spark.createDataFrame([(7, item), (8, "short item"), (9, ""), (10, None), (11, item)], "item_id long, text string")
    docs = documents(spark, [*texts, "a short item b"])
    one = {r.doc_id: r for r in decontaminate.annotate(docs, bench).collect()}
    many = {r.doc_id: r for r in decontaminate.annotate(docs, bench, block_words=5).collect()}
    assert (one[0].longest_match, one[0].longest_item, one[0].longest_start, one[0].n_hit) == (12, "7", 1, 12)
    assert one[1].items == ["11", "7"] and one[6].items == ["8"] and one[6].n_hit == 2 and one[2].n_words == one[3].n_words == one[4].n_hit == 0
    for i, row in one.items():
        assert (row.n_words, row.n_hit, row.items, row.longest_match) == (many[i].n_words, many[i].n_hit, many[i].items, many[i].longest_match)


def test_null_and_repeated_ids_at_any_benchmark_size(spark, monkeypatch):
    items = [(9, "a b c d"), (None, "e f g"), (3, "a b x y"), (4, "p q")]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    docs = spark.createDataFrame([(None, "1 a b c d 2"), (5, "e f g here"), (5, "clean"), (5, "p q and a b x y"), (None, None), (6, "clean"), (7, "1 a b c d 2")], "doc_id long, text string").repartition(3)
    row = lambda r: (r.doc_id, r.text, r.n_words, r.n_hit, r.items, r.longest_match, r.longest_item, r.longest_start, r.hit_spans)
    found = [sorted((row(r) for r in decontaminate.annotate(docs, bench, window=4, block_words=n).collect()), key=repr) for n in (100, 4)]
    assert found[0] == found[1]
    by_text = {r[1]: r for r in found[1]}
    want = decontaminate.brute_force(list(by_text), [(str(i), t) for i, t in items], 4)
    assert [(r[2], r[3], len(r[4])) for r in by_text.values()] == [w[:3] for w in want]
    assert by_text["e f g here"][4] == [None] and by_text["clean"][3] == 0 and len(found[1]) == 7
    monkeypatch.setattr(decontaminate, "BLOCKS_A_STAGE", 2)
    for n in (100, 4):
        kept = decontaminate.remove_contaminated(docs, bench, window=4, block_words=n).collect()
        assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == [(5, "clean"), (6, "clean"), (None, None)]


def test_removal_keeps_columns_and_clean_rows(spark):
    item = " ".join(f"b{i}" for i in range(12))
    docs = documents(spark, [item, "clean", None]).withColumn("n_hit", F.lit("mine")).withColumn("items", F.lit(1))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.n_hit, r["items"]) for r in kept.collect()) == [(1, "mine", 1), (2, "mine", 1)]
    assert decontaminate.annotate(docs, bench).count() == 3  # clashing names give way
    assert decontaminate.remove_contaminated(docs.limit(0).select("doc_id", "text"), bench).count() == 0
    assert decontaminate.remove_contaminated(docs.select("doc_id", "text"), bench.limit(0)).count() == 3


def test_chosen_path_recall_is_what_is_asked_for():
    assert neardup.lost(0) == 0.0 and neardup.lost(1) == pytest.approx(0.75 * 0.2 + 0.25 * 0.04)
    runs = neardup.runs_needed(0.99, 6)
    assert neardup.recall(runs, 6) >= 0.99 > neardup.recall(runs - 1, 6)
    with pytest.raises(ValueError):
        neardup.runs_needed(0.99999999)


@pytest.mark.parametrize("depth", [2, 4, 6])
def test_measured_recall_by_similarity(depth):
    """Pairs of signatures of known similarity, sent down the paths of all runs."""
    import numpy as np

    rng = np.random.default_rng(depth)
    runs = neardup.runs_needed()
    for similarity in (0.8, 0.9):
        found, tried = 0, 400
        for _ in range(tried):
            common = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
            own = round(80 * (1 - similarity) / (2 * similarity))
            sets = [np.append(common, rng.integers(0, 1 << 63, own, dtype=np.uint64)) for _ in range(2)]
            signature = neardup.signatures(sets)
            both = [set(neardup.descend(neardup.roots(runs), np.tile(s, (runs, 1)), 0, depth)[1].tolist()) for s in signature]
            found += bool(both[0] & both[1]) and (signature[0] == signature[1]).mean() >= neardup.LIKELY
        assert found >= tried * 0.985


def test_intersections_equal_sets():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 30))).astype(np.uint64) for _ in range(12)]
    both = neardup.intersections(sets, width=7)
    for i in range(12):
        for j in range(12):
            if i != j:
                assert both[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist()))


def variants(rng, base, n):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        out.append(" ".join(words))
    return out


def test_join_equals_brute_force(spark):
    rng = random.Random(4)
    texts = variants(rng, [f"w{i}" for i in range(70)], 40) + variants(rng, [f"v{i}" for i in range(90)], 25)
    texts += ["", "", None, None, "a b", "A b", "!!", "!!", "?"] + [" ".join(rng.choices([f"q{i}" for i in range(300)], k=40)) for _ in range(30)]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in neardup.join(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == neardup.brute_force(texts)


@pytest.mark.parametrize("bound, value", [("BUCKET", 15), ("BLOCK_RUNS", 1_500)])
def test_large_buckets_meet_in_blocks(spark, monkeypatch, bound, value):
    monkeypatch.setattr(neardup, bound, value)
    rng = random.Random(5)
    texts = variants(rng, [f"w{i}" for i in range(120)], 70)
    got = {r.doc_id: r for r in neardup.join(documents(spark, texts)).collect()}
    want = neardup.brute_force(texts)
    assert {g.class_id for g in got.values()} == {w[0] for w in want}
    assert sum(g.n_links for g in got.values()) >= 0.99 * sum(w[1] for w in want)


def test_near_copies_share_few_buckets(spark, monkeypatch):
    """The rows sent to pairs of blocks: about those of one bucket, not of every path that near copies share."""
    monkeypatch.setattr(neardup, "BUCKET", 15)
    rng = random.Random(5)
    texts = variants(rng, [f"w{i}" for i in range(120)], 70)
    records = neardup._records(documents(spark, texts), "doc_id", "text").dropDuplicates(["key"]).select("key", "n", "signature")
    found = neardup._buckets(records, neardup.runs_needed())
    rows, keys, placed = found.select(F.sum("blocks"), F.countDistinct("key"), F.count("*") - F.countDistinct("path", "key")).first()
    assert keys == records.count() and placed == 0
    assert rows <= 3 * keys * -(-keys // 15)


def test_one_of_each_class_stays(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), "other text of its own words", " ".join(base[:-1]), " ".join(base), None, None, "", ""]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 0"))  # a repeated row
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 4, 5, 6]
    assert neardup.one_of_each(docs.unionByName(docs.where("doc_id = 4"))).where("doc_id = 4").count() == 2  # null texts stay
    assert sorted(r.doc_id for r in neardup.one_of_each(docs.withColumn("doc_id", F.concat(F.lit("id-"), "doc_id"))).collect()) == ["id-0", "id-1", "id-4", "id-5", "id-6"]
    assert neardup.one_of_each(docs.limit(0)).count() == 0


def test_repeated_ids_with_other_texts_stay_apart(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (1, "a b c d e f"), (None, "k l m n o p")], "doc_id long, text string")
    rows = neardup.join(docs).collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in rows) == [(0, 0), (1, 0), (1, 1), (1, 1)]
    assert neardup.one_of_each(docs).count() == 3


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(30)] + [("90", "91")], "key string, root string")
    got = {r.node: r.least for r in neardup.components(edges).collect()}
    assert got == {f"{i:02d}": "00" for i in range(1, 31)} | {"91": "90"}
