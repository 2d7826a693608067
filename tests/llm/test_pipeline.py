"""The corpus pipeline: stages one by one on planted rows, odd tables, and the whole."""

import corpus_pipeline as pipeline
import pytest

DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)], COLUMNS)


def test_stages():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]


def test_each_stage_on_planted_rows(spark):
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").first().text
    clean = " ".join(f"word{i}" for i in range(40))
    texts = [clean, clean, f"before {item} after", "the token = abcdef123456 here", None, "", "you idiot moron scum trash loser clown stupid"]
    docs = documents(spark, texts)
    stage = dict(pipeline.STAGES)
    kept = lambda name: {r.doc_id for r in stage[name](spark, docs, DIR).collect()}
    assert kept("near_duplicates") == {0, 2, 3, 4, 5, 6}
    assert kept("decontamination") == {0, 1, 3, 4, 5, 6}
    masked = {r.doc_id: r for r in stage["secrets"](spark, docs, DIR).collect()}
    assert masked[3].text == "the [SECRET] here" and masked[3].n_chars == 17 and masked[4].text is None and masked[0].text == clean
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = docs.selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "source", "n_chars")
    left = {r.doc_id - 1000000 for r in stage["toxicity"](spark, known.unionByName(more), "/root/testdata/sf0.01").where("doc_id >= 1000000").collect()}
    assert left == {0, 1, 2, 3, 4, 5}
    for name in list(stage)[:-1]:
        assert stage[name](spark, docs, DIR).schema.simpleString() == docs.schema.simpleString()
    coded = {r.doc_id: r for r in stage["tokens"](spark, docs, DIR).collect()}
    assert coded[4].ids == coded[5].ids == [] and coded[0].n_tokens == len(coded[0].ids) > 40


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_empty_tables_pass(spark, name):
    assert dict(pipeline.STAGES)[name](spark, documents(spark, ["x"]).limit(0), DIR).count() == 0


def test_whole(spark):
    rows = pipeline.run(spark, DIR).collect()
    assert 100 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)
