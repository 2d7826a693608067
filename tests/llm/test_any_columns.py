"""Every operator and stage over columns that clash with its own, names with dots, text ids, nulls and repeated rows."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from promptmix.llm import bpe, decontaminate, fingerprint, html, langid, lm, neardup, quality, queries, secret_scan, toxicity

DIR = "/root/testdata/sf0.001"
NAMES = ["spans", "base_spans", "n_assign", "items", "n_words", "n_hit", "score", "text_hash", "id", "kept", "state", "__row", "__text", "__hash", "bucket", "path", "key", "a.b", "n_tokens", "fingerprint"]
TEXTS = [None, None, "", "", "one two three four five six", "one two three four five six", "token = abcdef12", "x" * 5000, "a b\nc d", "é ß 😀"]


def table(spark, ids):
    name = {"text": lambda i: None if i == 9 else f"id-{i // 2}", "number": lambda i: None if i == 9 else i // 2}[ids]
    rows = spark.createDataFrame([(name(i), t, "en", "s", 3) for i, t in enumerate(TEXTS)], f"doc_id {'string' if ids == 'text' else 'long'}, text string, lang string, source string, n_chars long")
    return rows.select("*", *[F.lit(f"mine {n}").alias(n) for n in NAMES])


def mine(rows, names):
    return all(r[n] == f"mine {n}" for r in rows for n in names)


@pytest.mark.parametrize("ids", ["text", "number"])
def test_operators(spark, ids):
    docs = table(spark, ids)
    bench = spark.createDataFrame([(None, "one two three four"), ("q", "zzz")], "item_id string, text string")
    labels = docs.selectExpr("doc_id", "0 as toxic", "1 as quality")
    rules = bpe.Rules(queries.tokenizer_path())
    found = {
        "secrets": secret_scan.annotate(docs),
        "language": langid.annotate(docs, langid.train(docs)),
        "matches": decontaminate.annotate(docs, bench),
        "toxic": toxicity.annotate(docs, toxicity.train(docs, labels)),
        "tokens": bpe.encode_table(docs, rules, bpe.compile_lexicon(rules, bpe.frequent_words(docs))),
        "copies": neardup.join(docs),
        "fingerprints": fingerprint.with_next(docs),
        "quality": quality.annotate(docs, quality.train(docs, labels)),
    }
    counts = lm.count(docs)
    found["model"] = lm.score(docs, counts, lm.train_tree(counts))
    pages = docs.withColumn("url", F.lit("https://h.test/a")).withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html")
    found["pages"] = html.extract(pages)
    for name, df in found.items():
        assert len(df.collect()) == len(TEXTS), name
        assert sorted(df.columns) == sorted({c.lower(): c for c in df.columns}.values()), name
    for name in ("secrets", "language", "matches", "toxic", "quality", "tokens"):
        assert mine(found[name].collect(), ["a.b", "bucket", "key", "id"]), name


@pytest.mark.parametrize("ids", ["text", "number"])
@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages(spark, ids, name):
    docs = table(spark, ids)
    rows = dict(pipeline.STAGES)[name](spark, docs, DIR)
    got = rows.collect()
    if name == "tokens":
        assert mine(got, ["a.b", "spans", "bucket"]) and len(got) == len(TEXTS) and "text" not in rows.columns
        return
    assert rows.columns == docs.columns and mine(got, NAMES)
    assert len(got) == (8 if name == "near_duplicates" else len(TEXTS))
    assert sum(r.text is None for r in got) == 2


@pytest.mark.parametrize("labels", ["", "SELECT 1 AS doc_id, CAST(NULL AS INT) AS toxic", "SELECT doc_id, 1 AS toxic FROM documents", "SELECT doc_id, 0 AS toxic FROM documents"])
def test_labels_that_teach_nothing_remove_nothing(spark, tmp_path, labels):
    documents = spark.read.parquet(f"{DIR}/documents.parquet")
    documents.createOrReplaceTempView("documents")
    found = spark.sql(labels) if labels else spark.read.parquet(f"{DIR}/labels.parquet").limit(0)
    found.write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.drop_toxic(spark, documents, str(tmp_path)).count() == documents.count()


def test_the_whole_without_labels_or_benchmark(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{DIR}/{name}.parquet")
        (rows if name == "documents" else rows.limit(0)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert 100 < pipeline.run(spark, str(tmp_path)).count() <= 200
