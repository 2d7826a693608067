"""The corpus pipeline: five stages over the documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

* toxicity: documents that the classifier scores 0.5 or more go; the rest stay as they are. Labels that do not hold both
  kinds teach nothing, so nothing goes.
* near_duplicates: of each class of documents linked by word-run similarity, the least id stays; null texts all stay.
* decontamination: documents that hold a window of a benchmark item go.
* secrets: every span found in a text is replaced by a mark, and n_chars follows.
* tokens: the ids of each text, encoded with a lexicon of the words frequent in what is left, beside all columns but text.

Empty tables, of documents, labels or benchmark, pass through every stage; null texts are scored as empty ones, stay, and
have no tokens. Ids may be null, repeated, or of any type; further columns are kept, whatever their names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmix.llm import bpe, decontaminate, neardup, secret_scan, toxicity
from promptmix.llm.common import named, shared_folder, table
from promptmix.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.mask(docs)
    length = lambda c: F.coalesce(F.length("text").cast(docs.schema[c].dataType), named(c)).alias(c)
    return masked.select(*[length(c) if c == "n_chars" else named(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = bpe.Rules(tokenizer_path())
    image = bpe.compile_lexicon(rules, bpe.frequent_words(docs))
    coded = bpe.encode_table(docs, rules, image, keep=[c for c in docs.columns if c != "text"])
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", encode),
]

#: Trained classifiers, minhash paths and tokenizer files are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. What lies between them is written to the shared folder; a stage's input goes when
    its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                place = spark._jvm.org.apache.hadoop.fs.Path(before)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            before = path
    return docs
