"""The three-stage pipeline over prompts: recognise, generate, evaluate; each stage may be written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.held import held
from ..operators import assemble, metrics, spans
from ..streaming.redact import redact


def recognise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", recogniser=None) -> DataFrame:
    """id, original_text, ner_formatted_text."""
    rows = redact(df.select(id_col, text_col), text_col, "ner_formatted_text", recogniser)
    return rows.select(id_col, F.col(text_col).alias("original_text"), "ner_formatted_text")


def generate(ner: DataFrame, n: int = 5, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Adds fakes (for each span) and real_to_fake_mapping. Rules give the candidates, and words that no rule knows get
    other digits, or are kept; every list is filled up in turn when samples are taken."""
    one = lambda w, t: rules.candidates(w, t, n, seed) or rules.candidates(w, "ID", n, seed) or [w]
    fakes = spans.by_row(lambda found: [one(s["word"], s["type"]) for s in found], "array<array<string>>")
    rows = ner.where(spans.has_spans(F.col("ner_formatted_text"))).withColumn("fakes", fakes(spans.parsed(F.col("ner_formatted_text"))))
    return held(rows, real_to_fake_mapping=assemble.mapping(rows, "ner_formatted_text"))


def samples(generated: DataFrame, n: int = 5, mode: str = "progressive", id_col: str = "doc_id") -> DataFrame:
    """id, sample_idx, original_text, text."""
    each = generated.select(id_col, "original_text", "ner_formatted_text", "real_to_fake_mapping", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_idx"))
    return each.select(id_col, "sample_idx", "original_text", assemble.rebuilt(F.col("ner_formatted_text"), F.col("real_to_fake_mapping"), F.col("sample_idx"), mode).alias("text"))


def evaluate(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, samples, mean ROUGE-1 and ROUGE-L of the samples against the original."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\S+"), F.lit(0))
    made = held(made, a=words("text"), b=words("original_text"))
    each = made.select(id_col, F.coalesce(metrics.long_overlap_f(F.col("a"), F.col("b")), F.lit(0.0)).alias("r1"), metrics.rouge_l(F.lower("text"), F.lower("original_text")).alias("rl"))
    return each.groupBy(id_col).agg(F.count("*").alias("samples"), F.round(F.avg("r1"), 6).alias("rouge1"), F.round(F.avg("rl"), 6).alias("rouge_l"))


def run(df: DataFrame, n: int = 5, stage_dir: str | None = None) -> DataFrame:
    """The stages in a row; with stage_dir each is written there and read again, so any can be resumed."""

    def kept(stage: DataFrame, name: str) -> DataFrame:
        if not stage_dir:
            return stage
        stage.write.mode("overwrite").parquet(f"{stage_dir}/{name}")
        return df.sparkSession.read.parquet(f"{stage_dir}/{name}")

    found = kept(recognise(df), "ner")
    return evaluate(samples(kept(generate(found, n), "generation"), n))
