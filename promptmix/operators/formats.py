"""Formatters: from raw rows to texts with marked spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.held import held
from ..functions.text import cjk_ratio, has_calendar_word, strip_cjk
from ..sources.io import read_limit
from .spans import EXCLUDED, Recogniser, RegexRecogniser, clipped, deleted_spans, normalised, redacted


def best_label(span: Column, entities: Column) -> Column:
    """The type of the entity that overlaps a span most, the first on ties; null without any. For arrays of one row;
    for tables of spans see best_labels."""
    start = F.named_struct(F.lit("most"), F.lit(0), F.lit("label"), F.lit(None).cast("string"))

    def step(best: Column, x: Column) -> Column:
        overlap = F.least(span["end"], x["end"]) - F.greatest(span["start"], x["start"])
        return F.when(overlap > best["most"], F.named_struct(F.lit("most"), overlap, F.lit("label"), x["entity_type"])).otherwise(best)

    return F.aggregate(entities, start, step, lambda best: best["label"])


def marked_differences(text: Column, spans: Column, entities: Column, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """The text with deleted spans marked: those with a month or weekday always (by their label or DATE), others by their
    label unless it is excluded or missing."""

    def labelled(s: Column) -> Column:
        label = best_label(s, entities)
        kept = F.when(~label.isin(*excluded), label) if excluded else label
        dated = has_calendar_word(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
        return F.named_struct(F.lit("start"), s["start"], F.lit("end"), s["end"], F.lit("label"), F.when(dated, F.coalesce(label, F.lit("DATE"))).otherwise(kept))

    return redacted(text, F.transform(spans, labelled))


def format_masked_pairs(df: DataFrame, id_col: str, text_col: str, masked_col: str, recogniser: Recogniser | None = None, excluded: tuple[str, ...] = EXCLUDED, cjk_limit: float = 0.5, limit: int | None = None, mark: str = "<PII>") -> DataFrame:
    """id, text, masked_text: what a masked copy hides, marked and labelled. The limit counts rows read; rows that lack a
    side or are mostly Chinese go, and Chinese signs are stripped from both sides of the rest."""
    rows = read_limit(df.select(id_col, F.col(text_col).alias("text"), F.col(masked_col).alias("mask")), id_col, limit)
    rows = rows.where(F.col("text").isNotNull() & F.col("mask").isNotNull()).where(cjk_ratio(F.col("text")) < cjk_limit)
    rows = rows.select(id_col, strip_cjk(F.col("text")).alias("text"), strip_cjk(F.col("mask")).alias("mask"))
    found = (recogniser or RegexRecogniser()).entities(F.col("text"))
    rows = held(rows, spans=deleted_spans(F.col("text"), F.replace("mask", F.lit(mark), F.lit("<PII>"))), entities=found)
    return rows.select(id_col, "text", marked_differences(F.col("text"), F.col("spans"), F.col("entities"), excluded).alias("masked_text"))


def format_labelled(df: DataFrame, id_col: str, text_col: str, spans_col: str, language_col: str | None = None, language: str = "en", excluded: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """id, text, masked_text from rows with given spans (label, start, end): one language, mapped labels, overlaps clipped."""
    rows = read_limit(df, id_col, limit)
    rows = rows.where(F.col(language_col) == language) if language_col else rows
    rows = rows.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text"), F.col(spans_col).alias("given"))
    rows = held(rows, spans=clipped(normalised(F.col("given")), F.length("text")))
    return rows.select(id_col, "text", redacted(F.col("text"), F.col("spans"), excluded).alias("masked_text"))


def marked_with_overlaps(text: Column, entities: Column) -> Column:
    """The compatible writer of an engine's entities in order: overlapping entities repeat the text they share."""
    start = F.named_struct(F.lit("at"), F.lit(0), F.lit("out"), F.lit(""))

    def step(done: Column, x: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(x["start"] - done["at"], F.lit(0)))
        word = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        return F.named_struct(F.lit("at"), x["end"].cast("int"), F.lit("out"), F.concat(done["out"], gap, F.lit("<redacted> "), word, F.lit(" ("), x["entity_type"], F.lit(") </redacted>")))

    return F.aggregate(entities, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def word_prompt(kind: Column, sentence: Column) -> Column:
    """The question for a word of a type at [TARGET]."""
    return F.concat(F.lit("Guess the "), kind, F.lit(" at [TARGET] in: "), sentence, F.lit("\nAnswer: "))
