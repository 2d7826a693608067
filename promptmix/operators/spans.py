"""Sensitive spans: the <redacted> micro-format, recognisers, overlap joins, clipping and redaction."""

from __future__ import annotations

import difflib
import string
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import places
from ..functions.text import by_row

SPAN = r"<redacted>\s*([^(]+?)\s*\(([^)]+)\)\s*</redacted>"
# Labels that are not marked by default.
EXCLUDED = ("DATE", "TIME", "GPE", "QUANTITY", "NORP", "PERCENT", "WORK_OF_ART", "LAW", "LANGUAGE", "FAC", "PRODUCT", "EVENT")
# Normalised labels of a pre-annotated data set.
LABEL_MAP = {
    "USERNAME": "USERNAME",
    "DATEOFBIRTH": "DATE",
    "STREET": "LOCATION",
    "ZIPCODE": "ID",
    "TELEPHONENUM": "PHONE",
    "CREDITCARDNUMBER": "ID",
    "EMAIL": "EMAIL",
    "CITY": "LOCATION",
    "BUILDINGNUM": "IDENTIFIER",
    "GIVENNAME": "PERSON",
    "SURNAME": "PERSON",
    "IDCARDNUM": "ID",
    "PASSWORD": "PASSWORD",
    "DRIVERLICENSENUM": "ID",
    "SOCIALNUM": "ID",
    "ACCOUNTNUM": "ID",
    "TAXNUM": "ID",
}
# Labels of recognition engines, and those ignored by default.
ENGINE_LABELS = {
    "PERSON": "PERSON",
    "PER": "PERSON",
    "LOCATION": "LOCATION",
    "LOC": "LOCATION",
    "ORG": "ORGANIZATION",
    "DATE": "DATE_TIME",
    "TIME": "DATE_TIME",
    "MONEY": "MONEY",
    "PERCENT": "PERCENTAGE",
    "CARDINAL": "CARDINAL",
    "ORDINAL": "ORDINAL",
    "QUANTITY": "QUANTITY",
    "NORP": "AFFILIATION",
    "AGE": "AGE",
    "ID": "ID",
    "EMAIL": "EMAIL",
    "PATIENT": "PERSON",
    "STAFF": "PERSON",
    "HOSP": "ORGANIZATION",
    "PATORG": "ORGANIZATION",
    "PHONE": "PHONE_NUMBER",
    "HCW": "PERSON",
    "HOSPITAL": "ORGANIZATION",
    "GPE": "GEO_POLITICAL_ENTITY",
    "FAC": "BUILDING",
}
IGNORED = ("FAC", "PRODUCT", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE", "ORDINAL", "DATE_TIME", "ORGANIZATION", "O")
#: Recognisers of the default engine.
RECOGNISERS = {
    "EMAIL": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "PHONE": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "IP": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "CARD": r"\b[0-9]{16}\b",
}
#: Words cut off at the ends of entities; a compact English list, to be replaced by the caller's.
STOP_WORDS = frozenset("a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so than that the their them then there these they this those to too us was we were what when which who will with you your".split())


# The micro-format.


def parsed(ner: Column) -> Column:
    """array<struct<word, type>> of the spans of a text."""
    words, types = (F.regexp_extract_all(ner, F.lit(SPAN), F.lit(k)) for k in (1, 2))
    return F.zip_with(words, types, lambda w, t: F.named_struct(F.lit("word"), F.trim(w), F.lit("type"), F.trim(t)))


def span_table(df: DataFrame, id_col: str = "doc_id", ner_col: str = "ner") -> DataFrame:
    """A row for each span: id, pos (from 0), word, type."""
    return df.select(id_col, F.posexplode(parsed(F.col(ner_col))).alias("pos", "s")).select(id_col, "pos", "s.word", "s.type")


def affixes(word: Column) -> Column:
    """struct<prefix, core, suffix>: punctuation and symbols at the ends apart; a word of nothing else stays whole."""
    prefix, suffix = F.regexp_extract(word, r"^[\p{P}\p{S}]+", 0), F.regexp_extract(word, r"[\p{P}\p{S}]+$", 0)
    core = F.regexp_replace(word, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")
    whole = core == ""
    return F.struct(F.when(whole, "").otherwise(prefix).alias("prefix"), F.when(whole, word).otherwise(core).alias("core"), F.when(whole, "").otherwise(suffix).alias("suffix"))


def grouped(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Positions of each distinct (word, type) of a document; uid is the pair, so labels may hold any sign."""
    return spans.groupBy(id_col, "word", "type").agg(F.sort_array(F.collect_list("pos")).alias("positions")).withColumn("uid", F.concat_ws("|", "word", "type"))


def template(ner: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(ner, SPAN, "<redacted>"), r"\s+", " "))


def has_spans(ner: Column) -> Column:
    return F.coalesce(F.contains(ner, F.lit("<redacted>")), F.lit(False))


def spliced(ner: Column, fakes: Column) -> Column:
    """The text with its spans replaced by the fakes in order."""
    return F.array_join(F.zip_with(F.split(ner, SPAN, -1), fakes, lambda p, f: F.concat(F.coalesce(p, F.lit("")), F.coalesce(f, F.lit("")))), "")


def prompt_with_target(tpl: Column, pos: Column, real: Column, strategy: str = "independent") -> Column:
    """The template up to and with the placeholder at pos as [TARGET]: earlier ones stay (independent) or are filled
    with the real words (real)."""
    pieces = F.split(tpl, "<redacted>", -1)
    fill = F.transform(F.sequence(F.lit(0), pos), lambda i: F.when(i == pos, "[TARGET]").otherwise(F.get(real, i) if strategy == "real" else F.lit("<redacted>")))
    return F.array_join(F.zip_with(F.slice(pieces, F.lit(1), pos + 1), fill, lambda p, f: F.concat(p, f)), "")


# Recognition.


class Recogniser(Protocol):
    """Anything that gives array<struct<entity_type, start, end, score, text>> for a text column."""

    def entities(self, text: Column) -> Column: ...


class RegexRecogniser:
    """The default engine: patterns with a fixed score, mapped labels, an ignore list and a threshold."""

    def __init__(self, patterns: dict[str, str] | None = None, labels: dict[str, str] | None = None, ignored: tuple[str, ...] = (), score: float = 1.0, threshold: float = 0.0):
        self.patterns, self.labels, self.ignored, self.score, self.threshold = patterns or RECOGNISERS, labels or {}, ignored, score, threshold

    def entities(self, text: Column) -> Column:
        empty = F.array().cast("array<struct<entity_type:string,start:int,end:int,score:double,text:string>>")
        if self.score < self.threshold:
            return empty
        named = [(self.labels.get(k, k), p) for k, p in self.patterns.items()]

        def found(kind: str, pattern: str) -> Column:
            entity = lambda x: F.named_struct(F.lit("entity_type"), F.lit(kind), F.lit("start"), x["start"], F.lit("end"), x["end"], F.lit("score"), F.lit(self.score), F.lit("text"), x["word"])
            return F.transform(places(text, pattern), entity)

        parts = [found(k, p) for k, p in named if k not in self.ignored]
        return F.concat(*parts) if parts else empty


ENTITIES = "array<struct<entity_type:string,start:int,end:int,score:double,text:string>>"


class EngineRecogniser:
    """Any engine: `build` is called once in each worker and gives a function from a text to (label, start, end, score).
    Labels are mapped, ignored ones and those of a score below the threshold go; a null text has none."""

    def __init__(self, build, labels: dict[str, str] | None = None, ignored: tuple[str, ...] = IGNORED, threshold: float = 0.5):
        self.build, self.labels, self.ignored, self.threshold = build, ENGINE_LABELS if labels is None else labels, ignored, threshold

    def entities(self, text: Column) -> Column:
        build, labels, ignored, threshold = self.build, self.labels, self.ignored, self.threshold

        def of(find, one: str | None) -> list[dict]:
            named = [(labels.get(label, label), start, end, score) for label, start, end, score in (find(one) if one else ())]
            return [{"entity_type": k, "start": s, "end": e, "score": float(p), "text": one[s:e]} for k, s, e, p in named if p >= threshold and k not in ignored]

        @F.pandas_udf(ENTITIES)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            find = build()
            for batch in batches:
                yield pd.Series([of(find, one) for one in batch], dtype=object)

        return run(text)


def with_fallback(build, other):
    """A builder that takes the other engine where the first cannot be built, as without its model."""

    def either():
        try:
            return build()
        except Exception:  # whatever an engine raises when it lacks something
            return other()

    return either


def merged_labels(base: dict[str, str], extra: list[str]) -> dict[str, str]:
    """base with SOURCE:TARGET pairs added; entries of another form are left out."""
    pairs = (item.split(":", 1) for item in extra if ":" in item)
    return base | {a.strip(): b.strip() for a, b in pairs}


def mapped_label(label: Column, labels: dict[str, str] = LABEL_MAP) -> Column:
    key = F.upper(F.trim(label))
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(table, key), key)


# Overlap and clipping.


def best_labels(spans: DataFrame, entities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """spans (id, start, end) with the label of the entity (id, idx, start, end, label) that overlaps most, the first
    on ties; null without any. Rows are met by document and then by overlap; the best is an aggregate, not a sort."""
    e = entities.select(F.col(id_col).alias("__id"), F.col("idx"), F.col("start").alias("__s"), F.col("end").alias("__e"), "label")
    joined = spans.join(e, (spans[id_col] == e["__id"]) & (spans["start"] < e["__e"]) & (e["__s"] < spans["end"]), "left")
    overlap = F.least("end", "__e") - F.greatest("start", "__s")
    return joined.groupBy(*spans.columns).agg(F.max_by("label", F.struct(overlap, -F.col("idx"))).alias("label"))


def normalised(entities: Column, labels: dict[str, str] = LABEL_MAP) -> Column:
    """Entities (label, start, end) with mapped labels, without empty ones, by (start, end)."""
    kept = F.filter(entities, lambda x: x["end"] > x["start"])
    return F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), mapped_label(x["label"], labels).alias("label"))))


def clipped(entities: Column, length: Column) -> Column:
    """Sorted entities (start, end, label) cut to what lies behind the end of those before; empty ones go."""
    kind = "array<struct<start:int,end:int,label:string>>"
    begin = F.struct(F.lit(0).alias("cursor"), F.array().cast(kind).alias("out"))

    def step(held: Column, x: Column) -> Column:
        s = F.greatest(held["cursor"], x["start"], F.lit(0)).cast("int")
        e = F.least(length, x["end"]).cast("int")
        more = F.concat(held["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["label"].alias("label"))))
        return F.when(e > s, F.struct(e.alias("cursor"), more.alias("out"))).otherwise(held)

    return F.aggregate(entities, begin, step, lambda held: held["out"])


def redacted(text: Column, entities: Column, excluded: tuple[str, ...] = ()) -> Column:
    """The text with non-overlapping entities (start, end, label) in order marked, but for excluded labels."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(held: Column, x: Column) -> Column:
        gap, word = F.substring(text, held["at"] + 1, x["start"] - held["at"]), F.substring(text, x["start"] + 1, x["end"] - x["start"])
        marked = F.when(x["label"].isNull() | x["label"].isin(*excluded) if excluded else x["label"].isNull(), word).otherwise(F.concat(F.lit("<redacted> "), word, F.lit(" ("), x["label"], F.lit(") </redacted>")))
        return F.struct(x["end"].cast("int").alias("at"), F.concat(held["out"], gap, marked).alias("out"))

    return F.aggregate(entities, start, step, lambda held: F.concat(held["out"], F.substring(text, held["at"] + 1, F.length(text))))


# What needs order-dependent text logic.


def difference(original: str, masked: str, mark: str = "<PII>") -> list[tuple[int, int]]:
    """Half-open spans of the original that a masked copy lacks, by matching blocks (Ratcliff-Obershelp)."""
    rest = masked.replace(mark, "")
    return [(a, b) for tag, a, b, _, _ in difflib.SequenceMatcher(None, original, rest, autojunk=False).get_opcodes() if tag in ("delete", "replace") and b > a]


deleted_spans = by_row(lambda a, b: [{"start": s, "end": e} for s, e in difference(a, b)], "array<struct<start:int,end:int>>")

TRIMMED = (set(string.punctuation) - set("%$")) | set("“”‘’–—…")


def trim_entity(text: str, start: int, end: int, stop_words=STOP_WORDS) -> tuple[int, int]:
    """The span without white space, signs and stop words at its ends; empty if nothing is left."""
    while start < end and text[start].isspace():
        start += 1
    while start < end and text[end - 1].isspace():
        end -= 1
    while start < end and text[start] in TRIMMED:
        start += 1
    while start < end and text[end - 1] in TRIMMED:
        end -= 1
    stops = lambda w: w.strip(string.punctuation).lower() in stop_words
    while start < end:
        words = text[start:end].split()
        if words and stops(words[0]):
            start += text[start:end].index(words[0]) + len(words[0])
        elif words and stops(words[-1]):
            end = start + text[start:end].rindex(words[-1])
        else:
            break
        while start < end and text[start].isspace():
            start += 1
        while start < end and text[end - 1].isspace():
            end -= 1
    return start, end


def split_entity(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a span between and, or, & with white space on both sides."""
    import re

    out, at = [], start
    for m in re.compile(r"\s+(?:and|or|&)\s+", re.I).finditer(text, start, end):
        out.append((at, m.start()))
        at = m.end()
    return [(s, e) for s, e in [*out, (at, end)] if e > s]


def refine(text: str, entities) -> list[dict]:
    """Trimmed and split entities, each span once (the first), by start."""
    seen: dict[tuple[int, int], dict] = {}
    for x in entities:
        s, e = trim_entity(text, x["start"], x["end"])
        if e > s:
            for part in split_entity(text, s, e):
                seen.setdefault(part, {"entity_type": x["entity_type"], "start": part[0], "end": part[1], "score": x["score"], "text": text[part[0] : part[1]]})
    return sorted(seen.values(), key=lambda x: x["start"])


refined_entities = by_row(refine, "array<struct<entity_type:string,start:int,end:int,score:double,text:string>>")
