"""Text functions as Column expressions: scripts, calendar words, roots, casing, normal forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar words in their long and short forms.
MONTHS = "january february march april may june july august september october november december".split()
MONTHS_SHORT = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
WEEKDAYS_SHORT = "mon tue wed thu fri sat sun".split()
# The words that make a text one with a date.
CALENDAR_WORDS = (
    "january jan february feb march mar april apr may june jun july jul august aug september sept sep october oct november nov december dec "
    "monday mon tuesday tues tue wednesday wed thursday thurs thur thu friday fri saturday sat sunday sun"
).split()
CALENDAR = "|".join(CALENDAR_WORDS)
# Punctuation of English and Chinese answers.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CHINESE_PUNCTUATION = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏."


def non_empty(*columns: Column) -> Column:
    """The first value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def cjk_ratio(text: Column) -> Column:
    """Share of CJK unified ideographs among the characters that are not white space; 0 for none."""
    seen = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return F.coalesce(F.length(F.regexp_replace(text, "[^一-鿿]", "")) / F.nullif(seen, F.lit(0)), F.lit(0.0))


def strip_cjk(text: Column) -> Column:
    return F.regexp_replace(text, "[一-鿿]", "")


def has_calendar_word(text: Column) -> Column:
    """Whether a month or weekday stands in the text as a word of its own; false for null."""
    return F.coalesce(text.rlike(rf"(?i)(?<![A-Za-z])(?:{CALENDAR})(?![A-Za-z])"), F.lit(False))


def root_key(word: Column) -> Column:
    """Letters of the part before @ that identify a word: runs of three or more, or else all runs, in lower case."""
    local = F.split_part(word, F.lit("@"), F.lit(1))
    runs = lambda p: F.array_join(F.regexp_extract_all(local, F.lit(p), F.lit(0)), "")
    return F.lower(F.coalesce(F.nullif(runs("[A-Za-z]{3,}"), F.lit("")), runs("[A-Za-z]+"), F.lit("")))


def is_email(word: Column) -> Column:
    return F.trim(word).rlike(r"^[^\s@]+@[^\s@.][^\s]*\.[^\s]*$|^[^\s@]+@\.[^\s]*$")


def has_special(word: Column) -> Column:
    return word.rlike(r"[^A-Za-z0-9\s]")


def strip_special_if_plain(fake: Column, real: Column) -> Column:
    """The fake without signs if the real word has none; as it was if nothing would be left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(fake, r"[^A-Za-z0-9\s]", ""), r"\s+", " "))
    return F.when(~has_special(real) & has_special(fake) & (bare != ""), bare).otherwise(fake)


def alpha_tokens(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit("[A-Za-z]+"), F.lit(0))


def words_and_signs(text: Column) -> Column:
    """Mask marks, words, and listed signs, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)<PII>|\b\w+\b|[<>=/!@#$%^&*()?\":{}|\\`~;_+-]"), F.lit(0))


def normal_text(text: Column) -> Column:
    """Letters, digits and . , ! ? with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}.,!?\s]", " "), r"(?U)\s+", " "))


def normal_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation and articles, single spaces."""
    bare = F.translate(F.lower(text), ASCII_PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(?:a|an|the)\b", " "), r"(?U)\s+", " "))


def normal_chinese_answer(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), ASCII_PUNCTUATION + CHINESE_PUNCTUATION, ""), r"(?U)\s+", "")


def first_line(text: Column) -> Column:
    return F.trim(F.split_part(F.ltrim(text, F.lit("\n")), F.lit("\n"), F.lit(1)))


def cased_like(fake: str, real: str) -> str:
    """fake in the casing of real: upper, title or capitalised; else as it is."""
    if not fake or not real:
        return fake
    if real.isupper():
        return fake.upper()
    if real.istitle():
        return fake.title()
    return fake.capitalize() if real[0].isupper() and real[1:].islower() else fake


def looks_like_email(text: str) -> bool:
    local, at, domain = text.strip().partition("@")
    return bool(at and local and domain and "." in domain) and not any(c.isspace() for c in text.strip())


def cased_word_by_word(fake: str, real: str) -> str:
    """The words of fake in the casing of the words of real at the same places; e-mail addresses are left alone."""
    if not fake or not real or looks_like_email(real):
        return fake
    given, model = fake.split(), real.split()
    if not given or not model:
        return fake
    return " ".join([cased_like(w, model[i]) if i < len(model) else w for i, w in enumerate(given)])


def by_row(function, returns: str):
    """A vectorised UDF that applies a plain function to the values of each row; null for null arguments."""

    def call(*columns: Column) -> Column:
        @F.pandas_udf(returns)
        def run(first: pd.Series, *more: pd.Series) -> pd.Series:
            rows = zip(first, *more, strict=True)
            return pd.Series([None if any(v is None for v in row) else function(*row) for row in rows], dtype=object)

        return run(*columns)

    return call


def texts_of(array: pa.Array) -> list:
    """The texts of an array, by way of numpy, which takes a fraction of the time of to_pylist."""
    return array.to_numpy(zero_copy_only=False).tolist()


def lists_of(array: pa.Array, values=texts_of) -> list:
    """The lists of an array; null for null."""
    sizes = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    flat, ends = values(array.flatten()), np.concatenate([[0], np.cumsum(sizes)]).tolist()
    found = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    if array.null_count:
        found = [x if ok else None for x, ok in zip(found, array.is_valid().to_pylist(), strict=True)]
    return found


def list_array(rows: list, values=lambda flat: pa.array(flat, pa.string())) -> pa.Array:
    """The inverse of `lists_of`."""
    ends = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in rows])]).astype(np.int32)
    flat = values([w for x in rows if x is not None for w in x])
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([x is None for x in rows], pa.bool_()))


def kept_as(real: Column, fakes: Column) -> Column:
    """Candidates without signs where the real word has none, and without repeats that this makes (the first wins)."""
    return F.array_distinct(F.transform(fakes, lambda f: strip_special_if_plain(f, real)))


#: Title case differs from initcap at apostrophes and hyphens, hence no built-in.
align_casing = by_row(cased_word_by_word, "string")
