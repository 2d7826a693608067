"""Assembly of look-alike prompts from candidate lists."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import list_array, lists_of
from .spans import SPAN, parsed, spliced


def fake_of(words: Column, i: Column) -> Column:
    return F.get(words, i % F.size(words))


def samples(df: DataFrame, n: int, id_col: str = "doc_id", ner_col: str = "ner", fakes_col: str = "fakes") -> DataFrame:
    """id, sample_idx, text: sample i takes candidate i (in turn) of every span. df has the text and, for each span, an
    array of candidates; a text without spans gives itself once."""
    none = F.size(fakes_col) == 0
    count = F.when(none, F.lit(1)).otherwise(F.lit(n))
    chosen = F.transform(F.col(fakes_col), lambda words: fake_of(words, F.col("sample_idx")))
    return df.select(id_col, ner_col, fakes_col, F.explode(F.sequence(F.lit(0), count - 1)).alias("sample_idx")).select(id_col, "sample_idx", spliced(F.col(ner_col), chosen).alias("text"))


def variants(ner: Column, fakes: Column, n: int) -> Column:
    """The n texts of a row's samples: text i takes candidate i (in turn) of every span. In arrays over an Arrow batch."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        known = pc.and_(texts.is_valid(), lists.is_valid())
        texts, lists = (pc.if_else(known, x, pa.scalar(None, x.type)) for x in (texts, lists))
        sizes = lambda x: pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces, spans, words = texts.flatten(), lists.flatten(), lists.flatten().flatten()
        of_pieces, of_spans, of_words = sizes(texts), sizes(lists), sizes(spans)
        first = np.cumsum(of_words) - of_words
        # Piece k of a text goes to twice its place, span k behind it; a list without the other's places leaves them out.
        place = lambda counts: np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        row = np.concatenate([np.repeat(np.arange(len(lists)), of_pieces), np.repeat(np.arange(len(lists)), of_spans)])
        order = np.argsort(row * (2 * max(of_pieces.max(initial=0), of_spans.max(initial=0)) + 2) + np.concatenate([2 * place(of_pieces), 2 * place(of_spans) + 1]), kind="stable")
        both, lengths = pa.concat_arrays([pieces, words, pa.array([""], pa.string())]), of_pieces + of_spans
        ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        made = []
        for i in range(n):
            taken = np.where(of_words > 0, len(pieces) + first + i % np.maximum(of_words, 1), len(both) - 1)
            parts = pc.fill_null(both.take(pa.array(np.concatenate([np.arange(len(pieces)), taken])[order])), "")
            made.append(pc.binary_join(pa.ListArray.from_arrays(ends, parts), ""))
        turns = (np.arange(n)[None, :] * len(lists) + np.arange(len(lists))[:, None]).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(lists) * n + 1, n, dtype=np.int32)), pa.concat_arrays(made).take(pa.array(turns)), mask=pc.invert(known))

    return run(F.split(ner, SPAN, -1), fakes)


def probability(probs: Column, i: Column) -> Column:
    """Product of the probabilities of the candidates that sample i takes."""
    return F.aggregate(probs, F.lit(1.0), lambda a, p: a * fake_of(p, i))


def mapping(df: DataFrame, ner_col: str = "ner", fakes_col: str = "fakes") -> Column:
    """map<word, fakes>: for each distinct word in order its distinct fakes in order; types share a word's entry."""
    words = F.transform(parsed(F.col(ner_col)), lambda s: s["word"])
    entry = lambda w: F.named_struct(F.lit("word"), w, F.lit("fakes"), F.array_distinct(F.flatten(F.zip_with(words, F.col(fakes_col), lambda a, f: F.when(a == w, f).otherwise(F.array().cast("array<string>"))))))
    return F.map_from_entries(F.transform(F.array_distinct(words), entry))


def rebuilt(ner: Column, held: Column, i: Column, mode: str = "progressive") -> Column:
    """Text of sample i from the mapping: every occurrence of a word takes fake i (progressive), or the k-th takes fake
    i + k (gqs); words without fakes stay. Runs of spaces become one."""
    words = F.transform(parsed(ner), lambda s: s["word"])

    def choose(w: Column, j: Column) -> Column:
        fakes = F.element_at(held, w)
        k = F.size(F.filter(F.slice(words, F.lit(1), j), lambda x: x == w)) if mode == "gqs" else F.lit(0)
        return F.when(F.coalesce(F.size(fakes), F.lit(0)) > 0, F.get(fakes, (i + k) % F.size(fakes))).otherwise(w)

    return F.regexp_replace(spliced(ner, F.transform(words, choose)), " {2,}", " ")


def rebuilt_texts(words: list, pieces: list, pools: list, n: int, mode: str = "progressive") -> list[str]:
    """The n texts of `rebuilt` for one row, from the words, what stands between them, and the candidates of each."""
    held: dict[str, dict] = {}
    for word, pool in zip(words, pools, strict=True):
        held.setdefault(word, {}).update(dict.fromkeys(pool))
    met: dict[str, int] = {}
    turns = []
    for word in words:
        turns.append((list(held[word]) or [word], met.get(word, 0)))
        met[word] = met.get(word, 0) + (mode == "gqs")
    made, out = [""] * (len(pieces) + len(turns)), []
    made[::2] = pieces
    for i in range(n):
        made[1::2] = [fakes[(i + k) % len(fakes)] for fakes, k in turns]
        text = "".join(made)
        out.append(re.sub(" {2,}", " ", text) if "  " in text else text)
    return out


def all_rebuilt(ner: Column, fakes: Column, n: int, mode: str = "progressive") -> Column:
    """The n texts that `rebuilt` gives for each row from the mapping of its candidates, the row being cut once."""

    @F.arrow_udf("array<string>")
    def run(*columns: pa.Array) -> pa.Array:
        words, pieces, fakes = columns
        rows = zip(lists_of(words), lists_of(pieces), lists_of(fakes, lists_of), strict=True)
        return list_array([None if None in row else rebuilt_texts(*row, n, mode) for row in rows])

    words = F.transform(parsed(ner), lambda s: s["word"])
    return run(words, F.split(ner, SPAN, -1), fakes)


def sorted_index(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sample_idx replaced by its place when a document's samples go by probability, the largest first (stable)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("prob"), "sample_idx")) - 1
    return df.withColumn("sample_idx", place)
