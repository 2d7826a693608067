"""Quality metrics: span confusion, n-gram overlap, longest common subsequences, cosine statistics, answer scores."""

from __future__ import annotations

import difflib
import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from . import overlaps
from ..functions.held import held
from ..functions.text import by_row, first_line, normal_answer, normal_chinese_answer

def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 over nothing."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def sensitive_words(original: list[str], masked: list[str]) -> list[str]:
    """Words of the original that a greedy walk along the masked words (without marks) does not meet."""
    rest, at, out = [w.lower() for w in masked if w != "<PII>"], 0, []
    for word in original:
        if at < len(rest) and word.lower() == rest[at]:
            at += 1
        else:
            out.append(word)
    return out


aligned_sensitive = by_row(lambda a, b: sensitive_words(list(a), list(b)), "array<string>")


def confusion(gold: Column, found: Column, total: Column) -> Column:
    """struct<tp, fp, fn, tn> of two sets of words among `total` distinct ones."""
    tp, fp, fn = F.size(F.array_intersect(gold, found)), F.size(F.array_except(found, gold)), F.size(F.array_except(gold, found))
    return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (total - tp - fp - fn).alias("tn"))


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": harmonic(p, r), "accuracy": ratio(tp + tn, tp + fp + fn + tn), "specificity": ratio(tn, tn + fp)}


def macro_micro(confusions: DataFrame) -> DataFrame:
    """One row: means of the rates of each record (macro) and rates of the sums (micro)."""
    each = confusions.select("tp", "fp", "fn", "tn", *[c.alias(f"r_{n}") for n, c in rates(*map(F.col, ("tp", "fp", "fn", "tn"))).items()])
    sums = each.agg(F.count("*").alias("records"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], *[F.avg(f"r_{n}").alias(f"macro_{n}") for n in ("precision", "recall", "f1", "accuracy", "specificity")])
    micro = rates(*map(F.col, ("tp", "fp", "fn", "tn")))
    return sums.select("records", *[F.round(f"macro_{n}", 6).alias(f"macro_{n}") for n in micro], *[F.round(c, 6).alias(f"micro_{n}") for n, c in micro.items()])


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by spaces."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def gram_hashes(words: Column, n: int) -> Column:
    """64-bit hashes of the n-grams of an array of words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets. Where one of them has no repeats it is that of the sets; else
    the sorted arrays, which the fold carries along, are merged in one walk."""
    start = F.named_struct(F.lit("a"), F.array_sort(a), F.lit("b"), F.array_sort(b), F.lit("i"), F.lit(0), F.lit("j"), F.lit(0), F.lit("n"), F.lit(0))

    def step(held: Column, _: Column) -> Column:
        x, y = F.get(held["a"], held["i"]), F.get(held["b"], held["j"])
        to = lambda i, j, n: F.named_struct(F.lit("a"), held["a"], F.lit("b"), held["b"], F.lit("i"), held["i"] + i, F.lit("j"), held["j"] + j, F.lit("n"), held["n"] + n)
        return F.when(x == y, to(1, 1, 1)).when(x < y, to(1, 0, 0)).when(x > y, to(0, 1, 0)).otherwise(held)

    places = F.when(F.size(a) + F.size(b) > 0, F.sequence(F.lit(1), F.size(a) + F.size(b))).otherwise(F.array().cast("array<int>"))
    merged = F.aggregate(places, start, step, lambda held: held["n"])
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(merged)


def overlap_f(a: Column, b: Column) -> Column:
    """F1 of two arrays as multisets (token F1, ROUGE-n)."""
    common = multiset_overlap(a, b).cast("double")
    return harmonic(ratio(common, F.size(a)), ratio(common, F.size(b)))


def shared_f(a: list, b: list) -> float:
    """`overlap_f` of two lists."""
    common = (Counter(a) & Counter(b)).total()
    p, r = (common / len(x) if len(x) else 0.0 for x in (a, b))
    return 2 * p * r / (p + r) if p + r else 0.0


#: For long texts: in columns the merge is a fold with a step for each word of either text.
long_overlap_f = by_row(shared_f, "double")


def corpus_bleu(df: DataFrame, candidate: str, reference: str, most: int = 4, more: list[Column] = ()) -> DataFrame:
    """One row: corpus BLEU with clipped n-gram precisions and the brevity penalty; 0 if any precision is. Further
    aggregates over the rows may come beside it."""
    sizes = range(1, most + 1)
    rows = df.withColumns({"c": F.col(candidate), "r": F.col(reference)}) if more else df.select(F.col(candidate).alias("c"), F.col(reference).alias("r"))
    rows = held(rows, **{f"c{n}": gram_hashes(F.col("c"), n) for n in sizes}, **{f"r{n}": gram_hashes(F.col("r"), n) for n in sizes})
    sums = rows.agg(
        F.sum(F.size("c")).alias("c_len"),
        F.sum(F.size("r")).alias("r_len"),
        *[F.sum(multiset_overlap(F.col(f"c{n}"), F.col(f"r{n}"))).alias(f"m{n}") for n in sizes],
        *[F.sum(F.size(f"c{n}")).alias(f"t{n}") for n in sizes],
        *more,
    )
    return _bleu(sums, most)


def _bleu(sums: DataFrame, most: int = 4) -> DataFrame:
    """The sums of matches (m), n-grams (t) and lengths as corpus BLEU, with what stands beside them."""
    sizes = range(1, most + 1)
    made = ("c_len", "r_len", *[f"{x}{n}" for n in sizes for x in "mt"])
    precision = lambda n: F.try_divide(F.col(f"m{n}"), F.col(f"t{n}"))
    mean_log = F.aggregate(F.array(*[F.ln(precision(n)) for n in sizes]), F.lit(0.0), lambda a, x: a + x) / most
    brief = F.when(F.col("c_len") >= F.col("r_len"), 1.0).otherwise(F.exp(1 - F.col("r_len") / F.col("c_len")))
    some = F.least(*[F.coalesce(precision(n), F.lit(0.0)) for n in sizes]) > 0
    return sums.select("c_len", "r_len", *[F.col(f"m{n}") for n in sizes], F.round(F.when(some, brief * F.exp(mean_log)).otherwise(0.0), 6).alias("bleu"), *[F.col(c) for c in sums.columns if c not in made])


def records_bleu(df: DataFrame, original: str, variants: str, kind: str = "normal") -> DataFrame:
    """Corpus BLEU of the variants (an array of texts) of each row against its original; nothing but the sums of a row
    leaves it."""
    each = df.select(overlaps.sums(F.col(original), F.col(variants), kind).alias("s"))
    return _bleu(each.agg(*[F.sum(f"s.{c}").alias(c) for c in overlaps.COUNTS if c != "n"]))


def records_f1(df: DataFrame, original: str, variants: str, key: str) -> DataFrame:
    """key, f1, samples: the mean token F1 of the variants of each key; the pairs are compared within their rows."""
    each = df.select(key, overlaps.sums(F.col(original), F.col(variants), most=1).alias("s"))
    summed = each.groupBy(key).agg(F.sum("s.rouge1").alias("f"), F.sum("s.n").alias("samples"))
    return summed.where("samples > 0").select(key, F.round(F.col("f") / F.col("samples"), 6).alias("f1"), "samples")


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence: a bit for each place of b, all of them at once for each item of a."""
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    every = (1 << len(b)) - 1
    open_ = every
    for x in a:
        met = open_ & places.get(x, 0)
        open_ = ((open_ + met) | (open_ - met)) & every
    return len(b) - open_.bit_count()


def rouge_l_f(a: str, b: str) -> float:
    x, y = a.split(), b.split()
    common = common_subsequence(x, y)
    return 2 * common / (len(x) + len(y)) if common else 0.0


def rouge_l_chinese(a: str, b: str) -> float:
    """The same for texts without spaces, by characters."""
    return rouge_l_f(" ".join("".join(a.split())), " ".join("".join(b.split())))


def subsequence_places(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence with b."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = set(), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def rouge_lsum_f(a: str, b: str) -> float:
    """ROUGE-L over lines: for each line of b the words that its subsequences with any line of a cover, each word counted
    no more often than either text has it."""
    lines = lambda t: [x.split() for x in t.split("\n") if x.split()]
    mine, theirs = lines(a), lines(b)
    left, right = Counter(w for x in mine for w in x), Counter(w for x in theirs for w in x)
    sizes = left.total(), right.total()
    common = 0
    for line in theirs:
        for k in sorted(set().union(*(subsequence_places(line, x) for x in mine))):
            if left[line[k]] > 0 and right[line[k]] > 0:
                left[line[k]] -= 1
                right[line[k]] -= 1
                common += 1
    return 2 * common / sum(sizes) if common else 0.0


def greedy_match(a: list, b: list) -> dict:
    """Precision, recall and F of two lists of vectors: each meets the other side's nearest by cosine (as BERTScore does
    over the vectors of an encoder)."""
    if not len(a) or not len(b):
        return {"precision": 0.0, "recall": 0.0, "f1": 0.0}
    unit = lambda x: (m := np.array([np.asarray(v, dtype=float) for v in x])) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    cosine = unit(a) @ unit(b).T
    p, r = float(cosine.max(axis=1).mean()), float(cosine.max(axis=0).mean())
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r > 0 else 0.0}


def code_similarity(prediction: str, truth: str) -> float:
    """Matching-block ratio of the first line without code marks to the truth, in whole hundredths."""
    line = next((x for x in prediction.lstrip("\n").split("\n") if not any(m in x for m in ("`", "#", "//"))), "")
    return round(100 * difflib.SequenceMatcher(None, line, truth).ratio()) / 100 if line or truth else 0.0


rouge_l = by_row(rouge_l_f, "double")
rouge_l_zh = by_row(rouge_l_chinese, "double")
rouge_lsum = by_row(rouge_lsum_f, "double")
_matched = by_row(lambda a, b: list(greedy_match(a, b).values()), "array<double>")


def vector_score(a: Column, b: Column) -> Column:
    """struct<precision, recall, f1> of two arrays of vectors, see `greedy_match`."""
    found = _matched(a, b)
    return F.struct(*[F.get(found, F.lit(k)).alias(n) for k, n in enumerate(("precision", "recall", "f1"))])

code_sim = by_row(code_similarity, "double")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def statistics(df: DataFrame, value: str, *key: str) -> DataFrame:
    """mean, population deviation, least, largest, and number; zeros over nothing."""
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return df.groupBy(*key).agg(zero(F.avg(value)).alias("mean"), zero(F.stddev_pop(value)).alias("std"), zero(F.min(value)).alias("low"), zero(F.max(value)).alias("high"), F.count(value).alias("n"))


# Scores of single answers.


def count_score(prediction: Column, truth: Column) -> Column:
    """Share of the numbers of the prediction that equal the truth."""
    numbers = F.regexp_extract_all(prediction, F.lit("[0-9]+"), F.lit(0))
    return ratio(F.size(F.filter(numbers, lambda x: x == truth)).cast("double"), F.size(numbers))


def retrieval_score(prediction: Column, truth: Column, word: str = "Paragraph ") -> Column:
    """The same for the paragraph number that the truth names; null if it names none."""
    number = F.regexp_extract(truth, word + "([0-9]+)", 1)
    return F.when(number != "", count_score(prediction, number))


def classification_score(prediction: Column, truth: Column, classes: Column) -> Column:
    """1 / n if the truth is among the n classes that the prediction names, those within the truth's name left out."""
    named = F.filter(classes, lambda c: F.contains(prediction, c) & ((c == truth) | ~F.contains(truth, c)))
    return F.when(F.array_contains(named, truth), 1.0 / F.size(named)).otherwise(0.0)


def token_f1(prediction: Column, truth: Column, chinese: bool = False) -> Column:
    if chinese:
        tokens = lambda c: F.regexp_extract_all(normal_chinese_answer(c), F.lit("(?s)."), F.lit(0))
    else:
        tokens = lambda c: F.regexp_extract_all(normal_answer(c), F.lit(r"\S+"), F.lit(0))
    return overlap_f(tokens(prediction), tokens(truth))


def contains_any(prediction: Column, truths: Column) -> Column:
    """1 if the normalised first line holds a normalised truth."""
    line = normal_answer(first_line(prediction))
    return F.exists(truths, lambda t: F.contains(line, normal_answer(t))).cast("double")


def trigram_counts(text: str) -> Counter:
    """A stand-in for a sentence encoder: the character 3-grams of a text and how often each occurs."""
    padded = f"  {text.lower()}  "
    return Counter(map("".join, zip(padded, padded[1:], padded[2:], strict=False)))


def trigram_similarity(a: str, b: str) -> float:
    """Cosine of the counts of two texts."""
    x, y = trigram_counts(a), trigram_counts(b)
    dot = sum(n * y[g] for g, n in x.items() if g in y)
    return dot / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))


#: In arrays of columns the same is a fold with a step for each sign, which took several times as long.
trigram_cosine = by_row(trigram_similarity, "double")


def similarity_row(df: DataFrame, candidate: str, reference: str) -> DataFrame:
    """One row over pairs of texts: corpus BLEU and means of ROUGE-1, 2, L, of token precision, recall and F1, and of the
    cosine of the stand-in vectors; the texts are read once. The candidate may be an array of texts for each reference."""
    many = isinstance(df.schema[candidate].dataType, ArrayType)
    each = df.select(overlaps.sums(F.col(reference), F.col(candidate) if many else F.array(candidate), "plain", more=True).alias("s"))
    # Means over pairs: the F1 of tokens is ROUGE-1.
    scores = {n: "rouge1" if n == "f1" else n for n in ("rouge1", "rouge2", "rouge_l", "precision", "recall", "f1", "cosine")}
    means = [F.round(F.coalesce(F.try_divide(F.sum(f"s.{c}"), F.sum("s.n")), F.lit(0.0)), 6).alias(n) for n, c in scores.items()]
    summed = each.agg(*[F.sum(f"s.{c}").alias(c) for c in overlaps.COUNTS if c != "n"], *means)
    return _bleu(summed).select("bleu", *scores)


def with_truths(df: DataFrame, prediction: str, truths: str) -> DataFrame:
    """One row: the mean over rows of the best token F1 against any truth, in hundredths."""
    best = F.array_max(F.transform(truths, lambda t: token_f1(F.col(prediction), t)))
    return df.agg(F.round(F.coalesce(F.avg(best), F.lit(0.0)) * 100, 6).alias("score"), F.count("*").alias("n"))
