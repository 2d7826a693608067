"""Judge evaluation: tasks of an original among fakes, prompts, answers, outcomes, and the two indistinguishability
rates: of pairs (BIR) and of larger mixes (MCMR)."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.held import held
from ..sources.shared import written
from .sampling import draw

# Phrases of a judge that does not decide, and numerals of an answer in words.
UNDECIDED = ("无法判断", "无法区分", "不能判断", "难以判断", "无法确定", "undecided", "cannot decide", "cannot determine", "unable to decide", "unable to determine")
NUMERALS = "一二三四五六七八九"
# The lines of the question.
QUESTION = "Evaluate the following candidate passages."
QUESTION_COUNT = "There are {} candidates below, with exactly ONE authentic (real) passage."
QUESTION_ORDER = "The order of candidates is randomized."
QUESTION_LIST = "Candidates:"
QUESTION_OPTION = "----- Option {} -----"
QUESTION_END = "Answer (only the index number, e.g., 1 or 2 or -1):"
QUESTION_END_COUNT = "Answer (only the index number of the authentic passage, e.g., 1, 2, 3..., or -1 if unsure):"


class Judge(Protocol):
    """Anything that answers a column of prompts."""

    def answers(self, prompt: Column, key: Column) -> Column: ...


class HashJudge:
    """A deterministic stand-in that chooses among given answers by a hash of the key."""

    def __init__(self, options: tuple = ("1", "2", "-1", "undecided", "选项一", "none", None), seed: int = 42):
        self.options, self.seed = options, seed

    def answers(self, prompt: Column, key: Column) -> Column:
        at = F.conv(F.substring(draw(self.seed, key), 1, 6), 16, 10).cast("int") % len(self.options)
        return F.get(F.array(*[F.lit(o) for o in self.options]), at)


class CallableJudge:
    """Answers from a function of a prompt, called by a pool of threads in each task; a call that fails is a null."""

    def __init__(self, function, threads: int = 5):
        self.function, self.threads = function, threads

    def answers(self, prompt: Column, key: Column) -> Column:
        function, threads = self.function, self.threads

        def one(text):
            try:
                return function(text)
            except Exception:  # a failed call is an answer of its own
                return None

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            with ThreadPoolExecutor(threads) as pool:
                for batch in batches:
                    yield pd.Series(list(pool.map(one, batch)), dtype=object)

        return run(prompt)


def after_marker(answer: Column, marker: str) -> Column:
    """What follows a reasoning marker; null without the marker."""
    return F.when(F.contains(answer, F.lit(marker)), F.substring_index(answer, marker, -1))


def valid_records(records: DataFrame, least_fakes: int, limit: int | None, id_col: str = "doc_id") -> DataFrame:
    """Records (id, original, fakes) with a text and enough fakes; the first `limit` of them by id."""
    fit = records.where((F.trim("original") != "") & (F.size("fakes") >= least_fakes))
    return fit.orderBy(id_col).limit(limit) if limit else fit


def chosen_fakes(fakes: Column, n: int, seed: int, key: Column, combination: Column) -> Column:
    """array<struct<h, fake_index, text>>: n fakes without replacement, drawn by hash. Row-local, so nothing is shuffled."""
    drawn = F.transform(fakes, lambda text, i: F.named_struct(F.lit("h"), draw(seed, key, combination, i), F.lit("fake_index"), i, F.lit("text"), text))
    return F.slice(F.array_sort(drawn), 1, n)


def pair_tasks(records: DataFrame, n: int = 3, seed: int = 42, limit: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Two tasks for each original and chosen fake, one in either order: id, pair_id, order, real_option_id, prompt."""
    base = valid_records(records, 1, limit, id_col)
    chosen = F.explode(chosen_fakes(F.col("fakes"), n, seed, F.col(id_col), F.lit(0))).alias("f")
    orders = F.explode(F.array(F.lit("original_first"), F.lit("fake_first"))).alias("order")
    rows = base.select(id_col, "original", chosen).select(id_col, F.concat_ws(":", id_col, "f.fake_index").alias("pair_id"), "original", F.col("f.text").alias("fake"), orders)
    first = F.col("order") == "original_first"
    options = F.array(F.when(first, F.col("original")).otherwise(F.col("fake")), F.when(first, F.col("fake")).otherwise(F.col("original")))
    return rows.select(id_col, "pair_id", "order", F.when(first, 1).otherwise(2).alias("real_option_id"), prompt(options).alias("prompt"))


def mix_tasks(records: DataFrame, n: int = 3, combinations: int = 1, seed: int = 42, limit: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """For each record and combination a task of the original among n fakes, in hash order: id, combination_id,
    num_options, real_option_id, prompt. Records with fewer fakes give none."""
    base = valid_records(records, n, limit, id_col).select(id_col, "original", "fakes", F.explode(F.sequence(F.lit(0), F.lit(combinations - 1))).alias("combination_id"))
    key, combo = F.col(id_col), F.col("combination_id")
    option = lambda i, text: F.named_struct(F.lit("h"), draw(seed, key, combo, F.lit("option"), i), F.lit("fake_index"), i, F.lit("text"), text)
    fakes = F.transform(chosen_fakes(F.col("fakes"), n, seed, key, combo), lambda x: option(x["fake_index"], x["text"]))
    rows = held(base, o=F.array_sort(F.concat(fakes, F.array(option(F.lit(-1), F.col("original"))))))
    texts = F.transform("o", lambda x: x["text"])
    return rows.select(id_col, "combination_id", F.size("o").alias("num_options"), F.array_position(F.transform("o", lambda x: x["fake_index"]), F.lit(-1)).cast("int").alias("real_option_id"), prompt(texts, counted=True).alias("prompt"))


def filled(line: str, value: Column) -> Column:
    before, after = line.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def prompt(options: Column, counted: bool = False) -> Column:
    """The question over an array of options."""
    blocks = F.transform(options, lambda text, i: F.concat(filled(QUESTION_OPTION, i + 1), F.lit("\n"), F.trim(text), F.lit("\n")))
    head = [F.lit(QUESTION), *([filled(QUESTION_COUNT, F.size(options))] if counted else []), F.lit(QUESTION_ORDER), F.lit(""), F.lit(QUESTION_LIST)]
    return F.concat_ws("\n", *head, F.array_join(blocks, "\n"), F.lit(QUESTION_END_COUNT if counted else QUESTION_END))


def parsed_answer(answer: Column, options: Column) -> Column:
    """struct<status, predicted>: error for null; undecided for its phrases and for -1; else the first whole number, or
    the least numeral in words, if it is an option; else error."""
    text = F.trim(answer)
    phrase = F.lit(False)
    for p in UNDECIDED:
        phrase = phrase | F.contains(F.lower(text), F.lit(p))
    minus = text.rlike(r"(?<![0-9])-\s*1(?![0-9])")
    number = F.regexp_extract(text, r"(?U)\b([1-9][0-9]*)\b", 1)
    value = F.when((number != "") & (F.length(number) <= 9), number.cast("int"))
    word = F.coalesce(*[F.when(F.contains(text, F.lit(c)) & (F.lit(i) <= options), F.lit(i)) for i, c in enumerate(NUMERALS, 1)])
    predicted = F.when(value <= options, value).otherwise(word)
    status = F.when(text.isNull(), "error").when(phrase | minus, "undecided").when(predicted.isNotNull(), "answered").otherwise("error")
    return F.struct(status.alias("status"), F.when(status == "answered", predicted).alias("predicted"))


def outcome(parsed: Column, real: Column) -> Column:
    return F.when(parsed["status"] == "answered", F.when(parsed["predicted"] == real, "correct").otherwise("incorrect")).otherwise(parsed["status"])


def pair_summary(results: DataFrame) -> DataFrame:
    """One row over results (pair_id, outcome). A pair with fewer than two results is missing and undecided; it is
    correct or incorrect if all its results are; else undecided, also with errors. Rates are null over nothing."""
    pairs = results.groupBy("pair_id").agg(F.count("*").alias("n"), F.min(F.col("outcome") == "correct").alias("all_correct"), F.min(F.col("outcome") == "incorrect").alias("all_incorrect"))
    verdict = F.when(F.col("n") < 2, "undecided").when(F.col("all_correct"), "correct").when(F.col("all_incorrect"), "incorrect").otherwise("undecided")
    judged = pairs.select("n", verdict.alias("v"))
    count = lambda v: F.count_if(F.col("v") == v)
    return judged.agg(
        F.count("*").alias("pairs"),
        count("correct").alias("correct"),
        count("incorrect").alias("incorrect"),
        count("undecided").alias("undecided"),
        F.count_if(F.col("n") < 2).alias("missing"),
        F.round(F.try_divide(count("correct"), count("correct") + count("incorrect")), 6).alias("accuracy"),
        F.round(F.try_divide(count("undecided"), F.count("*")), 6).alias("undecided_rate"),
    )


def _counts() -> list[Column]:
    return [F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("correct", "incorrect", "undecided", "error")]]


def mix_summary(results: DataFrame) -> DataFrame:
    """One row over results (outcome); rates over what is no error, null if all is."""
    valid = F.col("total") - F.col("error")
    return results.agg(*_counts()).select(
        "*",
        F.round(F.try_divide(F.col("incorrect") + F.col("undecided"), valid), 6).alias("incorrect_plus_undecided_rate"),
        F.round(F.try_divide(F.col("correct"), valid), 6).alias("correct_rate"),
    )


def mix_by_size(results: DataFrame) -> DataFrame:
    """By number of options: tasks, correct ones, and their share (errors count in it)."""
    return results.groupBy("num_options").agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "correct").alias("correct")).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))


def counters(records: DataFrame, least_fakes: int, limit: int, id_col: str = "doc_id") -> DataFrame:
    """loaded, processed, valid, skipped: records are processed in order of id until `limit` valid ones are found."""
    # The texts are made once; both passes are over ids and flags.
    flagged = written(records.select(id_col, F.coalesce((F.trim("original") != "") & (F.size("fakes") >= least_fakes), F.lit(False)).alias("ok")))
    last = flagged.where("ok").orderBy(id_col).limit(limit).agg(F.max(id_col).alias("last"), F.count("*").alias("valid"))
    met = flagged.crossJoin(F.broadcast(last))  # one row
    done = F.when((F.col("valid") < limit) | (F.col(id_col) <= F.col("last")), 1)
    return met.agg(F.count("*").alias("loaded"), F.count(done).alias("processed"), F.max("valid").alias("valid")).withColumn("skipped", F.col("processed") - F.col("valid"))
