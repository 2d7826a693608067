"""Seeded sampling, a bigram language model, probability bands, nearest neighbours, and beam sampling.

Random choices are ranks of md5(seed, key): they do not depend on partitions, and SQL can repeat them."""

from __future__ import annotations

import bisect
import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.held import held
from ..sources.shared import shared_folder, written


def draw(seed, *key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))


def exact_sample(df: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """Exactly k rows without replacement (all if k is 0 or less, or beyond the rows), in the order drawn."""
    ordered = df.orderBy(draw(seed, F.col(id_col)), id_col)
    return ordered.limit(k) if k > 0 else ordered


# A bigram language model.


def bigrams(df: DataFrame, text_col: str = "text") -> DataFrame:
    """prev, next, c, p over all texts, words being lower-cased and cut at white space. The totals come from an
    aggregate of the counted pairs; where a word has very many successors, Spark splits the rows of its join."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\S+"), F.lit(0))
    behind = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("w", F.lit(1), behind).alias("prev"), F.slice("w", F.lit(2), behind).alias("next"))
    counted = held(df.select(text_col), w=words).select(F.explode(pairs).alias("x")).groupBy("x.prev", "x.next").agg(F.count("*").alias("c"))
    totals = counted.groupBy("prev").agg(F.sum("c").alias("t"))
    return counted.join(totals, "prev").select("prev", "next", "c", (F.col("c") / F.col("t")).alias("p"))


def in_relative_band(p: Column, q: Column, intervals: float) -> Column:
    return F.abs(p / q - 1) <= 1 / intervals


def in_absolute_band(p: Column, q: Column, intervals: int) -> Column:
    low = F.floor(q * intervals) / intervals + 1e-3
    return (p >= low) & (p < low + 1 / intervals)


def best_next(lm: DataFrame) -> DataFrame:
    """The most probable next word of each word, the first in order on ties."""
    return lm.groupBy("prev").agg(F.max("p").alias("q"), F.min_by("next", F.struct(-F.col("p"), F.col("next"))).alias("best"))


def first_tier(tiers: DataFrame, key: str) -> DataFrame:
    """Of rows (key, tier, ...) those of the lowest tier that a key has."""
    return tiers.join(tiers.groupBy(key).agg(F.min("tier").alias("tier")), [key, "tier"])


# Nearest neighbours by cosine.


def nearest(df: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 2_000) -> DataFrame:
    """id, neighbour, rank, cosine: the k nearest others of every row. Exact: blocks of rows meet once in half a grid, each
    task multiplies two blocks, and only its k best a row, of either, go on to the merge. The work grows with the square of
    the rows, as an exact answer for all of them asks for. Zero vectors and null ones have cosine 0."""
    n = df.count()
    blocks = max(1, -(-n // block_rows))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = rows.select("id", "v", F.col("b").alias("i"), F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("j"))
    right = rows.select("id", "v", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i"), F.col("b").alias("j"))

    def unit(frame: pd.DataFrame) -> np.ndarray:
        m = np.nan_to_num(np.array(frame["v"].tolist(), dtype=float))
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(size == 0, 1, size)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "neighbour": [], "cosine": []})
        cosine = np.round(unit(a) @ unit(b).T, 6) + 0.0
        mine, theirs = a["id"].to_numpy(), b["id"].to_numpy()
        same = a["i"].iloc[0] == a["j"].iloc[0]
        return pd.concat([top(mine, theirs, cosine), *([] if same else [top(theirs, mine, cosine.T)])])

    def top(mine: np.ndarray, theirs: np.ndarray, cosine: np.ndarray) -> pd.DataFrame:
        cosine = np.where(mine[:, None] == theirs, -np.inf, cosine)
        order = np.lexsort((np.broadcast_to(theirs, cosine.shape), -cosine), axis=1)[:, :k]
        kept = np.take_along_axis(cosine, order, axis=1)
        out = pd.DataFrame({"id": np.repeat(mine, order.shape[1]), "neighbour": theirs[order].ravel(), "cosine": kept.ravel()})
        return out[np.isfinite(out["cosine"])]

    parts = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, "id long, neighbour long, cosine double")
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")))
    return ranked.where(F.col("rank") <= k).select(F.col("id").alias(id_col), "neighbour", "rank", "cosine")


def numbered(df: DataFrame, order: list[str], name: str, bound: int | None = None) -> DataFrame:
    """df (its first `bound` rows) with its places in the order, from 0: rows are dealt by ranges and counted range by range,
    so no task holds them all."""
    ordered = df.orderBy(*ordered_columns(order))
    placed = ordered if bound is None else ordered.limit(bound).orderBy(*ordered_columns(order))
    part = written(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = part.groupBy("__part").agg(F.count("*").alias("n")).collect()
    before, total = {}, 0
    for row in sorted(sizes):
        before[row["__part"]], total = total, total + row["n"]
    if not before:
        return part.withColumn(name, F.lit(0).cast("long")).drop("__part", "__at")
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("__part")).cast("long")
    return part.withColumn(name, start + F.col("__at") - F.col("__part").cast("long") * F.lit(1 << 33)).drop("__part", "__at")


def ordered_columns(order: list[str]) -> list[Column]:
    return [F.col(x.split()[0]).desc() if x.endswith(" DESC") else F.col(x).asc() for x in order]


def without_nearest(neighbours: DataFrame, ratio: float, id_col: str = "vec_id") -> DataFrame:
    """Lists of neighbours (id, rank) without the nearest share of each; the last one of a list always stays."""
    length = F.max("rank").over(Window.partitionBy(id_col))
    return neighbours.withColumn("__n", length).where(F.col("rank") > F.least(F.floor(F.col("__n") * ratio), F.col("__n") - 1)).drop("__n")


# Beam sampling.


#: Words at most, in expectation, in a row of the laid-out model; bytes of paths at most that every task is given at once.
LIST_WORDS, SENT_BYTES = 256, 32_000_000
#: Lists whose words a task holds as Python objects at once.
BATCH_LISTS = 500
#: Paths of whole texts that one task chooses among, in expectation.
TASK_PATHS = 20_000


def laid_out(lm: DataFrame) -> DataFrame:
    """prev, p, nexts: the model with words of the same probability in lists, written once to the shared folder. A band then
    takes or leaves lists, not words; long ones are cut by hash and lie in different tasks, so no word's successors share one."""
    lists = F.greatest(F.lit(1), F.coalesce(F.ceil(F.try_divide(F.lit(1.0), F.col("p") * LIST_WORDS)), F.lit(1))).cast("long")
    rows = lm.select("prev", "next", F.col("p").cast("double").alias("p")).withColumn("part", F.pmod(F.xxhash64("next"), lists))
    folder = f"{shared_folder(lm.sparkSession)}/model-{uuid.uuid4().hex}"
    rows.repartition("prev", "p", "part").groupBy("prev", "p", "part").agg(F.collect_list("next").alias("nexts")).drop("part").write.parquet(folder)
    return lm.sparkSession.read.parquet(folder)


def _drawn(key, start, word: bytes) -> bytes:
    """The hash that a path is drawn by; without an id there is none, as in SQL, and paths come in their own order."""
    if key is None:
        return b""
    start = start.copy()
    start.update(word)
    return start.digest()


def _best_of(gamma: int):
    """Of batches (key, n, head, p, nexts), for each key the gamma paths drawn first, as (key, n, next, p, digest), and a row
    without a word for each other path that has candidates."""

    def run(batches):
        best: dict = {}
        seen = set()
        for batch in (b.slice(i, BATCH_LISTS) for b in batches for i in range(0, b.num_rows, BATCH_LISTS)):
            keys, numbers, ps = (batch.column(i).to_pylist() for i in (0, 1, 3))
            heads = batch.column(2).cast(pa.binary()).to_pylist()
            lists = batch.column(4)
            words, at = lists.flatten().cast(pa.binary()).to_pylist(), 0
            for key, n, head, p, size in zip(keys, numbers, heads, ps, lists.value_lengths().to_pylist(), strict=True):
                seen.add((key, n))
                kept, start = best.setdefault(key, []), hashlib.md5(head)
                for word in words[at : at + size]:
                    digest = _drawn(key, start, word)
                    if len(kept) < gamma or digest <= kept[-1][0]:
                        bisect.insort(kept, (digest, head + word, n, word, p))
                        del kept[gamma:]
                at += size
        rows = [(key, n, word.decode(), p, digest) for key, kept in best.items() for digest, _, n, word, p in kept]
        rows += [(key, n, None, None, None) for key, n in seen - {(key, n) for key, n, *_ in rows}]
        if rows:
            types = (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "n", "next", "p", "digest"])

    return run


def _chosen(gamma: int):
    """Of all paths of whole keys, and of what _best_of found for them, the gamma that are drawn first. A path for which
    nothing was found takes its real word."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        names = ("key", "n", "next", "p", "digest", "q", "weight")
        cols = {c: table.column(c).to_pylist() for c in names} | {c: table.column(c).cast(pa.binary()).to_pylist() for c in ("head", "word")}
        paths = {(cols["key"][i], cols["n"][i]): i for i, head in enumerate(cols["head"]) if head is not None}
        met: dict = {}
        with_any = set()
        for i, head in enumerate(cols["head"]):
            if head is None:
                at = paths[cols["key"][i], cols["n"][i]]
                with_any.add(at)
                if cols["next"][i] is not None:
                    entry = cols["digest"][i], cols["head"][at] + cols["next"][i].encode(), at, cols["next"][i], cols["weight"][at] * cols["p"][i] / cols["q"][at]
                    met.setdefault(cols["key"][i], []).append(entry)
        for (key, _), at in paths.items():
            if at not in with_any:
                head, word = cols["head"][at], cols["word"][at]
                met.setdefault(key, []).append((_drawn(key, hashlib.md5(head), word), head + word, at, word.decode(), cols["weight"][at]))
        kept = [(at, n, word, weight) for every in met.values() for n, (_, _, at, word, weight) in enumerate(sorted(every)[:gamma])]
        at, n, word, weight = zip(*kept, strict=True)
        row = pa.concat_arrays(table.column("row").chunks)
        yield pa.RecordBatch.from_arrays([row.take(pa.array(at)), pa.array(n, pa.int64()), pa.array(word, pa.string()), pa.array(weight, pa.float64())], names=["row", "n", "next", "weight"])

    return run


def beam_step(paths: DataFrame, model: DataFrame, gamma: int, intervals: float, seed: int, small: bool, tasks: int) -> DataFrame:
    """One word further: paths (id, w, qs, path, last, weight, n, k, word, q) take candidates whose probability after `last` is in
    the band about q, that of the real word after its own predecessor, weighted by their ratio; a path without any takes the
    real word. At most gamma paths an id are kept, drawn by hash.

    word: the real word of this step, k: its number, a column so that the code made for one step serves them all. n: tells the
    paths of an id apart. The lists of the model are met where they lie, if the
    paths are few enough to be sent there (small), and each task passes on its gamma best of an id only."""
    head = F.concat(F.concat_ws(":", F.lit(str(seed)), F.col("k").cast("string"), F.col("id").cast("string"), F.array_join("path", " ")), F.lit(" "))
    now = paths.select(F.col("id").cast("string").alias("key"), "n", "last", "word", "q", "weight", head.alias("head"), F.struct("id", "w", "qs", "path", "k").alias("row"))
    asked = now.where("q is not null").select("key", "n", "last", "q", "head")
    # The range, for the join, is a little wider than the band: its products round otherwise than the ratio that decides.
    low, high = (1 - 1 / intervals) * (1 - 1e-9), (1 + 1 / intervals) * (1 + 1e-9)
    band = (F.col("last") == F.col("prev")) & (F.col("p") >= F.col("q") * low) & (F.col("p") <= F.col("q") * high) & in_relative_band(F.col("p"), F.col("q"), intervals)
    lists = model.join(F.broadcast(asked) if small else asked, band).select("key", "n", "head", "p", "nexts")
    found = lists.mapInArrow(_best_of(gamma), "key string, n long, next string, p double, digest binary")
    every = now.unionByName(found, allowMissingColumns=True).repartition(tasks, "key")
    schema = T.StructType([now.schema["row"], *T.StructType.fromDDL("n long, next string, weight double").fields])
    taken = every.mapInArrow(_chosen(gamma), schema)
    return taken.select("row.id", "row.w", "row.qs", F.concat("row.path", F.array("next")).alias("path"), F.col("next").alias("last"), "weight", "n", (F.col("row.k") + 1).alias("k"))


def beams(texts: DataFrame, lm: DataFrame, gamma: int, intervals: float, seed: int = 42, stops: tuple[str, ...] = (), reference_first: bool = False, pad: bool = False, prefixes: DataFrame | None = None) -> DataFrame:
    """id, path, weight: at most gamma look-alikes of each text (id, w: its words), word by word to its end. A path that has
    taken a stop word ends there. The driver loops over places, never over rows; each step is written, so lost executors
    undo one step at most. reference_first puts the real words in front, pad repeats paths in turn up to gamma.

    prefixes (id, path): beams that begin behind other words than the real ones. The real probabilities are the same for all
    beams of a text, whose first word then only tells what stood before; paths come with their prefixes."""
    words = written(texts.where(F.size("w") > 0).select("id", "w").withColumn("t", F.monotonically_increasing_id()))
    longest, rows, signs = words.agg(F.max(F.size("w")), F.count("*"), F.sum(F.length(F.array_join("w", " ")))).first()
    longest, small = longest or 0, gamma * (signs or 0) <= SENT_BYTES
    near = F.broadcast if small else lambda df: df
    model = laid_out(lm)
    # The real words' probabilities, met with the model once, and kept beside the words.
    behind = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(i.alias("step"), F.get("w", i - 1).alias("prev"), F.get("w", i).alias("next")))
    pairs = words.where(F.size("w") > 1).select("t", F.explode(behind).alias("x")).select("t", "x.step", "x.prev", "x.next")
    asked = pairs.select("prev", "next").distinct()
    known = model.join(near(asked.select("prev").distinct()), "prev", "left_semi").select("prev", F.explode("nexts").alias("next"), F.col("p").alias("q")).join(near(asked), ["prev", "next"], "left_semi")
    real = pairs.join(known, ["prev", "next"], "left").groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "q"))), lambda x: x["q"]).alias("qs"))
    now = words.join(real, "t", "left").select("id", "w", "qs", F.slice("w", 1, 1).alias("path"), F.get("w", F.lit(0)).alias("last"), F.lit(1.0).alias("weight"))
    if prefixes is not None:
        now = now.drop("path", "last").join(prefixes.where(F.size("path") > 0), "id").select("id", "w", "qs", "path", F.element_at("path", -1).alias("last"), "weight")
    now = written(now.withColumn("n", F.monotonically_increasing_id()).withColumn("k", F.lit(1)))
    done = None
    for step in range(1, longest):
        met = now.withColumn("word", F.get("w", F.col("k"))).withColumn("q", F.get("qs", F.col("k") - 1))
        ended = F.col("word").isNull() | F.col("last").isin(*stops) if stops else F.col("word").isNull()
        ready = met.where(ended).select("id", "path", "weight")
        done = ready if done is None else done.unionByName(ready)
        now = written(beam_step(met.where(~ended), model, gamma, intervals, seed, small, 1 + rows * gamma // TASK_PATHS))
        if step % 32 == 0:
            done = written(done)
    every = now.select("id", "path", "weight") if done is None else done.unionByName(now.select("id", "path", "weight"))
    if not (reference_first or pad):
        return every
    order = F.row_number().over(Window.partitionBy("id").orderBy("front", F.array_join("path", " "))) - 1
    front = words.select("id", F.col("w").alias("path"), F.lit(1.0).alias("weight"), F.lit(0).alias("front"))
    every = every.withColumn("front", F.lit(1))
    ranked = (every.unionByName(front) if reference_first else every).withColumn("i", order).where(F.col("i") < gamma).drop("front")
    if not pad:
        return ranked.drop("i")
    sizes = ranked.groupBy("id").agg(F.count("*").alias("n"))
    turns = ranked.join(sizes, "id").withColumn("i", F.explode(F.sequence(F.col("i"), F.lit(gamma - 1), F.col("n"))))
    return turns.select("id", "path", "weight")


def spaced_like(candidates: Column, target: Column) -> Column:
    """Candidates that begin with white space if the target does, and without if it does not; the target if none fits."""
    begins = lambda w: w.rlike(r"^\s")
    fit = F.filter(candidates, lambda w: begins(w) == begins(target))
    return F.when(F.size(fit) > 0, fit).otherwise(F.array(target))


def before_suffix(tokens: Column, suffix: Column) -> Column:
    """The tokens up to the first place from which on they agree with the suffix's, loosely: of two tokens at a place one
    begins with the other, and what follows the last of either is free. All of them if there is no such place."""
    tail = lambda i: F.slice(tokens, i + 1, F.size(tokens) - i)
    loose = lambda a, b: a.isNull() | b.isNull() | F.startswith(F.trim(a), F.trim(b)) | F.startswith(F.trim(b), F.trim(a))
    fits = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda i: (F.size(suffix) > 0) & (i < F.size(tokens)) & F.forall(F.zip_with(tail(i), suffix, loose), lambda x: x))
    return F.slice(tokens, 1, F.coalesce(F.array_min(fits), F.size(tokens)))


def pooled_vectors(words: DataFrame, vectors: DataFrame, word_col: str = "word", tokens_col: str = "tokens") -> DataFrame:
    """word, v: the mean of the vectors (token, v) of a word's tokens, at unit length; words without a known token are left out."""
    tokens = words.select(word_col, F.explode(tokens_col).alias("token")).join(vectors.select("token", F.posexplode("v").alias("d", "x")), "token")
    means = tokens.groupBy(word_col, "d").agg(F.avg("x").alias("x")).groupBy(word_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return means.select(word_col, F.transform("v", lambda x: F.coalesce(F.try_divide(x, size), F.lit(0.0))).alias("v"))


def distinct_candidates(df: DataFrame, key: str, word: str, order: str, reference: Column, prob: str, gamma: int) -> DataFrame:
    """Candidates without repeats (by their ASCII letters and digits, the first wins), nearest to the reference
    probability, at most gamma for each key."""
    bare = F.regexp_replace(F.col(word), "[^A-Za-z0-9]", "")
    first = F.row_number().over(Window.partitionBy(key, bare).orderBy(order))
    near = F.row_number().over(Window.partitionBy(key).orderBy(F.abs(F.col(prob) - reference), order))
    return df.withColumn("__f", first).where("__f = 1").withColumn("__n", near).where(F.col("__n") <= gamma).drop("__f", "__n")


def neighbour_words(words: Column, pools: Column, wanted: int, key: Column, seed: int = 42) -> Column:
    """`wanted` phrases for each row: every word replaced by a member of its pool (arrays of arrays), drawn by hash;
    without the phrase itself and without repeats."""

    def phrase(i: Column) -> Column:
        def pick(w: Column, j: Column) -> Column:
            pool = F.get(pools, j)
            at = F.conv(F.substring(draw(seed, key, i, j), 1, 6), 16, 10).cast("int") % F.greatest(F.size(pool), F.lit(1))
            return F.coalesce(F.get(pool, at), w)

        return F.array_join(F.transform(words, pick), " ")

    made = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(max(16, 5 * wanted) - 1)), phrase))
    return F.slice(F.filter(made, lambda x: F.lower(x) != F.lower(F.array_join(words, " "))), 1, wanted)
