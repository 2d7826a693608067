"""Language-model scoring with a probabilistic suffix tree.

A text is lower-cased (A-Z) and cut at white space; the words joined by one space and closed by an end mark are a
sequence of bytes. Every context of up to DEPTH bytes that occurs in training is a candidate, whatever its count. It
is retained if its next-symbol distribution diverges from that of its longest retained suffix by at least DIVERGENCE
(count times Kullback-Leibler divergence, in nats), so the tree grows with the training text. Distributions are
smoothed towards that suffix by the Witten-Bell rule, down to the uniform one over bytes. A symbol is scored by
the longest retained suffix of what stands before it.

The tree is never in one place. Contexts of up to UPPER bytes (at most 256 ** UPPER) come to the driver; longer ones
are dealt by their nearest UPPER + 1 bytes, so a context meets all its longer suffixes in one task, which grows its
part of the tree and scores the grams of the texts in it. The scores of the FREQUENT_GRAMS commonest grams travel to
the executors (a bounded table), those of all others meet their texts in a join.

Beside it goes the unigram score over words and the end mark, with add-one smoothing. Its counts are exact, over
all training tokens: the FREQUENT commonest words travel to the executors (a bounded table), the counts of all
others are met in a join. Words are told apart by 64-bit hashes.

Cases: null is the empty text, which has the end mark only; without training rows the tree is the uniform
distribution; rows that repeat an id are scored one by one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, checkpointed, least_of_top, named, slices, small_batches, utf8

DEPTH = 5
DIVERGENCE = 8.0
#: Context bytes up to which the tree is known to every task.
UPPER = 2
FREQUENT = 200_000
FREQUENT_GRAMS = 2_000_000
BLOCK_BYTES = 1_000_000
#: Distinct words or grams that a task holds before it sends their counts on.
HELD_WORDS = 300_000
HELD_GRAMS = 1_500_000
END = 0x0A


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased."""
    return utf8(text).translate(LOWER_BYTES).split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def grams(texts: list[list[bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every symbol with the `depth` symbols before it (the symbol is the lowest byte), text by text,
    and the number of symbols of each text."""
    pad = bytes([END]) * depth
    joined = [b" ".join(words) + b"\n" for words in texts]
    raw = np.frombuffer(pad + pad.join(joined), dtype=np.uint8).astype(np.uint64)
    code = raw[depth:].copy()
    for k in range(1, depth + 1):
        code |= raw[depth - k : len(raw) - k] << np.uint64(8 * k)
    sizes = np.array([len(j) for j in joined], dtype=np.int64)
    keep = np.ones(len(code), dtype=bool)
    if len(joined) > 1 and depth:
        ends = np.cumsum(sizes[:-1] + depth)
        for k in range(1, depth + 1):
            keep[ends - k] = False  # the marks between texts
    return code[keep], sizes


class Tree:
    """The retained contexts of each depth (sorted codes) and, for listed symbols, natural log probabilities."""

    def __init__(self, depth: int = DEPTH):
        self.depth = depth
        empty = np.zeros(0, dtype=np.uint64)
        self.contexts = [empty for _ in range(depth + 1)]
        self.rest = [np.zeros(0) for _ in range(depth + 1)]  # log factor for symbols that are not listed
        self.entries = [empty for _ in range(depth + 1)]
        self.logs = [np.zeros(0) for _ in range(depth + 1)]
        self.root = np.full(256, -np.log(256.0))

    @staticmethod
    def _at(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return at, table[at] == wanted

    def log_prob(self, codes: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Natural log probability of the lowest byte of each code after the `depth` bytes above it."""
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        for k in range(self.depth if depth is None else depth, 0, -1):
            if not len(open_):
                break
            code = codes[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            at, there = self._at(self.contexts[k], code >> np.uint64(8))
            place, listed = self._at(self.entries[k], code)
            listed &= there
            out[open_[listed]] += self.logs[k][place[listed]] if len(self.logs[k]) else 0
            passed = there & ~listed
            out[open_[passed]] += self.rest[k][at[passed]] if len(self.rest[k]) else 0
            open_ = open_[~listed]
        out[open_] += self.root[(codes[open_] & np.uint64(255)).astype(np.int64)]
        return out


class Remembered:
    """Log probabilities of codes, with those of recent codes in a table of fixed size (a place for each hash)."""

    BITS = 20

    def __init__(self, tree: Tree):
        self.tree = tree
        self.codes = np.full(1 << self.BITS, np.uint64((1 << 64) - 1))  # no code is that long
        self.logs = np.zeros(1 << self.BITS)

    def place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        place = self.place(codes)
        out, new = self.logs[place], self.codes[place] != codes
        fresh, inverse = np.unique(codes[new], return_inverse=True)
        logs = self.tree.log_prob(fresh)
        out[new] = logs[inverse]
        place = self.place(fresh)
        self.codes[place], self.logs[place] = fresh, logs
        return out


class Listed:
    """Natural log probabilities of listed codes (sorted), NaN for all others."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        self.codes, self.logs = codes, logs

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        at, there = Tree._at(self.codes, codes)
        return np.where(there, self.logs[at], np.nan) if len(self.codes) else np.full(len(codes), np.nan)


def by_length(codes: np.ndarray, n: np.ndarray, lengths) -> tuple[dict[int, tuple], dict[int, tuple]]:
    """Contexts and entries of the given lengths, as `grow` takes them, from gram codes and their counts."""
    contexts, entries = {}, {}
    for k in lengths:
        own, at = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        count = np.bincount(at, n, len(own)).astype(np.int64)
        above, at = np.unique(own >> np.uint64(8), return_inverse=True)
        contexts[k] = above, np.bincount(at, count, len(above)).astype(np.int64), np.bincount(at, minlength=len(above))
        entries[k] = own, count
    return contexts, entries


def grow(contexts: dict[int, tuple], entries: dict[int, tuple], depth: int = DEPTH, divergence: float = DIVERGENCE, upper: Tree | None = None) -> Tree:
    """The tree from the candidates of each length, or its part below an upper tree (contexts of up to UPPER bytes).

    contexts[k]: sorted codes, symbols seen after them, distinct symbols among these. entries[k]: sorted codes of
    context and symbol, counts. Both may lack some candidates."""
    tree = Tree(depth)
    if upper:
        tree.root = upper.root
        for k in range(min(UPPER, depth) + 1):
            tree.contexts[k], tree.rest[k], tree.entries[k], tree.logs[k] = upper.contexts[k], upper.rest[k], upper.entries[k], upper.logs[k]
        return _lengthened(tree, contexts, entries, range(UPPER + 1, depth + 1), divergence)
    codes, counts = entries.get(0, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    seen = contexts[0][1][0] if 0 in contexts and len(contexts[0][0]) else 0
    listed = np.zeros(256)
    listed[codes.astype(np.int64)] = counts
    left = max(0, seen - listed.sum())
    share = listed + np.where(listed > 0, 0, left / max(1, (listed == 0).sum()))
    tree.root = np.log((share + 1) / (share.sum() + 256))
    return _lengthened(tree, contexts, entries, range(1, depth + 1), divergence)


def _lengthened(tree: Tree, contexts: dict[int, tuple], entries: dict[int, tuple], lengths: range, divergence: float) -> Tree:
    for k in lengths:
        if k not in contexts or not len(contexts[k][0]):
            break
        context, total, distinct = contexts[k]
        code, n = entries.get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        owner, there = tree._at(context, code >> np.uint64(8))
        code, n, owner = code[there], n[there], owner[there]
        above = tree.log_prob(code, k - 1)
        p_above = np.exp(above)
        p_here = n / total[owner]
        gain = np.bincount(owner, n * (np.log(p_here) - above), len(context))
        listed_n = np.bincount(owner, n, len(context))
        listed_p = np.minimum(np.bincount(owner, p_above, len(context)), 1.0)
        left_n, left_p = np.maximum(total - listed_n, 0), np.maximum(1 - listed_p, 1e-9)
        gain += np.where(left_n > 0, left_n * (np.log(np.maximum(left_n, 1) / total) - np.log(left_p)), 0)
        kept = gain >= divergence
        logs = np.log((n + distinct[owner] * p_above) / (total[owner] + distinct[owner]))
        rest = np.log((left_n + distinct * left_p) / ((total + distinct) * left_p))
        tree.contexts[k], tree.rest[k] = context[kept], rest[kept]
        tree.entries[k], tree.logs[k] = code[kept[owner]], logs[kept[owner]]
    return tree


def count(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, only_grams: bool = False) -> DataFrame:
    """kind, key, n: counts of words (kind 0, by hash), grams (1) and texts (2) over all rows of docs.

    A task adds up what it reads, so a word or gram goes out about once from each; the sums are spread."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow.compute  # noqa: F401

        from collections import Counter

        words: Counter = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        texts_seen = 0

        def out(kind, keys, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, dtype=np.int8)), pa.array(keys, type=pa.int64()), pa.array(n, type=pa.int64())], names=["kind", "key", "n"])

        def merged():
            keys, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return [(keys[first], np.add.reduceat(n, first))]

        for piece in slices(batches, 0, BLOCK_BYTES):
            split = [words_of(t) for t in piece.column(0).to_pylist()]
            texts_seen += len(split)
            for one in () if only_grams else split:
                words.update(one)
            parts.append(np.unique(grams(split, depth)[0], return_counts=True))
            if len(words) > HELD_WORDS:
                yield out(0, [word_hash(w) for w in words], list(words.values()))
                words.clear()
            if sum(len(p[0]) for p in parts) > HELD_GRAMS:
                parts = merged()
                if len(parts[0][0]) > HELD_GRAMS // 2:
                    yield out(1, parts[0][0].astype(np.int64), parts[0][1])
                    parts = []
        if words:
            yield out(0, [word_hash(w) for w in words], list(words.values()))
        if parts:
            parts = merged()
            yield out(1, parts[0][0].astype(np.int64), parts[0][1])
        if texts_seen:
            yield out(2, [0], [texts_seen])

    counted = docs.select(named(text_col).cast("string")).mapInArrow(run, "kind tinyint, key bigint, n bigint")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Grown:
    """A tree that is spread over tasks: the upper tree, and the gram counts from which each task grows its part."""

    def __init__(self, grams: DataFrame, upper: Tree, divergence: float):
        self.grams, self.upper, self.divergence = grams, upper, divergence
        self.depth = upper.depth

    def log_probs(self, wanted: DataFrame) -> DataFrame:
        """key, n, log: the natural log probability of the last symbol of each gram of wanted (key, n; keys distinct)."""
        zero = F.lit(0).cast("long")
        both = self.grams.select("key", F.col("n").alias("t"), zero.alias("n")).unionByName(wanted.select("key", zero.alias("t"), "n"))
        both = both.groupBy("key").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        # All longer contexts of one place are dealt to one task.
        dealt = both.repartition(F.shiftright("key", 8).bitwiseAND((1 << 8 * (UPPER + 1)) - 1))
        upper, depth, divergence = self.upper, self.depth, self.divergence

        def run(batches):
            held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
            if not held:
                return
            key, t, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            code, trained = key.astype(np.uint64), t > 0
            tree = grow(*by_length(code[trained], t[trained], range(UPPER + 1, depth + 1)), depth, divergence, upper)
            asked = np.flatnonzero(n > 0)
            for at in range(0, len(asked), HELD_GRAMS):
                rows = asked[at : at + HELD_GRAMS]
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(n[rows]), pa.array(tree.log_prob(code[rows]))], names=["key", "n", "log"])

        return dealt.mapInArrow(run, "key bigint, n bigint, log double")


def train_tree(counts: DataFrame, depth: int = DEPTH, divergence: float = DIVERGENCE) -> Grown:
    """The tree from the gram counts. Grams of UPPER + 1 bytes come to the driver, all others stay where they are."""
    grams_seen = counts.where("kind = 1").select("key", "n")
    short = grams_seen.groupBy(F.col("key").bitwiseAND((1 << 8 * (UPPER + 1)) - 1).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    code, n = short["code"].to_numpy().astype(np.uint64), short["n"].to_numpy()
    upper = grow(*by_length(code, n, range(UPPER + 1)), depth, divergence) if len(code) else Tree(depth)
    return Grown(grams_seen, upper, divergence)


def score(docs: DataFrame, counts: DataFrame, tree: Grown, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, frequent: int = FREQUENT, frequent_grams: int = FREQUENT_GRAMS) -> DataFrame:
    """id and kept columns, n_tokens, n_known, train_tokens, base_score and score for each row.

    Each row is read twice: for the grams to be scored, then for the scores. Words outside the frequent ones go to a
    join with their counts as (row, hash, times), grams outside the frequent ones with their scores in the same way."""
    keep = keep or []
    totals = counts.where("kind <> 1").agg(
        F.sum("n").alias("tokens"),
        F.count(F.when(F.col("kind") == 0, 1)).alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("n"))), F.lit(0)).alias("ends"),
    ).first()
    tokens, distinct, ends = int(totals["tokens"] or 0), int(totals["distinct"] or 0) + (1 if totals["ends"] else 0), int(totals["ends"] or 0)
    per_token = float(np.log10(tokens + distinct + 1))
    # Words of this count or more travel to the executors; all others, if there are any, meet theirs in a join.
    words = counts.where("kind = 0").select("key", "n")
    least = least_of_top(words, frequent)
    common = words.where(F.col("n") >= (least if least else 1 << 62)).toArrow()
    hashes = common["key"].to_numpy()
    order = np.argsort(hashes)
    hashes, values = hashes[order], np.log10(common["n"].to_numpy()[order].astype(float) + 1)
    logs = checkpointed(tree.log_probs(count(docs, text_col, tree.depth, only_grams=True).where("kind = 1").select("key", "n")))
    least_gram = least_of_top(logs, frequent_grams)
    usual = logs.where(F.col("n") >= (least_gram if least_gram else 1 << 62)).select("key", "log").toArrow()
    codes = usual["key"].to_numpy().astype(np.uint64)
    order = np.argsort(codes)
    listed, depth = Listed(codes[order], usual["log"].to_numpy()[order]), tree.depth
    joins = common.num_rows < distinct - (1 if ends else 0) or usual.num_rows < logs.count()
    kept = list(dict.fromkeys([id_col, *keep]))
    source = docs.select(*map(named, kept), named(text_col).cast("string").alias("__text"))
    width = len(kept)
    types = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        import pyarrow.compute  # noqa: F401

        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        known: dict[bytes, int] = {}
        rare: list[int] = []
        remembered = Remembered(listed)
        for piece in slices(batches, width, BLOCK_BYTES):
            split = [words_of(t) for t in piece.column(width).to_pylist()]
            if len(known) > HELD_WORDS:
                known.clear()
                rare.clear()
            fresh = list(set().union(*split).difference(known))
            if fresh:
                hashed = np.array([word_hash(w) for w in fresh], dtype=np.int64)
                at = np.minimum(np.searchsorted(hashes, hashed), max(len(hashes) - 1, 0))
                common_word = hashes[at] == hashed if len(hashes) else np.zeros(len(hashed), dtype=bool)
                # Frequent words by their place, others by one below zero.
                new = np.where(common_word, at, -1 - len(rare) - np.cumsum(~common_word) + 1)
                rare.extend(hashed[~common_word].tolist())
                known.update(zip(fresh, new.tolist(), strict=True))
            codes, sizes = grams(split, depth)
            logs = remembered.log_prob(codes)
            unusual = np.flatnonzero(np.isnan(logs))
            logs[unusual] = 0
            scores = np.add.reduceat(logs, np.concatenate(([0], np.cumsum(sizes)[:-1]))) / np.log(10)
            # Text and code of each other gram, once, with how often it occurs there.
            holder, code = np.searchsorted(np.cumsum(sizes), unusual, side="right"), codes[unusual].astype(np.int64)
            by_text = np.lexsort((code, holder))
            holder, code = holder[by_text], code[by_text]
            begins = np.flatnonzero(np.concatenate(([True], (holder[1:] != holder[:-1]) | (code[1:] != code[:-1])))) if len(code) else by_text
            holder, code, gram_times = holder[begins], code[begins], np.diff(np.append(begins, len(code)))
            base, n_known, others, rows = [], [], [], []
            rare_of = np.array(rare, dtype=np.int64)
            for one in split:
                ids = np.fromiter(map(known.__getitem__, one), dtype=np.int64, count=len(one))
                low = ids[ids < 0]
                base.append(float(values[ids[ids >= 0]].sum()) + (float(np.log10(ends + 1))))
                n_known.append(len(ids) - len(low) + (1 if ends else 0))
                keys, times = np.unique(low, return_counts=True)
                others.append((rare_of[-1 - keys] if len(keys) else keys, times))
                rows.append(row)
                row += 1
            n = piece.num_rows
            # One row for the text itself, then one for each other word of it, then one for each other gram.
            at = np.concatenate([np.arange(n), np.repeat(np.arange(n), [len(k) for k, _ in others]), holder])
            own, gram = np.arange(len(at)) < n, np.arange(len(at)) >= len(at) - len(holder)
            mask = pa.array(own)
            hidden = lambda column, kind: pa.compute.if_else(mask, pa.array(column, type=kind).take(pa.array(at)), pa.scalar(None, type=kind))
            extra = lambda i: np.concatenate([np.zeros(n, dtype=np.int64), *[o[i] for o in others], (code, gram_times)[i]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(rows)[at]), pa.array(own)]
                + [pa.compute.if_else(mask, piece.column(i).take(pa.array(at)), pa.scalar(None, type=piece.column(i).type)) for i in range(width)]
                + [hidden([len(s) + 1 for s in split], pa.int64()), hidden(n_known, pa.int64()), hidden(base, pa.float64()), hidden(scores, pa.float64())]
                + [pa.array(gram, mask=own), pa.array(extra(0), mask=own), pa.array(extra(1), mask=own)],
                names=["__row", "__own", *kept, "__n", "__known", "__base", "__score", "__gram", "key", "__times"],
            )

    spread = source.mapInArrow(run, f"__row bigint, __own boolean, {types}, __n bigint, __known bigint, __base double, __score double, __gram boolean, key bigint, __times bigint")
    others = words.where(F.col("n") < least if least else F.lit(True)).select(F.lit(False).alias("__gram"), "key", F.log10(F.col("n") + 1).alias("__value"))
    others = others.unionByName(logs.where(F.col("n") < least_gram if least_gram else F.lit(True)).select(F.lit(True).alias("__gram"), "key", (F.col("log") / float(np.log(10))).alias("__value")))
    joined = spread.join(others, ["__gram", "key"], "left") if joins else spread.withColumn("__value", F.lit(None).cast("double"))
    times, value = F.coalesce("__times", F.lit(0)), F.coalesce("__value", F.lit(0.0))
    gathered = joined.groupBy("__row").agg(
        F.max(F.when(F.col("__own"), F.struct(*map(named, kept), "__n", "__known", "__base", "__score"))).alias("r"),
        F.sum(F.when(F.col("__gram"), 0.0).otherwise(times * value)).alias("more"),
        F.sum(F.when(F.col("__gram"), times * value).otherwise(0.0)).alias("more_score"),
        F.sum(F.when(F.col("__value").isNotNull() & ~F.col("__gram"), times).otherwise(0)).alias("known"),
    )
    return gathered.select(
        *[F.col("r").getField(c).alias(c) for c in kept],
        F.col("r.__n").alias("n_tokens"),
        (F.col("r.__known") + F.col("known")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("r.__base") + F.col("more") - F.col("r.__n") * per_token).alias("base_score"),
        (F.col("r.__score") + F.col("more_score")).alias("score"),
    )
