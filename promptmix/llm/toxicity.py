"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and of word beginnings (so that inflected forms share weight) is
trained in numpy from confirmed toxic documents (positives) and unlabelled documents. The risk is  pi * E_P[l(f)] + max(0, E_U[l(-f)] - pi * E_P[l(-f)])  with the logistic
loss: the second term estimates the risk on clean documents from unlabelled ones, corrected by the class prior
pi, and is kept from going negative by a step in the other direction, as the estimator prescribes. An L1
proximal step keeps only words that matter, so a long text gathers no noise.

Training reads a bounded sample of rows (MAX_POSITIVE, MAX_UNLABELLED, in expectation); scoring covers every
row and the whole text. Cases: null, empty and wordless texts get the score of a document without any known
word; an id that is labelled both ways is positive; repeated rows are one example. Where the labels do not hold both
kinds, or no positive has a word, nothing is known of what is toxic: all scores are 0 and nothing is removed."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, bounded_sample, checkpointed, in_fold, map_texts, named, packed, unpacked, words_of

MAX_POSITIVE = 3_000
MAX_UNLABELLED = 8_000
#: Lengths, in characters, of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6)
CACHED_WORDS = 300_000
#: A word or beginning is a feature if at least so many positives hold it (a quarter of them where they are fewer
#: than four times that), and the commonest of them are kept.
MIN_POSITIVES = 8
MAX_FEATURES = 20_000
EPOCHS = 250
L1 = 3e-4
#: Log odds of a model that knows of nothing toxic.
NOTHING = -30.0


def word_features(word: bytes) -> list[int]:
    """Hashes of a word and of its beginnings; a beginning differs from a word of the same letters."""
    letters = word.decode("utf-8", "replace")
    return [zlib.crc32(word), *(zlib.crc32(letters[:k].encode(), 1) for k in BEGINNINGS if len(letters) > k)]


def text_features(text) -> np.ndarray:
    """Hashes of the features that the text has, each once, sorted."""
    return np.unique(np.array([h for w in set(words_of(text)) for h in word_features(w)], dtype=np.int64))


class Model:
    def __init__(self, bias: float, weights: dict[int, float]):
        self.bias, self.weights = bias, weights

    def scorer(self):
        weights, cache = self.weights, {}

        def logit(text) -> float:
            found: set[int] = set()
            for word in set(words_of(text)):
                known = cache.get(word)
                if known is None:  # the features of a word that have weight
                    known = cache[word] = tuple(h for h in word_features(word) if h in weights)
                if known:
                    found.update(known)
            return self.bias + sum(weights[h] for h in sorted(found))

        def run(texts):
            if len(cache) > CACHED_WORDS:
                cache.clear()
            scores = 1 / (1 + np.exp(-np.clip([logit(t) for t in texts], -30, 30)))
            return [scores]

        return run


def enough_positives(positives: int) -> int:
    return max(1, min(MIN_POSITIVES, positives // 4))


def vocabulary(counted: list[tuple[int, int]], positives: int) -> np.ndarray:
    """The features held by enough positives, the commonest at most MAX_FEATURES, sorted; from (feature, count)."""
    enough = enough_positives(positives)
    return np.sort(np.array([w for w, n in sorted(counted, key=lambda x: (-x[1], x[0])) if n >= enough][:MAX_FEATURES], dtype=np.int64))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the risk of the log odds of positives and of unlabelled documents: that of toxic documents, and
    that of clean ones before it is kept from going negative."""
    loss = lambda z: np.logaddexp(0, -z).mean()
    return prior * loss(fp), loss(-fu) - prior * loss(-fp)


def step(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives by the log odds: of the whole risk, or where the clean term is negative, of that term in reverse."""
    clean_p, clean_u = -prior * _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
    if risk(fp, fu, prior)[1] >= 0:
        return -prior * _sigmoid(-fp) / len(fp) + clean_p, clean_u
    return -clean_p, -clean_u


def fit(words: np.ndarray, positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], prior: float, epochs: int = EPOCHS, l1: float = L1) -> Model:
    """words: the features. positive, unlabelled: the number of features in each document, and the indexes in words
    of all of them, one document after another."""
    prior = min(max(prior, 1e-3), 0.999)
    start = float(np.log(prior / (1 - prior)))
    if not len(words) or not len(positive[0]) or not len(unlabelled[0]):
        return Model(NOTHING, {})
    (p_size, pc), (u_size, uc) = positive, unlabelled
    pr, ur = np.repeat(np.arange(len(p_size)), p_size), np.repeat(np.arange(len(u_size)), u_size)
    n_p, n_u, m = len(p_size), len(u_size), len(words)
    w, b = np.zeros(m), start
    mom, vel = np.zeros(m + 1), np.zeros(m + 1)
    for epoch in range(1, epochs + 1):
        fp = b + np.bincount(pr, w[pc], n_p)
        fu = b + np.bincount(ur, w[uc], n_u)
        gp, gu = step(fp, fu, prior)
        grad = np.concatenate((np.bincount(pc, gp[pr], m) + np.bincount(uc, gu[ur], m), [gp.sum() + gu.sum()]))
        mom = 0.9 * mom + 0.1 * grad
        vel = 0.999 * vel + 0.001 * grad**2
        rate = 0.1
        move = rate * (mom / (1 - 0.9**epoch)) / (np.sqrt(vel / (1 - 0.999**epoch)) + 1e-4)
        w -= move[:m]
        b -= move[m]
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1 / (np.sqrt(vel[:m] / (1 - 0.999**epoch)) + 1e-4))
    return Model(float(b), {int(k): float(v) for k, v in zip(words, w, strict=True) if v})


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """fold = (modulus, remainder): rows of that crc32 remainder take no part in training."""
    use = ~in_fold(id_col, *fold) if fold else F.lit(True)
    known = labels.where(use & named(label_col).isNotNull() & named(id_col).isNotNull()).select(named(id_col).cast("string").alias("id"), named(label_col).cast("double").alias("y"))
    prior, most, least = known.agg(F.avg("y"), F.max("y"), F.min("y")).first()
    if prior is None or most < 0.5 or least >= 0.5:
        return Model(NOTHING, {})
    # At most max_positive ids in expectation: bounded, so it can be broadcast.
    positive = bounded_sample(known.where("y >= 0.5").select("id").distinct(), "id", max_positive, seed=11).withColumn("__positive", F.lit(True))
    used = docs.where(use).select(named(id_col).cast("string").alias("id"), named(text_col).cast("string").alias("text"))
    # One scan gathers both samples, which are bounded, and writes them; a repeated row is taken once.
    rows = used.select("id").count()
    drawn = F.col("id").isNotNull() & (F.pmod(F.xxhash64(F.lit(13), F.col("id")), F.lit(1 << 30)) < int(min(1.0, max_unlabelled / max(rows, 1)) * (1 << 30)))
    sample = used.join(F.broadcast(positive), "id", "left").select("id", "text", F.xxhash64("text").alias("__hash"), F.coalesce("__positive", F.lit(False)).alias("__positive"), drawn.alias("__drawn"))
    sample = checkpointed(sample.where("__positive or __drawn").dropDuplicates(["id", "__hash"]))
    sample = bounded_rows(bounded_rows(sample, "__positive", max_positive, 31, "id", "__hash"), "__drawn", max_unlabelled, 37, "id", "__hash")
    marked = sample.where("__positive")
    held = map_texts(marked, lambda: lambda found: [[text_features(t) for t in found]], "found array<bigint>", "text", [])
    n_positive = marked.count()
    counts = held.select(F.explode("found").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") >= enough_positives(n_positive)).orderBy(F.desc("n"), "w").limit(MAX_FEATURES)
    words = vocabulary([tuple(r) for r in top.collect()], n_positive)

    def make():
        place = {w: i for i, w in enumerate(words.tolist())}
        return lambda found: [[sorted(place[h] for h in text_features(t).tolist() if h in place) for t in found]]

    table = map_texts(sample, make, "found array<int>", "text", ["__positive", "__drawn"]).toArrow()
    parts = []
    for flag in ("__positive", "__drawn"):
        lists = table.filter(table[flag])["found"]
        parts.append((pa.compute.list_value_length(lists).to_numpy(), pa.compute.list_flatten(lists).to_numpy()))
    return fit(words, *parts, float(prior))


def annotate(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, score_col: str = "toxicity") -> DataFrame:
    """docs with a column of scores from 0 to 1, in one pass without a shuffle."""
    return map_texts(docs, model.scorer, f"{score_col} double", text_col, keep)


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs whose score is below the threshold; the columns of docs, whatever their names. A model without any weight
    has no evidence against a document, so nothing goes."""
    if not model.weights:
        return docs
    rows = annotate(packed(docs, text=named(text_col)), model, "text", ["__row"], "score")
    return unpacked(rows.where(F.col("score") < threshold), docs.columns)
