"""Quality by regularised quadratic discriminant analysis.

Statistics of a text (lengths, character classes, repetition), each by a log or logit transform, are modelled
by one Gaussian a class. Each class covariance is shrunk towards the pooled one and then towards a multiple of
the identity. Scores come from the difference of the Mahalanobis log densities through cached Cholesky factors.

Training reads a bounded sample of labelled rows (MAX_ROWS in expectation); scoring covers every row and the
whole text. Cases: null and empty texts are scored as texts of zero counts; an id that is labelled both ways is of
class 1; repeated rows are one example; with fewer than two examples of a class, every row gets the share of class 1
(0.5 without any)."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, bounded_sample, in_fold, map_texts, named, utf8

MAX_ROWS = 20_000
#: Weight of the pooled covariance in each class covariance, and of the scaled identity in the sum.
TO_POOLED = 0.1
TO_IDENTITY = 0.02

# Classes of bytes: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 common marks, 6 other marks, 7 first byte beyond ASCII, 8 later byte.
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 32]], _CLASS[[10, 13]] = 3, 4
_CLASS[[ord(c) for c in ".,;:'\"-()?!"]] = 5
_CLASS[192:256], _CLASS[128:192] = 7, 8


def features(text: str | None) -> list[float]:
    raw = utf8(text)
    lower, upper, digit, space, end, common, other, first, _ = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=9).tolist()
    chars = lower + upper + digit + space + end + common + other + first
    words = raw.split()
    n = len(words)
    counts = Counter(words)
    lines = raw.split(b"\n")
    top = max(counts.values(), default=0)
    marks = raw.count(b"!") + raw.count(b"?")
    share = lambda part, whole: float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))
    return [
        np.log1p(chars),
        np.log((chars - space - end + 1) / (n + 1)),
        share(upper, lower + upper + first),
        share(digit, chars),
        share(common, chars),
        share(other, chars),
        share(marks, chars),
        share(first, lower + upper + first),
        share(len(counts), n),
        share(top, n),
        share(len(set(lines)), len(lines)),
        np.log((n + 1) / (raw.count(b".") + 1)),
    ]


class Model:
    """Class means, Cholesky factors of the shrunk covariances, and log priors."""

    def __init__(self, means, factors, log_prior):
        self.means, self.factors, self.log_prior = means, factors, log_prior
        self.whiten = [np.linalg.inv(f) for f in factors]  # of triangular factors of a few statistics

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, factor, whiten, prior in zip(self.means, self.factors, self.whiten, self.log_prior, strict=True):
            z = whiten @ (x - mean).T
            density.append(prior - 0.5 * (z**2).sum(axis=0) - np.log(np.diag(factor)).sum())
        return density[1] - density[0]

    def scores(self, texts) -> np.ndarray:
        if len(self.means) < 2:
            return np.full(len(texts), self.log_prior[0])
        return 1 / (1 + np.exp(-np.clip(self.log_odds(np.array([features(t) for t in texts])), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Model:
    parts = [x[y == k] for k in (0, 1)]
    if min(map(len, parts)) < 2:
        return Model([], [], [float(y.mean()) if len(y) else 0.5])
    pooled = sum(np.cov(p.T, bias=True) * len(p) for p in parts) / len(x)
    means, factors, prior = [], [], []
    for part in parts:
        cov = (1 - to_pooled) * np.cov(part.T, bias=True) + to_pooled * pooled
        # The scaled identity in the units of each statistic.
        cov = (1 - to_identity) * cov + to_identity * np.diag(np.diag(pooled) + 1e-6)
        means.append(part.mean(axis=0))
        factors.append(np.linalg.cholesky(cov))
        prior.append(float(np.log(len(part) / len(x))))
    return Model(means, factors, prior)


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """fold = (modulus, remainder): rows of that crc32 remainder take no part in training."""
    use = ~in_fold(id_col, *fold) if fold else F.lit(True)
    known = labels.where(use & named(label_col).isNotNull() & named(id_col).isNotNull()).select(named(id_col).cast("string").alias("id"), named(label_col).cast("int").alias("__y"))
    # At most max_rows ids in expectation: bounded, so they can be broadcast. Of an id's rows equal texts count once.
    chosen = bounded_sample(known.groupBy("id").agg(F.max("__y").alias("__y")), "id", max_rows, seed=17)
    texts = docs.select(named(id_col).cast("string").alias("id"), named(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.withColumn("__hash", F.xxhash64("text")).dropDuplicates(["id", "__hash"]).withColumn("__used", F.lit(True))
    rows = bounded_rows(texts, "__used", max_rows, 41, "id", "__hash").where("__used")
    got = map_texts(rows, lambda: lambda found: [[features(t) for t in found]], "x array<double>", "text", ["__y"]).toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(features("")))
    return fit(x, got["__y"].to_numpy())


def annotate(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, score_col: str = "quality_score") -> DataFrame:
    """docs with a column of scores from 0 to 1, in one pass without a shuffle."""
    return map_texts(docs, lambda: lambda texts: [model.scores(texts)], f"{score_col} double", text_col, keep)
