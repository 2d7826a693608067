"""Language identification with hyperdimensional profiles.

Every character has a random vector of +1 and -1 derived from its code point and a seed. An n-gram vector binds
its characters: the vectors are rotated by their place and multiplied. A document's profile bundles (sums) its
n-gram vectors, with word ends marked; a language prototype bundles the normalised profiles of its training
documents. A document gets the language of the prototype with the largest cosine.

Prototypes are trained on a bounded sample of the labelled rows of each language (MAX_ROWS in expectation, so a rare
language is not lost among common ones); prediction covers every row and the whole text. Cases: a null text or one without a letter is `und` with score 0; ties go to the
language that sorts first; without any labelled row all is `und`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, map_texts, named, slices, small_batches

DIMENSIONS = 512
N = 3
MAX_ROWS = 2_000
#: Cosines are multiplied by this before the softmax that gives the score.
SHARPNESS = 30.0
#: n-gram vectors remembered by a worker (half a KB each); beyond it the memory starts afresh.
CACHED_GRAMS = 60_000


def letter_vector(code: int, seed: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([seed, code]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


class Encoder:
    """n-gram vectors and document profiles."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = N, seed: int = 20):
        self.dimensions, self.n, self.seed = dimensions, n, seed
        self.letters: dict[int, list[np.ndarray]] = {}
        self.known = np.zeros(0, dtype=np.uint64)
        self.vectors = np.zeros((0, dimensions), dtype=np.int8)

    def rotated(self, code: int) -> list[np.ndarray]:
        if code not in self.letters:
            base = letter_vector(code, self.seed, self.dimensions)
            self.letters[code] = [np.roll(base, k) for k in range(self.n)]
        return self.letters[code]

    def gram_vectors(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct n-gram codes, 21 bits a character."""
        at = np.searchsorted(self.known, grams)
        fresh = grams[(at >= len(self.known)) | (self.known[np.minimum(at, max(len(self.known) - 1, 0))] != grams)] if len(self.known) else grams
        if len(fresh):
            made = np.empty((len(fresh), self.dimensions), dtype=np.int8)
            for row, gram in enumerate(fresh.tolist()):
                vector = self.rotated((gram >> 21 * (self.n - 1)) & 0x1FFFFF)[self.n - 1]
                for k in range(self.n - 1):
                    vector = vector * self.rotated((gram >> 21 * k) & 0x1FFFFF)[k]
                made[row] = vector
            if len(self.known) + len(fresh) > CACHED_GRAMS:
                self.known, self.vectors = np.zeros(0, dtype=np.uint64), np.zeros((0, self.dimensions), dtype=np.int8)
                return self.gram_vectors(grams) if len(fresh) < len(grams) else made
            where = np.searchsorted(self.known, fresh)
            self.known = np.insert(self.known, where, fresh)
            self.vectors = np.insert(self.vectors, where, made, axis=0)
            at = np.searchsorted(self.known, grams)
        return self.vectors[at]

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-gram codes of the lower-cased letters, other characters being one separator, and counts."""
        letters = "".join([c if c.isalpha() else " " for c in set(text or "")])
        if not letters.strip():
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        gone = {ord(c): " " for c in set(text) if not c.isalpha()}
        plain = f" {' '.join(text.translate(gone).lower().split())} "
        codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        gram = codes[self.n - 1 :].copy()
        for k in range(1, self.n):
            gram |= codes[self.n - 1 - k : len(codes) - k] << np.uint64(21 * k)
        return np.unique(gram, return_counts=True)

    def profile(self, text: str | None) -> np.ndarray | None:
        """The document's bundle at unit length; None without a letter."""
        grams, counts = self.grams(text)
        if not len(grams):
            return None
        total = np.zeros(self.dimensions, dtype=np.float32)
        for k in range(0, len(grams), 4096):
            total += counts[k : k + 4096].astype(np.float32) @ self.gram_vectors(grams[k : k + 4096]).astype(np.float32)
        size = float(np.linalg.norm(total))
        return total / size if size else total


class Model:
    """prototypes: one row of unit length for each language, in the order of names."""

    def __init__(self, names: list[str], prototypes: np.ndarray):
        self.names, self.prototypes = names, prototypes

    def predictor(self):
        encoder = Encoder()

        def run(texts):
            names, scores = [], []
            for text in texts:
                profile = encoder.profile(text) if self.names else None
                if profile is None:
                    names.append("und")
                    scores.append(0.0)
                    continue
                cosines = (self.prototypes @ profile).astype(float)
                weights = np.exp(SHARPNESS * (cosines - cosines.max()))
                best = int(np.argmax(cosines))
                names.append(self.names[best])
                scores.append(float(weights[best] / weights.sum()))
            return [names, scores]

        return run


def train(docs: DataFrame, fold: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """fold = (modulus, remainder): rows of that crc32 remainder take no part in training."""
    small_batches(docs.sparkSession)
    use = ~in_fold(id_col, *fold) if fold else F.lit(True)
    known = docs.where(use & named(label_col).isNotNull() & named(id_col).isNotNull()).select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"), named(label_col).cast("string").alias("lang"))
    # A row for each language. The hash is of the text too, so rows that repeat an id are drawn one by one.
    shares = known.groupBy("lang").agg((F.least(F.lit(1.0), max_rows / F.count("*")) * (1 << 30)).cast("long").alias("cut"))
    chosen = known.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64(F.lit(19), "id", "text"), F.lit(1 << 30)) < F.col("cut"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        encoder, sums = Encoder(), {}
        for piece in slices(batches, 0):
            for text, name in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                profile = encoder.profile(text)
                if profile is not None:
                    sums[name] = sums.get(name, 0) + profile.astype(np.float64)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(total)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["lang", "i", "v"])

    parts = chosen.select("text", "lang").mapInArrow(run, "lang string, i int, v double")
    # A row for each language and dimension.
    total = parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v")).orderBy("lang").collect()
    rows = np.array([r["v"] for r in total], dtype=np.float64).reshape(len(total), DIMENSIONS)
    if len(rows):
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return Model([r["lang"] for r in total], rows.astype(np.float32))


def annotate(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score, in one pass without a shuffle."""
    return map_texts(docs, model.predictor, "lang_pred string, score double", text_col, keep)
