"""Overlaps of a text with its variants, summed up within each row: n-grams as multisets, longest common subsequences and
character 3-grams, in arrays over an Arrow batch. Texts beyond ASCII, and long ones, are compared one by one."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.digits import rows_of, signs

GRAMS = 4
COUNTS = ("n", "c_len", "r_len", *[f"{x}{n}" for n in range(1, GRAMS + 1) for x in "mt"])
MEANS = ("rouge1", "rouge2", "rouge_l", "precision", "recall", "cosine")
SUMS = f"struct<{', '.join([f'{c}:bigint' for c in COUNTS] + [f'{c}:double' for c in MEANS])}>"
#: Words of a text, signs of a word, and signs of a text that are compared in arrays, and cells compared at once.
MOST_WORDS, MOST_SIGNS, MOST_TEXT, CELLS = 63, 64, 1_000, 1 << 20

_HASH = np.random.default_rng(42).integers(0, 1 << 63, (MOST_SIGNS, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_KEPT = {
    "normal": np.array([chr(c).isalnum() or chr(c) in ".,!?" if c < 128 else False for c in range(256)]),
    "plain": np.array([c not in (9, 10, 11, 12, 13, 32) for c in range(256)]),
}
_NEXT, _AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str, kind: str) -> list[str]:
    """Words of a lower-cased text: what stands between white space (plain), or letters, digits and . , ! ? (normal)."""
    if kind == "plain":
        return re.findall(r"[^ \t\n\x0b\f\r]+", text)
    return "".join(c if c in ".,!?" or unicodedata.category(c)[0] in "LN" else " " for c in text).split(" ")


def _f(common, a, b):
    """F1 of the shares of two sizes; 0 over nothing."""
    p, r = common / np.maximum(a, 1), common / np.maximum(b, 1)
    return np.where(common > 0, 2 * p * r / np.where(common > 0, p + r, 1), 0.0)


def one_pair(x: str, y: str, kind: str, more: bool) -> tuple[list[int], list[float]]:
    """The counts and the means of a single pair."""
    from .metrics import rouge_l_f, trigram_similarity

    a, b = ([w for w in words_of(t.lower(), kind) if w] for t in (x, y))
    counts, f = [1, len(a), len(b)], []
    for n in range(1, GRAMS + 1):
        mine, theirs = (Counter(zip(*[w[k:] for k in range(n)], strict=False)) for w in (a, b))
        common = (mine & theirs).total()
        counts += [common, mine.total()]
        f.append((common, mine.total(), theirs.total()))
    one, two = (float(_f(*np.array(v))) for v in f[:2])
    common, left, right = f[0]
    return counts, [one, two, rouge_l_f(x, y) if more else 0.0, common / max(left, 1), common / max(right, 1), trigram_similarity(x, y) if more else 0.0]


def _ones(cells: np.ndarray) -> np.ndarray:
    """The number of true cells in each row; the cells of a row are a multiple of 8."""
    return np.bitwise_count(cells.reshape(len(cells), -1).view(np.uint64)).sum(axis=1, dtype=np.int64)


def _counted(words: np.ndarray) -> np.ndarray:
    """Hashes that tell the first occurrence of a word in its row from the second, and so on."""
    width = words.shape[1]
    before = (words[:, :, None] == words[:, None, :]) & np.tri(width, k=-1, dtype=bool)
    times = np.bitwise_count(before.reshape(len(words), width, width // 8, 8).view(np.uint64)[..., 0]).sum(axis=2, dtype=np.uint64)
    return words + times * _AGAIN


def _grams(words: np.ndarray, lengths: np.ndarray, n: int, pad: int) -> np.ndarray:
    """Hashes of the n-grams in each row, `pad` behind them."""
    out = words.copy()
    for k in range(1, n):
        out[:, :-k] = (out[:, :-k] ^ (out[:, :-k] >> np.uint64(29))) * _NEXT + words[:, k:]
    out[np.arange(words.shape[1]) >= (lengths - n + 1)[:, None]] = pad
    return out


class Texts:
    """Short ASCII texts: rows of hashes of their words."""

    def __init__(self, texts: pa.Array, kind: str, more: bool):
        data, places = signs(texts)
        low, sizes = _LOWER[data], np.diff(places)
        inside = _KEPT[kind][data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = places[:-1][sizes > 0]
        first[begins] = inside[begins]
        at = np.flatnonzero(first)
        within = np.flatnonzero(inside)
        starts = np.searchsorted(within, at)
        spans = np.diff(np.append(starts, len(within)))
        self.fit = np.ones(len(texts), dtype=bool)
        text = np.searchsorted(places, at, side="right") - 1
        self.lengths = np.bincount(text, minlength=len(texts)).astype(np.int64)
        self.fit[text[spans > MOST_SIGNS]] = False
        self.fit[self.lengths > MOST_WORDS] = False
        self.width = max(8, -(-int(self.lengths[self.fit].max(initial=0)) // 8) * 8)
        nth = np.minimum(np.arange(len(within)) - np.repeat(starts, spans), MOST_SIGNS - 1)
        column = np.arange(len(at)) - (np.cumsum(self.lengths) - self.lengths)[text]
        kept = column < self.width

        def rows(signs_: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), self.width), dtype=np.uint64)
            if len(at):
                out[text[kept], column[kept]] = np.add.reduceat(_HASH[nth, signs_[within]], starts)[kept]
            return out

        self.words = rows(low)
        if more:
            self.raw = rows(data)
            width = -(-(int(sizes.max(initial=0)) + 2) // 8) * 8
            padded = np.full((len(texts), width + 2), 32, dtype=np.uint32)
            body = rows_of(low, places, width - 2)
            padded[:, 2:-2][np.arange(width - 2) < sizes[:, None]] = body[np.arange(width - 2) < sizes[:, None]]
            self.trigrams = padded[:, :-2] << 16 | padded[:, 1:-1] << 8 | padded[:, 2:]
            self.behind = np.arange(width) >= (sizes + 2)[:, None]
            self.sizes = sizes


def _padded(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows


def _common(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences, a bit for each word of b."""
    cells = np.packbits(a[:, :, None] == b[:, None, :], axis=2, bitorder="little")
    bits = np.zeros((*a.shape, 8), dtype=np.uint8)
    bits[:, :, : cells.shape[2]] = cells
    bits = bits.view(np.uint64)[..., 0]
    every = (np.uint64(1) << lb.astype(np.uint64)) - np.uint64(1)
    bits &= every[:, None]
    bits[np.arange(a.shape[1]) >= la[:, None]] = 0
    left = every.copy()
    for i in range(a.shape[1]):
        met = left & bits[:, i]
        left = ((left + met) | (left - met)) & every
    return lb - np.bitwise_count(left).astype(np.int64)


def pairs(texts: pa.Array, originals: pa.Array, of: np.ndarray, kind: str, more: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and means of every text against its original, the one at place `of`; n-grams of up to `most` words."""
    quick = lambda t: pc.and_(pc.and_(pc.string_is_ascii(t), pc.less_equal(pc.binary_length(t), MOST_TEXT)), pc.invert(pc.match_substring_regex(t, "[\\x1c-\\x1f]"))).to_numpy(zero_copy_only=False)
    counts, means = np.zeros((len(texts), len(COUNTS)), dtype=np.int64), np.zeros((len(texts), len(MEANS)))
    short, shorts = quick(texts), quick(originals)
    blank = lambda t, ok: t if ok.all() else pc.if_else(pa.array(ok), t, "")
    x, y = Texts(blank(texts, short), kind, more), Texts(blank(originals, shorts), kind, more)
    fit = short & x.fit & (shorts & y.fit)[of]
    width = max(x.width, y.width)
    step = max(1, CELLS // max(width, (max(x.trigrams.shape[1], y.trigrams.shape[1]) if more else 0) // 2) ** 2)
    theirs = [_padded(_counted(_grams(y.words, y.lengths, n, 1)), width) for n in range(1, most + 1)]
    if more:
        norm = lambda t: (lambda s: np.concatenate([_ones(t.trigrams[i : i + s, :, None] == t.trigrams[i : i + s, None, :]) for i in range(0, len(t.sizes), s)]) if len(t.sizes) else np.zeros(0, np.int64))(max(1, CELLS // t.trigrams.shape[1] ** 2))
        # What stands behind a text is equal among itself only.
        x.trigrams[x.behind], y.trigrams[y.behind] = 0, 1
        nx, ny = (norm(t) - t.behind.sum(axis=1) ** 2 for t in (x, y))
    for low in range(0, len(texts), step):
        at = np.arange(low, min(low + step, len(texts)))
        at = at[fit[at]]
        if not len(at):
            continue
        to, la, lb = of[at], x.lengths[at], y.lengths[of[at]]
        counts[at, :3] = np.stack([np.ones_like(la), la, lb], axis=1)
        for n in range(1, most + 1):
            mine = _padded(_counted(_grams(x.words[at], la, n, 0)), width)
            mine[np.arange(width) >= (la - n + 1)[:, None]] = 0
            met = theirs[n - 1][to]
            met[np.arange(width) >= (lb - n + 1)[:, None]] = 1
            common = _ones(mine[:, :, None] == met[:, None, :])
            total, other = np.maximum(la - n + 1, 0), np.maximum(lb - n + 1, 0)
            counts[at, 1 + 2 * n], counts[at, 2 + 2 * n] = common, total
            if n <= 2:
                means[at, n - 1] = _f(common, total, other)
            if n == 1:
                means[at, 3], means[at, 4] = common / np.maximum(total, 1), common / np.maximum(other, 1)
        if more:
            common = _common(_padded(x.raw[at], width), _padded(y.raw[to], width), la, lb)
            means[at, 2] = 2 * common / np.maximum(la + lb, 1)
            dot = _ones(x.trigrams[at][:, :, None] == y.trigrams[to][:, None, :])
            means[at, 5] = dot / np.sqrt(nx[at].astype(float) * ny[to])
    for i in np.flatnonzero(~fit):
        counts[i], means[i] = one_pair(texts[i].as_py(), originals[int(of[i])].as_py(), kind, more)
    return counts, means


def sums(original: Column, variants: Column, kind: str = "normal", more: bool = False, most: int = GRAMS) -> Column:
    """For each row, over the pairs of its original with each of its variants: their number, sums of the counts of BLEU and
    sums of the scores (ROUGE-L and the cosine of 3-grams only with more, over plain words, and n-grams of up to `most`
    words)."""
    if more and kind != "plain":
        raise ValueError("ROUGE-L is over plain words")

    @F.arrow_udf(SUMS)
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        known = pc.and_(texts.is_valid(), lists.is_valid())
        lists = pc.if_else(known, lists, pa.scalar(None, lists.type))
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat, of = lists.flatten(), np.repeat(np.arange(len(lists)), lengths)
        if flat.null_count:  # a pair without a text counts nowhere
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            flat, of = flat.drop_null(), of[there]
        counts, means = pairs(flat, pc.fill_null(texts, ""), of, kind, more, most)
        total = lambda values: np.bincount(of, weights=values, minlength=len(lists))
        made = [pa.array(total(counts[:, k]).astype(np.int64)) for k in range(len(COUNTS))] + [pa.array(total(means[:, k])) for k in range(len(MEANS))]
        return pa.StructArray.from_arrays(made, names=[*COUNTS, *MEANS], mask=pc.invert(known))

    return run(original, variants)
