"""Digits of whole lists of words shifted by hashes, in arrays over an Arrow batch: MD5 of all short keys at once. In columns
the same is a lambda for each sign of each variant."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import shifted

# The shifts, constants, places of words, and beginning of MD5.
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
PLACES = [[i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16][i // 16] for i in range(64)]
BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The longest key of a single block, and the keys hashed at once.
SHORT, CHUNK = 55, 8192


def md5_blocks(words: np.ndarray) -> np.ndarray:
    """The digests, as rows of 16 bytes, of padded blocks, as 16 rows of 32-bit words."""
    begin = [np.full(words.shape[1], x, dtype=np.uint32) for x in BEGIN]
    a, b, c, d = (x.copy() for x in begin)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        a += f
        a += words[PLACES[i]]
        a += SINES[i]
        turn = TURNS[i // 16][i % 4]
        np.left_shift(a, np.uint32(turn), out=g), np.right_shift(a, np.uint32(32 - turn), out=f), np.bitwise_or(f, g, out=f)
        f += b
        a, b, c, d, f = d, f, b, c, a
    out = np.stack([x + y for x, y in zip((a, b, c, d), begin, strict=True)], axis=1)
    return np.ascontiguousarray(out).view(np.uint8).reshape(-1, 16)


def signs(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts and where each of them begins, with the end of the last."""
    places = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


def rows_of(data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The texts as rows of `width` bytes, zeros behind them."""
    out = np.zeros((len(places) - 1, width), dtype=np.uint8)
    lengths = np.diff(places)
    out.reshape(-1)[np.repeat(np.arange(len(lengths)) * width - places[:-1], lengths) + np.arange(len(data))] = data
    return out


_SHIFTED = np.array([[(c - 48 + 1 + h % 9) % 10 + 48 if 48 <= c <= 57 else c for h in range(16)] for c in range(256)], dtype=np.uint8).reshape(-1)


def _quick(words: pa.Array, keys: pa.Array, n: int) -> pa.Array:
    """n variants of every word; words in ASCII, keys (with the last separator) and a digit within a block."""
    data, places = signs(words)
    lengths = np.diff(places)
    width = int(lengths.max(initial=1)) or 1
    chars = rows_of(data, places, width).astype(np.uint16) << 4
    key_data, key_places = signs(keys)
    blocks, ends = rows_of(key_data, key_places, 64), np.diff(key_places)
    at, parts, kept = np.arange(width) % 32, [], []
    for low in range(0, len(words), CHUNK):
        block, end = np.repeat(blocks[low : low + CHUNK], n, axis=0), np.repeat(ends[low : low + CHUNK], n)
        every = np.arange(len(block))
        block[every, end] = 48 + every % n
        block[every, end + 1] = 128
        block.view(np.uint64)[:, 7] = (end + 1) * 8
        digest = md5_blocks(np.ascontiguousarray(block.view(np.uint32).T))
        hexes = np.stack([digest >> 4, digest & 15], axis=2).reshape(-1, 32)
        out = _SHIFTED[np.repeat(chars[low : low + CHUNK], n, axis=0) | hexes[:, at]]
        inside = np.arange(width) < np.repeat(lengths[low : low + CHUNK], n)[:, None]
        parts.append(out[inside])
    made = np.concatenate([[0], np.cumsum(np.repeat(lengths, n))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(words) * n, pa.py_buffer(made), pa.py_buffer(np.concatenate(parts)))


def variants(words: pa.Array, docs: pa.Array, n: int) -> pa.Array:
    """n variants of each word in a row: of every word, with its document's key, by the hash of (document|word|variant)."""
    keys = pc.binary_join_element_wise(docs, words, "", "|", null_handling="skip")
    short = (pc.binary_length(keys).to_numpy(zero_copy_only=False) < SHORT) & pc.string_is_ascii(words).to_numpy(zero_copy_only=False) if n <= 10 else np.zeros(len(words), bool)
    if short.all() and len(words):
        return _quick(words, keys, n)
    slow = [shifted(w, hashlib.md5(f"{k}{j}".encode()).hexdigest()) for w, k in zip(words.filter(~short).to_pylist(), keys.filter(~short).to_pylist(), strict=True) for j in range(n)]
    both = pa.concat_arrays([_quick(words.filter(short), keys.filter(short), n) if short.any() else pa.array([], pa.string()), pa.array(slow, pa.string())])
    place = np.empty(len(words), dtype=np.int64)
    place[short], place[~short] = np.arange(short.sum()), short.sum() + np.arange((~short).sum())
    return both.take(pa.array((place[:, None] * n + np.arange(n)).reshape(-1)))


def shifted_lists(words: Column, key: Column, n: int) -> Column:
    """For each word of an array n variants with other digits, see `rules.shifted_digits`; null for null."""

    @F.arrow_udf("array<array<string>>")
    def run(lists: pa.Array, docs: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        made = variants(flat, docs.take(pa.array(np.repeat(np.arange(len(lists)), lengths))), n)
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(flat) + 1) * n, n, dtype=np.int32)), made)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), inner, mask=lists.is_null())

    return run(words, key.cast("string"))
