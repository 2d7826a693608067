"""Benchmark decontamination with training suffix arrays.

Documents are cut into shards (the pieces an executor holds at a time). For each shard a suffix array over
words is built by prefix doubling, and every window of every benchmark item, that is the beginning of every suffix of
it, is located in it by binary search. Where a place of the shard continues is then found among the suffixes of the
items that share the window, by binary search over their order; how far two suffixes agree is found by binary search
over the equality of spans, which prefix hashes answer. The result is the longest verbatim matches with their places,
the words covered, and the items met; a match is at least a window long.

Words outside the benchmark vocabulary cannot take part in a match, so the array only holds suffixes that
begin with at least as many known words as the shortest window; nothing is lost by that.

A benchmark of any size is searched in the same way: in blocks, one after the other, each of which adds to what a row
has gathered so far. Every block is one more pass through Python within the same stage; nothing is shuffled or joined, so
ids play no part and may be null, repeated, or of any type.

Cases: null or wordless texts have no words and are clean; an item without words has no window; an item with
fewer words than the window is one window; an item without an id is searched and counts as one item (its name is
null); equal items and equal documents are each reported in full; of equally long matches the one that begins first
is reported, of the first item in the order of the benchmark."""

from __future__ import annotations

import hashlib
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpointed, named, packed, slices, small_batches, unpacked, words_of

WINDOW = 10
#: Benchmark words in a block, which travels to the executors as one broadcast.
BLOCK_WORDS = 2_000_000
#: Blocks searched in one stage, each by a Python worker of its own; then the rows are written.
BLOCKS_A_STAGE = 4
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Spans:
    """Prefix hashes of an array of word ids, modulo 2 ** 64 (products and sums wrap)."""

    def __init__(self, ids: np.ndarray):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.powers = powers(len(ids) + 1)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(32))) * self.powers[: len(ids)], dtype=np.uint64)))


def powers(n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        step = np.uint64(pow(int(_BASE), len(out), 1 << 64))
        out = np.concatenate((out, out * step))
    return out


def agreement(x: Spans, i: np.ndarray, y: Spans, j: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each pair of places the number of words from there on that agree, known to be from least to most."""
    low, high = least.copy(), most.copy()
    table = x.powers if len(x.powers) >= len(y.powers) else y.powers
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        a, b, middle = i[open_], j[open_], (low[open_] + high[open_] + 1) // 2
        same = (x.sums[a + middle] - x.sums[a]) * table[b] == (y.sums[b + middle] - y.sums[b]) * table[a]
        low[open_[same]] = middle[same]
        high[open_[~same]] = middle[~same] - 1


class Needles:
    """Benchmark items prepared for search: vocabulary, the order of their suffixes, and the distinct windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        items = [(name, words) for name, words in items if words]
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        learn = self.vocabulary.setdefault
        pieces = [np.array([*[learn(w, len(self.vocabulary) + 1) for w in words], 0], dtype=np.int64) for _, words in items]
        self.flat = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int64)
        lengths = np.array([len(p) - 1 for p in pieces], dtype=np.int64)
        self.shortest, self.longest = min(window, int(lengths.min(initial=window))), int(lengths.max(initial=0))
        begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if pieces else lengths
        self.item = np.repeat(np.arange(len(pieces)), lengths + 1)
        self.left = np.repeat(begin + lengths, lengths + 1) - np.arange(len(self.flat))  # words to the end of the item
        self.spans = Spans(self.flat)
        # Suffixes that begin with a window, in order; those that share a window are one group.
        size = np.minimum(np.repeat(lengths, lengths + 1), window)
        order = suffix_array(self.flat, max(self.longest, window)) if len(self.flat) else self.flat
        self.order = order[(self.left[order] >= size[order]) & (size[order] > 0)]
        size = size[self.order]
        wide = np.concatenate((self.flat, np.zeros(window, dtype=np.int64))).astype(">u4")
        rows = np.lib.stride_tricks.sliding_window_view(wide, window)[self.order] * (np.arange(window) < size[:, None]) if len(self.order) else np.zeros((0, window))
        self.keys = np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * window}").ravel()
        first = np.flatnonzero(np.concatenate(([True], (self.keys[1:] != self.keys[:-1]) | (size[1:] != size[:-1])))) if len(size) else size
        self.keys, self.sizes = self.keys[first], size[first]
        self.group = np.append(first, len(self.order))
        # The items of a group; many windows have the same.
        sets: dict[bytes, int] = {}
        self.set_of = np.empty(len(first), dtype=np.int64)
        self.sets: list[np.ndarray] = []
        for k in range(len(first)):
            owners = np.unique(self.item[self.order[self.group[k] : self.group[k + 1]]])
            number = sets.setdefault(owners.tobytes(), len(sets))
            if number == len(self.sets):
                self.sets.append(owners)
            self.set_of[k] = number


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ids in the order of their first `depth` words, by prefix doubling."""
    n = len(ids)
    rank = ids.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    size = 1
    while size < depth:
        follow = np.zeros(n, dtype=np.int64)
        follow[: n - size] = rank[size:] + 1 if size < n else 0
        key = rank * (int(rank.max(initial=0)) + int(follow.max(initial=0)) + 2) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        size *= 2
        if n and fresh[-1] == n - 1:
            break
    return order


def search_shard(needles: Needles, texts: list) -> list[tuple]:
    """(n_words, spans, items, longest match, its item, its start) of each text: the maximal runs of words inside a
    window as (start, end), end exclusive, and the indexes of the items met."""
    get = needles.vocabulary.get
    lengths, pieces = [], []
    for text in texts:
        words = words_of(text)
        lengths.append(len(words))
        pieces.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words)))
        pieces.append(np.zeros(1, dtype=np.int64))  # ends a document
    out = [(n, [], [], 0, -1, -1) for n in lengths]
    every = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(np.array(lengths, dtype=np.int64) + 1)))
    n, width = len(every), needles.window
    if not n or not len(needles.order):
        return out
    # Known words that follow each place without a break.
    stops = np.flatnonzero(every == 0)
    run = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
    # Keep the runs that are long enough, each with its end mark.
    run_start = np.flatnonzero((run > 0) & (np.concatenate(([True], every[:-1] == 0))))
    long_runs = run_start[run[run_start] >= needles.shortest]
    if not len(long_runs):
        return out
    sizes = run[long_runs] + 1
    shift = np.repeat(long_runs - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    place = np.arange(int(sizes.sum())) + shift  # in the shard, of each kept word
    kept = every[place]
    order = suffix_array(kept, max(needles.longest, width))
    order = order[run[place[order]] >= needles.shortest]
    padded = np.concatenate((kept, np.zeros(width, dtype=np.int64))).astype(">u4")
    keys = np.lib.stride_tricks.sliding_window_view(padded, width)[order]
    keys = np.ascontiguousarray(keys).view(f"S{4 * width}").ravel()
    # The range of suffixes that begin with each window.
    low, high = np.zeros(len(needles.keys), dtype=np.int64), np.zeros(len(needles.keys), dtype=np.int64)
    for size in np.unique(needles.sizes):
        of_size = np.flatnonzero(needles.sizes == size)
        begins = np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), 4 * width)[:, : 4 * size]
        begins = np.ascontiguousarray(begins).view(f"S{4 * size}").ravel()
        wanted = np.ascontiguousarray(needles.keys[of_size]).view(np.uint8).reshape(len(of_size), 4 * width)[:, : 4 * size]
        wanted = np.ascontiguousarray(wanted).view(f"S{4 * size}").ravel()
        # Big-endian ids: their order as bytes is that of the words.
        low[of_size], high[of_size] = np.searchsorted(begins, wanted, side="left"), np.searchsorted(begins, wanted, side="right")
    met = np.flatnonzero(high > low)
    if not len(met):
        return out
    times = high[met] - low[met]
    window = np.repeat(met, times)
    rank = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[met], times)
    at = order[rank]  # of each occurrence, among the kept words
    found = place[at]
    diff = np.zeros(n + 1, dtype=np.int64)
    np.add.at(diff, found, 1)
    np.add.at(diff, found + needles.sizes[window], -1)
    hit = np.concatenate((np.cumsum(diff[:-1]) > 0, [False]))
    doc = np.searchsorted(starts, found, side="right") - 1
    items: dict[int, list[np.ndarray]] = {}
    for pair in np.unique(doc * len(needles.sets) + needles.set_of[window]).tolist():
        items.setdefault(pair // len(needles.sets), []).append(needles.sets[pair % len(needles.sets)])
    # Where each occurrence stands among the suffixes of its window.
    text, followed = Spans(kept), run[place]
    # Runs that are not kept stand between kept ones, so what follows a run is its end mark.
    agree = lambda rows, suffix: agreement(text, at[rows], needles.spans, suffix, needles.sizes[window[rows]], np.minimum(followed[at[rows]], needles.left[suffix]))
    first, last = needles.group[window], needles.group[window + 1]
    left, right = first.copy(), last.copy()
    while True:
        rows = np.flatnonzero(left < right)
        if not len(rows):
            break
        middle = (left[rows] + right[rows]) // 2
        suffix = needles.order[middle]
        common = agree(rows, suffix)
        smaller = needles.flat[suffix + common] < kept[at[rows] + common]
        left[rows[smaller]] = middle[smaller] + 1
        right[rows[~smaller]] = middle[~smaller]
    longest = needles.sizes[window].copy()
    for side in (left - 1, left):
        rows = np.flatnonzero((side >= first) & (side < last))
        longest[rows] = np.maximum(longest[rows], agree(rows, needles.order[side[rows]]))
    # The best occurrence of each document, then all its suffixes that agree as far: a range about the place.
    best = np.lexsort((found, -longest, doc))
    heads = np.flatnonzero(np.concatenate(([True], doc[best[1:]] != doc[best[:-1]])))
    for head in heads.tolist():
        row = int(best[head])
        d, length = int(doc[row]), int(longest[row])
        # An occurrence of several windows (items below the window) may stand at one place.
        same, owner = head, len(needles.names)
        while same < len(best) and found[best[same]] == found[row] and longest[best[same]] == length:
            r = int(best[same])
            owner = min(owner, _first_item(needles, agree, r, int(left[r]), int(first[r]), int(last[r]), length))
            same += 1
        flags = np.concatenate(([0], hit[starts[d] : starts[d] + lengths[d]].astype(np.int8), [0]))
        edge = np.diff(flags)
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out[d] = (lengths[d], spans, np.unique(np.concatenate(items[d])).tolist(), length, owner, int(found[row] - starts[d]))
    return out


def _first_item(needles: Needles, agree, row: int, place: int, first: int, last: int, length: int) -> int:
    """The least item among the suffixes of a group that agree with an occurrence for so many words."""
    holds = lambda k: int(agree(np.array([row]), needles.order[k : k + 1])[0]) >= length
    low, high = first, place  # the least k from which on all up to the place agree
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle + 1, high)
    begin, low, high = low, place, last
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if holds(middle) else (low, middle)
    return int(needles.item[needles.order[begin:low]].min())


def union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the words that either list of runs covers."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(a + b):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


STATE = "n_words bigint, hit_spans array<struct<start:bigint,end:bigint>>, items array<string>, longest_match bigint, longest_item string, longest_start bigint"
_BUILT: dict[tuple[str, int], Needles] = {}


def _needles(block, window: int) -> Needles:
    """The needles of a broadcast block, remembered by the worker for its next task."""
    key, items = block.value
    if (key, window) not in _BUILT:
        _BUILT.clear()
        _BUILT[key, window] = Needles(items, window)
    return _BUILT[key, window]


def _search(rows: DataFrame, block, window: int, last: bool) -> DataFrame:
    """rows (__row, text and, but for the first block, state) with what the block adds to the state; the last block lets go
    of the text."""
    held = T.StructField("state", T.StructType.fromDDL(STATE))
    kind = to_arrow_schema(T.StructType([held])).field(0).type
    follows = "state" in rows.columns

    def merged(names, one, state):
        n, spans, items, longest, item, start = one
        new = (longest, names[item] if item >= 0 else None, start if start >= 0 else None)
        found = {names[i] for i in items}
        if state:
            found.update(state["items"])
            spans = union(spans, [(x["start"], x["end"]) for x in state["hit_spans"]])
            old = (state["longest_match"], state["longest_item"], state["longest_start"])
            if old[0] and (not new[0] or (-old[0], old[2]) <= (-new[0], new[2])):
                new = old
        return {"n_words": n, "hit_spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(found, key=lambda x: (x is None, x or "")), "longest_match": new[0], "longest_item": new[1], "longest_start": new[2]}

    def run(batches):
        import pyarrow.compute  # noqa: F401

        needles = _needles(block, window)
        for piece in slices(batches, 1):
            states = piece.column(2).to_pylist() if follows else repeat(None)
            made = [merged(needles.names, one, state) for one, state in zip(search_shard(needles, piece.column(1).to_pylist()), states, strict=False)]
            passed = [piece.column(0)] if last else [piece.column(0), piece.column(1)]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(made, type=kind)], names=["__row", *([] if last else ["text"]), "state"])

    fields = [rows.schema["__row"], *([] if last else [rows.schema["text"]]), held]
    return rows.mapInArrow(run, T.StructType(fields))


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """Benchmark items in blocks of at most block_words words (or one item), streamed to the driver."""
    block, size = [], 0
    for row in benchmark.select(named(id_col).cast("string"), named(text_col).cast("string")).toLocalIterator():
        words = words_of(row[1])
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


def _searched(rows: DataFrame, benchmark: DataFrame, item_id_col: str, item_text_col: str, window: int, block_words: int) -> DataFrame:
    """__row and state, after all blocks, from rows of __row and text."""
    small_batches(rows.sparkSession)
    context = rows.sparkSession.sparkContext
    # Broadcasts are files; the driver holds the words of one block at a time.
    blocks = [context.broadcast((uuid.uuid4().hex, b)) for b in blocks_of(benchmark, item_id_col, item_text_col, block_words)] or [context.broadcast(("", []))]
    for k, block in enumerate(blocks):
        if k and k % BLOCKS_A_STAGE == 0:
            rows = checkpointed(rows)
        rows = _search(rows, block, window, k == len(blocks) - 1)
    return rows


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs (or the kept columns) with n_words, n_hit (words inside any occurring window), items (met), the longest
    verbatim match (longest_match words of longest_item, from the word longest_start on), and hit_spans, the maximal runs of
    hit words. Columns of these names give way."""
    added = ["n_words", "n_hit", "items", "longest_match", "longest_item", "longest_start", "hit_spans"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    rows = _searched(packed(docs, kept, text=named(text_col).cast("string")), benchmark, item_id_col, item_text_col, window, block_words)
    hits = F.aggregate("state.hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return rows.select(*[F.col("__row").getField(c).alias(c) for c in kept], *[(hits if c == "n_hit" else F.col(f"state.{c}")).alias(c) for c in added])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without those that hold any benchmark window; the columns of docs, whatever their names."""
    rows = _searched(packed(docs, text=named(text_col).cast("string")), benchmark, item_id_col, item_text_col, window, block_words)
    return unpacked(rows.where(F.size("state.hit_spans") == 0), docs.columns)


def brute_force(texts: list, items: list[tuple[str, str]], window: int = WINDOW) -> list[tuple]:
    """(n_words, n_hit, items, digest) by comparing word lists directly; for tests."""
    out = []
    for text in texts:
        words = words_of(text)
        hit, names = set(), set()
        for name, item in items:
            w = words_of(item)
            size = min(window, len(w))
            for j in range(len(w) - size + 1) if w else ():
                for p in range(len(words) - size + 1):
                    if words[p : p + size] == w[j : j + size]:
                        hit.update(range(p, p + size))
                        names.add(str(name))
        out.append((len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return out
