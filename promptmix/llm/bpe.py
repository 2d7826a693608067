"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The words that are frequent in the corpus are compiled, with the token ids that they encode to, into a minimal
acyclic automaton: equal suffixes share states, and each arc carries the number of words that sort before those
behind it, so that walking a word yields its rank and with it its ids. The automaton is a few flat arrays in one
file that a worker maps into memory. Words that are not in it are merged exactly, by the rules in order of rank.

The tokenizer file (JSON of a BPE model with word ends, byte-level letters and no decoder) is read on the driver
from a path given by the caller; its rules travel to the executors with the lexicon.

Cases: null is the empty text and has no token; special tokens in a text are their ids, as the file says;
ids are decoded to their tokens joined by one space, as a tokenizer without decoder does."""

from __future__ import annotations

import heapq
import json
import re
import tempfile
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, least_of_top, map_texts, named, slices, small_batches

MAX_WORDS = 100_000
MIN_COUNT = 4
#: Chunks remembered by a worker with their ids; beyond it those not met again are forgotten.
CACHED_CHUNKS = 200_000
#: Longer words are merged one by one with a heap.
LONG = 64

# The split pattern of the tokenizer file.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same for texts in which letters and decimal digits are all that \w means (see `plain`).
QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

WHITE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


#: What str.split takes for white space and the tokenizer does not.
_CONTROLS = re.compile("[\x1c-\x1f]")
_plain: dict[str, bool] = {}


def plain(text: str) -> bool:
    if text.isascii():
        return not _CONTROLS.search(text)
    for c in set(text):
        known = _plain.get(c)
        if known is None:
            kind = unicodedata.category(c)
            known = _plain[c] = (kind[0] == "L" or kind in ("Nd", "Zs") or not (c.isalnum() or c.isspace()) or c in "\t\n\v\f\r\x85  ") and not (kind[0] == "M" and c.isalnum())
        if not known:
            return False
    return True


def normalised(text: str) -> str:
    """NFC and the lower case of each character by itself (a final sigma is no exception)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def pieces(text: str) -> list[str]:
    text = normalised(text)
    return QUICK.findall(text) if plain(text) else SPLIT.findall(text)


def chunks(text: str) -> list[str]:
    """The normalised text cut at white space: no word reaches over that, and chunks recur, so each is split once."""
    text = normalised(text)
    return WHITE.split(text) if _CONTROLS.search(text) else text.split()


def split_chunk(chunk: str) -> list[str]:
    if chunk.isalpha():
        return [chunk]
    return QUICK.findall(chunk) if plain(chunk) else SPLIT.findall(chunk)


class Rules:
    """The tokens and merge rules of a tokenizer file, as arrays that travel well."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        end = model.get("end_of_word_suffix") or ""
        vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for table in (vocabulary, self.special):
            for token, i in table.items():
                self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocabulary[c + end] for c in letters], dtype=np.int64)
        left, right, new = [], [], []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left.append(vocabulary[a])
            right.append(vocabulary[b])
            new.append(vocabulary[a + b])
        keys = np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        # Of rules for one pair, the last one in the file holds, as when a map is filled.
        last = np.append(np.flatnonzero(np.diff(keys[order])), len(order) - 1) if len(order) else order
        self.keys, self.ranks, self.new = keys[order][last], order[last].astype(np.int64), np.array(new, dtype=np.int64)

    def symbols(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, dtype=np.uint8)
        out = self.inner[raw]
        out[-1] = self.final[raw[-1]]
        return out

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], 1 << 40)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, one word after another, and how many each has: always the rule of least rank,
        leftmost first. Words of like length go together."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[flat]
        symbols[begin[1:] - 1] = self.final[flat[begin[1:] - 1]]
        out = np.full(len(flat), -1, dtype=np.int64)  # the ids of a word where its bytes were, then -1
        for i in np.flatnonzero(sizes > LONG).tolist():
            found = self.merge_long(words[i])
            out[begin[i] : begin[i] + len(found)] = found
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= LONG]
        for start in range(0, len(order), 4096):
            chunk = order[start : start + 4096]
            width = int(sizes[chunk[-1]])
            inside = np.arange(width + 1) < sizes[chunk][:, None]
            place = (begin[chunk][:, None] + np.arange(width + 1))[inside]
            table = np.full((len(chunk), width + 1), -1, dtype=np.int64)
            table[inside] = symbols[place]
            live, column, never = np.arange(len(chunk)), np.arange(width), 1 << 40
            ranks = np.where(table[:, 1:] < 0, never, self.rank(table[:, :-1] & 0xFFFFFFFF, table[:, 1:] & 0xFFFFFFFF))
            part = table
            while len(live):
                best = np.argmin(ranks, axis=1)
                row = np.arange(len(live))
                least = ranks[row, best]
                go = least < never
                table[live[~go]] = part[~go]
                live, part, ranks, best, least = live[go], part[go], ranks[go], best[go], least[go]
                if not len(live):
                    break
                row = row[: len(live)]
                beyond = column > best[:, None]
                part[:, :width] = np.take_along_axis(part, column + beyond, axis=1)
                part[row, best] = self.new[least]
                part[:, width] = -1
                ranks = np.take_along_axis(ranks, np.minimum(column + beyond, width - 1), axis=1)
                # Only the pairs on either side of the merged symbol are new.
                for left in (best - 1, best):
                    held = np.maximum(left, 0)
                    a, b = part[row, held], part[row, held + 1]
                    fresh = np.where(b < 0, never, self.rank(a & 0xFFFFFFFF, b & 0xFFFFFFFF))
                    ranks[row, held] = np.where(left < 0, ranks[row, held], fresh)
            out[place] = table[inside]
        return out[out >= 0], np.add.reduceat(out >= 0, begin[:-1]) if words else sizes

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same for one word, by a heap over a linked list."""
        symbol = self.symbols(word).tolist()
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.rank(np.array(symbol[:-1]), np.array(symbol[1:]))
        heap = [(int(ranks[i]), i, symbol[i], symbol[i + 1]) for i in np.flatnonzero(ranks < 1 << 40).tolist()]
        heapq.heapify(heap)

        def push(i):
            if i >= 0 and after[i] >= 0:
                r = int(self.rank(np.array([symbol[i]]), np.array([symbol[after[i]]]))[0])
                if r < 1 << 40:
                    heapq.heappush(heap, (r, i, symbol[i], symbol[after[i]]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j] = int(self.new[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i])
            push(i)
        return np.array([s for s in symbol if s >= 0], dtype=np.int64)


class Lexicon:
    """A minimal acyclic automaton over the bytes of words, with id outputs, in flat arrays."""

    FIELDS = ("keys", "target", "skip", "final", "offset", "ids")

    @staticmethod
    def build(words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> bytes:
        """The file image of the automaton of the words (sorted, distinct) and their ids, so many for each word."""
        register: dict[tuple, int] = {}
        arcs: list[list] = [[]]  # of states on the path of the last word: [byte, target] pairs
        ends = [False]
        states: list[tuple[bool, tuple]] = []

        def settle(depth: int) -> None:
            while len(arcs) > depth + 1:
                form = (ends.pop(), tuple(map(tuple, arcs.pop())))
                state = register.get(form)
                if state is None:
                    state = register[form] = len(states)
                    states.append(form)
                arcs[-1][-1][1] = state

        last = b""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            settle(same)
            for byte in word[same:]:
                arcs[-1].append([byte, -1])
                arcs.append([])
                ends.append(False)
            ends[-1] = True
            last = word
        settle(0)
        states.append((ends[0], tuple(map(tuple, arcs[0]))))  # the start is the last state
        behind: list[int] = []
        keys, target, skip = [], [], []
        for number, (end, out) in enumerate(states):
            n = int(end)
            for byte, to in out:
                keys.append(number << 8 | byte)
                target.append(to)
                skip.append(n)
                n += behind[to]
            behind.append(n)
        arrays = {
            "keys": np.array(keys, dtype=np.int64),
            "target": np.array(target, dtype=np.int32),
            "skip": np.array(skip, dtype=np.int32),
            "final": np.array([end for end, _ in states], dtype=np.int8),
            "offset": np.concatenate(([0], np.cumsum(counts))).astype(np.int64),
            "ids": ids.astype("<u4"),
        }
        head, body = [], b""
        for name in Lexicon.FIELDS:
            body += b"\0" * (-len(body) % 8)
            head.append((name, arrays[name].dtype.str, len(body), len(arrays[name])))
            body += arrays[name].tobytes()
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 8) % 8)
        return len(text).to_bytes(8, "little") + text + body

    def __init__(self, image: bytes):
        # The worker's own temporary file; it has no name once it is mapped.
        with tempfile.TemporaryFile() as file:
            file.write(image)
            file.flush()
            mapped = np.memmap(file, dtype=np.uint8, mode="r")
        size = int.from_bytes(bytes(mapped[:8]), "little")
        for name, kind, start, n in json.loads(bytes(mapped[8 : 8 + size])):
            at = 8 + size + start
            setattr(self, name, mapped[at : at + n * np.dtype(kind).itemsize].view(kind))
        self.start = len(self.final) - 1

    def find(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word in the lexicon, -1 if it is not there; all words walk together."""
        rank = np.full(len(words), -1, dtype=np.int64)
        if not len(self.keys) or not words:
            return rank
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        state = np.full(len(words), self.start, dtype=np.int64)
        passed = np.zeros(len(words), dtype=np.int64)
        live = order
        step = 0
        while len(live):
            done = lengths[live] == step
            ended = live[done]
            rank[ended] = np.where(self.final[state[ended]] == 1, passed[ended], -1)
            live = live[~done]
            key = state[live] << 8 | flat[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            live, at = live[there], at[there]
            state[live] = self.target[at]
            passed[live] += self.skip[at]
            step += 1
        return rank


class Coder:
    """Encodes and decodes texts by a lexicon and, for other words, the merge rules."""

    def __init__(self, rules: Rules, image: bytes):
        self.rules, self.lexicon = rules, Lexicon(image)
        self.coded: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ids = self.lexicon.ids.tobytes()
        names = [re.escape(s) for s in sorted(rules.special, key=len, reverse=True)]
        self.marks = re.compile("(" + "|".join(names) + ")") if names else None

    def learn(self, found) -> None:
        """Codes of chunks not met so far: of their words, from the lexicon or else merged."""
        if len(self.coded) > CACHED_CHUNKS:
            self.older, self.coded = self.coded, {}
        fresh = []
        for chunk in found:
            if chunk not in self.coded:
                code = self.older.get(chunk)
                if code is None:
                    fresh.append(chunk)
                else:
                    self.coded[chunk] = code
        split = [split_chunk(c) for c in fresh]
        words = list(set().union(*split))
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        rank = self.lexicon.find(raw)
        offset, ids = self.lexicon.offset, self.ids
        code: dict[str, bytes] = {}
        known = np.flatnonzero(rank >= 0)
        for i, start, end in zip(known.tolist(), (4 * offset[rank[known]]).tolist(), (4 * offset[rank[known] + 1]).tolist(), strict=True):
            code[words[i]] = ids[start:end]
        unseen = np.flatnonzero(rank < 0).tolist()
        merged, counts = self.rules.merge([raw[i] for i in unseen])
        blob, start = merged.astype("<u4").tobytes(), 0
        for i, end in zip(unseen, (4 * np.cumsum(counts)).tolist(), strict=True):
            code[words[i]] = blob[start:end]
            start = end
        for chunk, parts in zip(fresh, split, strict=True):
            self.coded[chunk] = code[parts[0]] if len(parts) == 1 else b"".join(map(code.__getitem__, parts))

    def split(self, text: str | None) -> list[str]:
        """The chunks of a text; a special token is one of its own, marked by a leading line end."""
        if not text:
            return []
        if self.marks is None or "<|" not in text and not self.marks.search(text):
            return chunks(text)
        out = []
        for k, part in enumerate(self.marks.split(text)):
            if k % 2:
                out.append("\n" + part)
            elif part:
                out += chunks(part)
        return out

    def encode(self, texts) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        split = [self.split(t) for t in texts]
        every = set().union(*split)
        every.discard("")
        marked = {w for w in every if w[0] == "\n"}
        self.learn(every - marked)
        for w in marked:
            self.coded[w] = np.array([self.rules.special[w[1:]]], dtype="<u4").tobytes()
        self.coded[""] = b""
        return [b"".join(map(self.coded.__getitem__, words)) for words in split]

    def decode(self, ids) -> str:
        return " ".join(map(self.rules.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def frequent_words(docs: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> list[bytes]:
    """The most frequent words of all texts (at most max_words, of at most LONG bytes, ties together), sorted.

    Each task counts what it reads and sends each word about once; the sums are spread over the cluster, and
    only the top comes to the driver."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow.compute  # noqa: F401
        from collections import Counter

        counts: Counter = Counter()

        def out():
            # Words of the chunks counted; a word that is rare in every place can be common in all, so all go on.
            words: Counter = Counter()
            for chunk, n in counts.items():
                for word in split_chunk(chunk):
                    words[word] += n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogatepass") for w in words], type=pa.binary()), pa.array(list(words.values()), type=pa.int64())], names=["word", "n"])

        for piece in slices(batches, 0):
            for text in piece.column(0).to_pylist():
                if text:
                    counts.update(chunks(text))
                if len(counts) > 300_000:
                    yield out()
        if counts:
            yield out()

    counted = docs.select(named(text_col).cast("string")).mapInArrow(run, "word binary, n bigint")
    totals = counted.where(F.length("word") <= LONG).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    totals = checkpointed(totals)
    least = least_of_top(totals, max_words)
    return sorted(bytes(r[0]) for r in totals.where(F.col("n") >= least).select("word").collect()) if least else []


def compile_lexicon(rules: Rules, words: list[bytes]) -> bytes:
    ids, counts = rules.merge(words)
    return Lexicon.build(words, ids, counts)


OUT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, rules: Rules, image: bytes, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with the number of tokens and the digests of the ids and of the decoded text."""
    import hashlib

    def make():
        coder = Coder(rules, image)

        def run(texts):
            coded = coder.encode(texts)
            return [
                [len(ids) // 4 for ids in coded],
                [hashlib.sha256(ids).hexdigest() for ids in coded],
                [hashlib.sha256(coder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest() for ids in coded],
            ]

        return run

    return map_texts(docs, make, OUT, text_col, keep, limit=2_000_000)


def encode_table(docs: DataFrame, rules: Rules, image: bytes, text_col: str = "text", keep: list[str] | None = None, ids_col: str = "ids") -> DataFrame:
    """docs with their token ids as an array."""

    def make():
        coder = Coder(rules, image)
        return lambda texts: [[np.frombuffer(ids, dtype="<u4").astype(np.int64) for ids in coder.encode(texts)]]

    return map_texts(docs, make, f"{ids_col} array<bigint>", text_col, keep, limit=2_000_000)
