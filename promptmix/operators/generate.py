"""Generation for positions: candidate sources, reuse within a document, and finishing of candidate lists."""

from __future__ import annotations

import functools
import itertools
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import by_row, cased_like, cased_word_by_word, list_array, lists_of, looks_like_email, texts_of

LETTERS = re.compile("[A-Za-z]+")
#: White space and signs as Spark's patterns have them.
SPECIAL, SPACES = re.compile(r"[^A-Za-z0-9 \t\n\x0b\f\r]"), re.compile(r"[ \t\n\x0b\f\r]+")


def root_of(word: str) -> str:
    local = word.split("@", 1)[0]
    return "".join(re.findall("[A-Za-z]{3,}", local) or LETTERS.findall(local)).lower()


def rewrite_email(real: str, fake: str, *key) -> str:
    """The address with letters of its local part from the fake's tokens in turn (casing kept) and other digits."""
    if "@" not in real:
        return real
    local, domain = real.split("@", 1)
    tokens = LETTERS.findall(fake.split("@", 1)[0] if looks_like_email(fake) else fake) or ["user"]
    turn = itertools.cycle(tokens)

    def letters(m: re.Match) -> str:
        token = next(turn)
        return token.upper() if m[0].isupper() else token.title() if m[0].istitle() else token.lower()

    return rules.shifted(LETTERS.sub(letters, local), rules.digest("email", real, fake, *key)) + "@" + domain


def fit_casing(text: str, like: str) -> str:
    if like.islower():
        return text.lower()
    return text.upper() if like.isupper() else text.title() if like.istitle() else cased_like(text, like)


def replace_root(real: str, root: str, fake: str) -> str:
    """real with the letters of its root, which signs may interrupt, replaced by the fake in the same casing and with
    the same signs between parts of the same lengths (the last part takes the rest); without the root, all of it."""
    met = re.search("[^A-Za-z]*".join(map(re.escape, root)), real.lower()) if root else None
    if not met:
        return cased_like(fake, real)
    before, segment, behind = real[: met.start()], real[met.start() : met.end()], real[met.end() :]
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]+", segment)
    body = iter(fit_casing("".join(fake.split()), segment))
    # Parts of letters, at the even places, take as many letters as they had.
    filled = [t if k % 2 else "".join(itertools.islice(body, len(t) if k < len(tokens) - 1 else None)) for k, t in enumerate(tokens)]
    return before + "".join(filled) + behind


def adapt(real: str, root: str, fake: str, met_root: str) -> str:
    """A fake of another word fitted to a word whose root overlaps with that word's: an address is rewritten, several
    words take as many of its tokens, and one word takes the first if it begins that other root, else the last."""
    if looks_like_email(real):
        return rewrite_email(real, fake)
    words = len(LETTERS.findall(real))
    tokens = LETTERS.findall(fake.split("@", 1)[0] if looks_like_email(fake) else fake) or list(filter(None, [root_of(fake)]))
    if not tokens:
        return cased_like(fake, real)
    begins = bool(root) and met_root.startswith(root) and not met_root.endswith(root)
    return replace_root(real, root, " ".join(tokens[:words] if words > 1 else tokens[:1] if begins else tokens[-1:]))


def dressed(word: str, kind: str, fake: str) -> str:
    """A generated candidate in the form of the word: an address keeps its domain, others take its casing."""
    return rewrite_email(word, fake) if (kind or "").upper() == "EMAIL" else cased_word_by_word(fake, word)


def soft_chain(spans, pools) -> list[list[str]]:
    """Candidate lists of a document's spans, which have a word and a type, see `soft_lists`."""
    return soft_lists([s["word"] for s in spans], [s["type"] for s in spans], pools)


def soft_lists(words: list[str], types: list[str], pools) -> list[list[str]]:
    """Candidate lists of a document's spans in order. A repeated (word, type) takes the list it had; else a word whose
    root holds, or is held by, an earlier root (both of three letters or more; the first such) takes that list, adapted;
    else its own. Rules come before the soft step's result, as they override it."""
    hard: dict[tuple[str, str], list[str]] = {}
    roots: dict[str, list[str]] = {}
    out = []
    for word, kind, own in zip(words, types, pools, strict=True):
        key = (word, kind)
        if key not in hard:
            root = root_of(word)
            ruled = known_rules(word, kind, max(1, len(own)))
            if ruled:
                hard[key] = ruled
            else:
                met = next((r for r in roots if len(r) >= 3 and len(root) >= 3 and (r in root or root in r)), None)
                hard[key] = [adapt(word, root, f, met) for f in roots[met]] if met else [dressed(word, kind, f) for f in own]
            roots.setdefault(root, hard[key])
        out.append(hard[key])
    return out


@functools.lru_cache(1 << 14)
def _rules(word: str, kind: str, k: int) -> tuple[str, ...]:
    return tuple(rules.candidates(word, kind, k, "soft"))


def known_rules(word: str, kind: str, k: int) -> list[str]:
    """Rule candidates, which depend on nothing but the word; those of repeated words are remembered."""
    return list(_rules(word, kind, k))


def _chained(spans: Column, pools: Column, whole) -> Column:
    """Lists of a row's spans, by a function of their words, types and pools."""

    @F.arrow_udf("array<array<string>>")
    def run(found: pa.Array, lists: pa.Array) -> pa.Array:
        part = lambda name: lists_of(found, lambda flat: texts_of(pc.struct_field(flat, name)))
        rows = zip(part("word"), part("type"), lists_of(lists, lists_of), strict=True)
        return list_array([None if words is None or own is None else whole(words, types, own) for words, types, own in rows], list_array)

    return run(spans, pools)


def soft_mapped(spans: Column, pools: Column) -> Column:
    """See `soft_lists`; spans of a row are structs of word and type."""
    return _chained(spans, pools, soft_lists)


rewritten_email = by_row(rewrite_email, "string")


def position_beam(pools: Column, key: Column, width: int, seed: int = 42) -> Column:
    """Paths over a document's pools (an array of options for each of its words, in order): each path takes every option of
    the next word, and `width` of them are kept, drawn by a hash with the document's key. Row-local."""

    def step(held: Column, options: Column) -> Column:
        longer = F.flatten(F.transform(held["paths"], lambda p: F.transform(F.array_distinct(options), lambda o: F.concat(p, F.array(o)))))
        mark = lambda p: F.md5(F.concat_ws(":", F.lit(str(seed)), held["k"].cast("string"), key.cast("string"), F.array_join(p, "|")))
        drawn = F.array_sort(F.transform(longer, lambda p: F.named_struct(F.lit("h"), mark(p), F.lit("p"), p)))
        return F.named_struct(F.lit("k"), held["k"] + 1, F.lit("paths"), F.transform(F.slice(drawn, 1, width), lambda x: x["p"]))

    start = F.named_struct(F.lit("k"), F.lit(0), F.lit("paths"), F.array(F.array().cast("array<string>")))
    return F.aggregate(F.filter(pools, lambda p: F.size(p) > 0), start, step, lambda held: held["paths"])


def finished(words: Column, real: Column, probs: Column, target: int) -> Column:
    """A list of exactly `target`: candidates without the real word and without repeats (the first wins), by nearness of
    their probability to 1, cut or padded in turn; only the real word if nothing is left. Row-local."""
    first = F.filter(F.array_distinct(words), lambda w: F.lower(w) != F.lower(real))
    near = F.array_sort(F.transform(first, lambda w: F.struct(F.abs(F.get(probs, F.array_position(words, w).cast("int") - 1) - 1).alias("d"), F.array_position(words, w).alias("idx"), w.alias("word"))))
    filled = lambda kept: F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda i: F.get(kept, i % F.size(kept))["word"])
    # The list is computed once and handed on as the start of an aggregate.
    return F.aggregate(F.array(F.lit(0)), near, lambda held, _: held, lambda kept: F.when(F.size(kept) > 0, filled(kept)).otherwise(F.array_repeat(real, target)))


def completed(spans: Column, pools: Column, target: int) -> Column:
    """Lists of exactly `target` candidates for each span (word, type) of a document, from its pools: repeated words share
    a list, rules override, words that share a root adapt one another's; then signs go where the word has none, repeats and
    the word itself go, and what is left is filled up in turn."""

    return _chained(spans, pools, lambda words, types, own: whole_lists(words, types, own, target))


def plain_as(real: str, fakes: list[str]) -> list[str]:
    """`kept_as` for one word."""
    if SPECIAL.search(real):
        return list(dict.fromkeys(fakes))
    bare = lambda f: SPACES.sub(" ", SPECIAL.sub("", f)).strip(" ") or f
    return list(dict.fromkeys([bare(f) if SPECIAL.search(f) else f for f in fakes]))


def whole_lists(words: list[str], types: list[str], pools, target: int) -> list[list[str]]:
    """`completed` for one document."""
    done: dict[tuple[str, str], list[str]] = {}
    out = []
    for word, kind, fakes in zip(words, types, soft_lists(words, types, pools), strict=True):
        key = (word, kind)
        if key not in done:
            low = word.lower()
            left = [w for w in plain_as(word, fakes) if w.lower() != low] or [word]
            done[key] = (left * (target // len(left) + 1))[:target]
        out.append(done[key])
    return out


def merged_paths(of_paths: Column, target: int) -> Column:
    """The candidates of all paths, of each its quota."""
    return F.flatten(F.transform(of_paths, lambda c: F.slice(c, F.lit(1), quota(target, F.size(of_paths)))))


def contains_root(a: Column, b: Column) -> Column:
    return (F.length(a) >= 3) & (F.length(b) >= 3) & (F.contains(a, b) | F.contains(b, a))


def quota(target: int, paths: Column) -> Column:
    """Candidates that each of so many paths gives."""
    return F.greatest(F.lit(1), F.floor(target / F.greatest(paths, F.lit(1)))).cast("int")


def oversampled(target: int, factor: float) -> int:
    return max(target, int(target * factor))


def without_specials(text: Column, specials: tuple[str, ...] = ("<s>", "</s>", "<pad>", "<unk>", "<|endoftext|>")) -> Column:
    """The text without the special tokens of a tokenizer."""
    return F.trim(F.regexp_replace(text, "|".join(map(re.escape, specials)), ""))


for_type = by_row(lambda word, kind, real: dressed(real, kind, word), "string")
