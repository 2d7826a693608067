"""Secret scans, on DataFrame functions alone.

Base spans come from three patterns: assignments of a value of 6 or more characters to a telling name, access key
ids, and lower-case hexadecimal runs. The method adds the spans of tokens that look random:

* A token is a maximal run of MIN_LENGTH or more letters, digits and + / _ - (with up to two = behind it) that no
  base span touches. Its encoding is the smallest of hexadecimal, base 32, letters, base 36 and base 64 that fits;
  numbers are no tokens.
* Three tests ask whether the token is random in that encoding: chi-squared uniformity over the alphabet
  (Wilson-Hilferty), runs about the middle of the alphabet, and lag-one serial correlation of places in it. A token
  that fails them (Bonferroni over the three, level BATTERY_LEVEL) is not random.
* The chi-squared and the runs statistic are also asked whether text could give them. The first is, but for constants,
  the index of coincidence, which has a known mean under text. For the second, runs are those of character kinds (capitals,
  small letters, digits, signs; of vowels and consonants where all are letters): text changes kind about once a word, a
  capital before small letters and what follows a sign not counted, and between vowels and consonants more often than
  chance. Both have a spread that shrinks with the length, so short tokens carry little evidence. Their combined p-values
  (Stouffer), weighted by length, go through the Benjamini-Hochberg step-up over the tokens of the document at level
  FALSE_DISCOVERY; tokens that pass both questions are reported as kind `random`.

Offsets are code points, ends exclusive. They come from the lengths of the matches and of the pieces between them,
as Spark has no function for places of matches. Null texts are empty and have no spans; repeated rows are scanned
one by one; everything is row-local, so there is no shuffle and no skew. Columns of the names of the result give way in
`annotate`; `mask` keeps all columns, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import PLACE, places
from .common import named, packed

# The base patterns.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 6
#: What stands in every assignment: a sign and the beginning of a value.
BEFORE_VALUE = r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}"
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more characters: a run that is too short has no longer rest
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 or more characters: runs are maximal either way
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH = 20
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}"
BATTERY_LEVEL = 0.001
FALSE_DISCOVERY = 0.01
#: For each encoding: the form of its tokens, its alphabet, and of text written in it the index of coincidence and the
#: share of places where the kind of character changes (below 0: chance changes less often than text).
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.100, 0.12),
    ("base32", r"^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567", 0.066, 0.12),
    ("letters", r"^(?:[A-Z]?[a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz", 0.066, -0.62),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.060, 0.12),
    ("base64", r"^", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.055, 0.20),
)
LETTERS, BASE64 = 2, 4
#: Variance of the mean squared frequency of text symbols, per symbol (four times the third moment less the square).
TEXT_SPREAD = 0.0056
#: Variance of the number of changes under text, as a multiple of the binomial one.
CHANGE_SPREAD = 1.5
#: Kinds of characters: those of the base 64 alphabet, and vowels (as a) and consonants (as 0).
KIND_OF = "A" * 26 + "a" * 26 + "0" * 10 + "//"
VOWEL_OF = "".join("a" if c in "aeiou" else "0" for c in ENCODINGS[LETTERS][2])
#: Pairs of kinds that count as a change.
CHANGES = ("aA", "a0", "a/", "A0", "A/", "0A", "0a", "0/")
CHANGE = "|".join(f"(?<={c[0]}){c[1]}" for c in CHANGES)


def _when(guard: Column, spans: Column) -> Column:
    return F.when(guard, spans).otherwise(F.array().cast(PLACE))


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), by a rational approximation (absolute error below 1e-7)."""
    x = F.abs(z) / F.lit(2.0) ** 0.5
    t = 1 / (1 + 0.3275911 * x)
    tail = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _tested(tokens: Column) -> Column:
    """array<struct<start, end, n, p_random, p_text>> of tokens (start, end, word)."""
    plain = F.transform(tokens, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.translate(F.regexp_replace(x["word"], "=+$", ""), "-_", "+/").alias("t")))

    def placed(x: Column) -> Column:
        kind = F.coalesce(*[F.when(x["t"].rlike(e[1]), F.lit(i)) for i, e in enumerate(ENCODINGS)])
        alphabet = F.element_at(F.array(*[F.lit(e[2]) for e in ENCODINGS]), kind + 1)
        # Only base 64 tells cases apart.
        letters = F.when(kind == BASE64, x["t"]).otherwise(F.lower(x["t"]))
        kinds = F.when(kind == LETTERS, F.translate(letters, ENCODINGS[LETTERS][2], VOWEL_OF)).otherwise(F.translate(x["t"], ENCODINGS[BASE64][2], KIND_OF))
        changes = F.length(kinds) - F.length(F.regexp_replace(kinds, CHANGE, ""))
        return F.struct(x["start"], x["end"], kind.alias("kind"), changes.cast("double").alias("changes"), F.transform(F.regexp_extract_all(letters, F.lit("."), F.lit(0)), lambda c: F.instr(alphabet, c) - 1).alias("v"))

    def counted(x: Column) -> Column:
        v = x["v"]
        n = F.size(v).cast("double")
        k = F.element_at(F.array(*[F.lit(float(len(e[2]))) for e in ENCODINGS]), x["kind"] + 1)
        mean = F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / n
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, s: a + F.pow(F.size(F.filter(v, lambda y: y == s)).cast("double"), F.lit(2.0)))
        high = F.size(F.filter(v, lambda y: y >= k / 2)).cast("double")
        follow = F.sequence(F.lit(1), F.size(v) - 1)
        runs = F.size(F.filter(follow, lambda i: (F.get(v, i) >= k / 2) != (F.get(v, i - 1) >= k / 2))).cast("double") + 1
        return F.struct(x["start"], x["end"], x["kind"], x["changes"], v.alias("v"), n.alias("n"), k.alias("k"), mean.alias("mean"), squares.alias("squares"), high.alias("high"), runs.alias("runs"), follow.alias("follow"))

    def measured(x: Column) -> Column:
        v, n, k, mean = x["v"], x["n"], x["k"], x["mean"]
        df = k - 1
        chi = x["squares"] * k / n - n
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        both = 2 * x["high"] * (n - x["high"])
        spread = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, (x["runs"] - 1 - both / n) / F.sqrt(spread)).otherwise(9.0)
        about = F.aggregate(v, F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean))
        along = F.aggregate(x["follow"], F.lit(0.0), lambda a, i: a + (F.get(v, i) - mean) * (F.get(v, i - 1) - mean))
        z_serial = F.when(about > 0, along / about * F.sqrt(n)).otherwise(9.0)
        text = F.element_at(F.array(*[F.lit(e[3]) for e in ENCODINGS]), x["kind"] + 1)
        seen = (x["squares"] - n) / (n * (n - 1))
        z_same = (text - seen) / F.sqrt(2 * text * (1 - text) / (n * (n - 1)) + TEXT_SPREAD / n)
        rate = F.element_at(F.array(*[F.lit(e[4]) for e in ENCODINGS]), x["kind"] + 1)
        share = F.abs(rate)
        z_change = F.signum(rate) * (x["changes"] - (n - 1) * share) / F.sqrt((n - 1) * share * (1 - share) * CHANGE_SPREAD)
        z_text = (z_same + z_change) / F.sqrt(F.lit(2.0))
        return F.struct(x["start"], x["end"], n.alias("n"), z_chi.alias("chi"), z_runs.alias("runs"), z_serial.alias("serial"), z_text.alias("text"))

    def judged(x: Column) -> Column:
        least = F.least(_upper_tail(x["chi"]), 2 * _upper_tail(F.abs(x["runs"])), 2 * _upper_tail(F.abs(x["serial"])))
        return F.struct(x["start"], x["end"], x["n"], (3 * least).alias("p_random"), _upper_tail(x["text"]).alias("p_text"))

    for function in (placed, counted, measured, judged):
        plain = F.transform(plain, function)
    return plain


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row: as the element of an array it is a variable, and no lambda inside
    computes it again for each of its elements."""
    return F.get(F.transform(F.array(value), use), 0)


def _discovered(tests: Column) -> Column:
    """The tests that pass: Benjamini-Hochberg over length-weighted p-values, and random by the battery."""
    return _once(tests, lambda t: _once(F.aggregate(t, F.lit(0.0), lambda a, x: a + x["n"]), lambda total: _passed(t, total)))


def _passed(tests: Column, total: Column) -> Column:
    m = F.size(tests)
    weighted = F.array_sort(F.transform(tests, lambda x: x["p_text"] * total / (x["n"] * m)))
    cut = F.coalesce(F.array_max(F.filter(F.transform(weighted, lambda q, i: F.when(q <= FALSE_DISCOVERY * (i + 1) / m, q)), lambda q: q.isNotNull())), F.lit(-1.0))
    return _once(cut, lambda c: F.filter(tests, lambda x: (x["p_text"] * total / (x["n"] * m) <= c) & (x["p_random"] >= BATTERY_LEVEL)))


def annotate(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_spans and spans (array<struct<start, kind, end>>, by start, then
    kind in the order of KINDS; kind is its index there). Columns of these names give way."""
    added = ("n_assign", "n_access", "n_hex", "base_spans", "spans")
    kept = [c for c in docs.columns if c.lower() not in added]
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    value = ASSIGN.replace("+)", "{%d,})" % ASSIGN_LEAST)
    rows = packed(docs, kept, __t=text)
    # Cheap tests first: most texts have no sign before a value, and no run as long as a token (or a hexadecimal run).
    assigned = (F.contains("__t", F.lit("=")) | F.contains("__t", F.lit(":"))) & F.col("__t").rlike(BEFORE_VALUE) & F.col("__t").rlike(value)
    rows = rows.withColumn("__run", F.col("__t").rlike(TOKEN % min(min_length, 24)))
    rows = rows.withColumns(
        {
            "__assign": _when(assigned, F.filter(places(F.col("__t"), ASSIGN), lambda x: F.length(F.regexp_extract(x["word"], "^" + ASSIGN, 2)) >= ASSIGN_LEAST)),
            "__access": _when(F.contains("__t", F.lit("AKIA")), places(F.col("__t"), ACCESS)),
            "__hex": _when(F.col("__run") & F.col("__t").rlike(HEX), places(F.col("__t"), HEX)),
            "__tokens": _when(F.col("__run"), places(F.col("__t"), TOKEN % min_length)),
        }
    )
    as_kind = lambda spans, kind: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    rows = rows.withColumn("base_spans", F.array_sort(F.concat(*[as_kind(F.col(c), k) for k, c in enumerate(("__assign", "__access", "__hex"))])))
    free = F.filter("__tokens", lambda x: ~F.exists("base_spans", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])) & ~x["word"].rlike("^[0-9_/+-]+=*$"))
    rows = rows.withColumn("__free", free)
    found = F.when(F.size("__free") > 0, as_kind(_discovered(_tested(F.col("__free"))), 3)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return rows.select(
        *[F.col("__row").getField(c).alias(c) for c in kept],
        F.size("__assign").cast("long").alias("n_assign"),
        F.size("__access").cast("long").alias("n_access"),
        F.size("__hex").cast("long").alias("n_hex"),
        "base_spans",
        F.array_sort(F.concat("base_spans", found)).alias("spans"),
    )


def as_text(spans: str) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def mask(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of the text replaced by a mark; overlapping spans give one mark. Null stays null."""
    rows = annotate(packed(docs, __own=named(text_col).cast("string")), "__own").select("__row", "__own", "spans")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(held: Column, x: Column) -> Column:
        # A span that begins before the end of the last one only moves that end.
        piece = F.substring("__own", held["at"] + 1, F.greatest(x["start"] - held["at"], F.lit(0)))
        inside = (x["start"] < held["at"]) & (held["at"] > 0)
        return F.struct(F.greatest(held["at"], x["end"]).alias("at"), F.when(inside, held["out"]).otherwise(F.concat(held["out"], piece, F.lit(mark))).alias("out"))

    rest = lambda held: F.concat(held["out"], F.substring("__own", held["at"] + 1, F.length("__own")))
    masked = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(F.col("__own"))
    return rows.select(*[(masked if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns])
