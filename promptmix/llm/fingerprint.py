"""Document fingerprints from prefix polynomial hashes.

The hash of the span [i, j) of a text of n characters is  (S[j] - S[i]) * B^(n - i)  mod p, where
S[k] = sum of (c_t + 1) * B^t over t < k. One array of prefix sums thus answers any span equality within a text
in constant time, and the longest common extension of two places by binary search; `span_hash` gives a form
that compares across texts. Two bases make the hashes 62 bits wide.

The fingerprint of a text is the hash of the whole text followed by a bottom-k sketch of the hashes of its spans
of SPAN characters, all taken from the prefix arrays; a text below SHORT characters has a second sketch of spans of
SHORT_SPAN characters. The likeness of two fingerprints is 1 for equal texts and otherwise the share of common values
among the k least of both (of the second sketches where both have them), an estimate of the Jaccard similarity of their
sets of spans. What two texts begin and end with in common is exact: it comes from common extensions.

Cases: null is the empty text; a text shorter than a span is its own only span; the empty text has an empty
sketch and is like itself alone; rows that repeat an id are all fingerprinted; ids may be of any type with an order."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_texts, named, quantiles, slices, small_batches

P = np.uint64((1 << 31) - 1)
BASES = (1_000_003, 998_244_353 % ((1 << 31) - 1))
SPAN = 24
#: Texts below so many characters are also sketched by shorter spans.
SHORT, SHORT_SPAN = 96, 6
SKETCH = 64
#: Buckets of neighbouring ids, at most; the driver holds one boundary for each, chosen among so many ids a bucket.
MAX_BUCKETS = 4_000
SAMPLED = 50


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1 for x < 2^62."""
    x = (x & P) + (x >> np.uint64(31))
    return x - P * (x >= P)


class Powers:
    """Powers of the bases and of their inverses, grown by doubling."""

    def __init__(self):
        self.up = [np.ones(1, dtype=np.uint64) for _ in BASES]
        self.down = [np.ones(1, dtype=np.uint64) for _ in BASES]

    def reach(self, n: int) -> None:
        while len(self.up[0]) < n:
            for table, bases in ((self.up, BASES), (self.down, [pow(b, int(P) - 2, int(P)) for b in BASES])):
                for k, base in enumerate(bases):
                    step = np.uint64(pow(base, len(table[k]), int(P)))
                    table[k] = np.concatenate((table[k], _mod(table[k] * step)))


POWERS = Powers()


class Prefix:
    """Prefix arrays of one text, given as code points."""

    def __init__(self, codes: np.ndarray, powers: Powers = POWERS):
        powers.reach(len(codes) + 1)
        self.n, self.powers, self.sums = len(codes), powers, []
        shifted = codes.astype(np.uint64) + np.uint64(1)
        for up in powers.up:
            total = np.zeros(self.n + 1, dtype=np.uint64)
            # Terms are below 2^31, so a sum over 2^32 characters still fits.
            np.cumsum(_mod(shifted * up[: self.n]), out=total[1:])
            self.sums.append(total % P)

    def span_hash(self, start, end) -> np.ndarray:
        """62-bit hashes of the spans [start, end), comparable across texts; start and end are arrays or numbers."""
        start, end = np.asarray(start), np.asarray(end)
        parts = [_mod(_mod(s[end] + P - s[start]) * down[start]) for s, down in zip(self.sums, self.powers.down, strict=True)]
        return (parts[0] << np.uint64(31)) | parts[1]

    def equal(self, a: int, b: int, length: int) -> bool:
        return same_span(self, a, self, b, length)


def same_span(x: Prefix, i: int, y: Prefix, j: int, length: int) -> bool:
    """Whether x from i and y from j agree for so many characters: the differences of the prefix sums, each multiplied by
    the power that the other begins with, are equal for both bases."""
    for a, b, up in zip(x.sums, y.sums, x.powers.up, strict=True):
        mine = (int(a[i + length]) - int(a[i])) * int(up[j])
        if (mine - (int(b[j + length]) - int(b[j])) * int(up[i])) % int(P):
            return False
    return True


def common_extension(x: Prefix, i: int, y: Prefix, j: int) -> int:
    """Length of the longest common extension of x at i and y at j, by binary search over span equality."""
    low, high = 0, min(x.n - i, y.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(x, i, y, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def common_ends(x: Prefix, y: Prefix) -> tuple[int, int]:
    """Characters that two texts begin with in common, and of what follows these, characters that they end with."""
    first = common_extension(x, 0, y, 0)
    low, high = 0, min(x.n, y.n) - first
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(x, x.n - middle, y, y.n - middle, middle):
            low = middle
        else:
            high = middle - 1
    return first, low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(32)


def sketch(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The least `size` distinct values of the mixed hashes."""
    mixed = _mix(hashes)
    k = size
    while len(mixed):  # repeated spans may hide some of the least values
        least = np.unique(np.partition(mixed, k - 1)[:k] if k < len(mixed) else mixed)
        if len(least) >= size or k >= len(mixed):
            return least[:size]
        k *= 4
    return mixed


def span_hashes(prefix: Prefix, span: int = SPAN) -> np.ndarray:
    if not prefix.n:
        return np.zeros(0, dtype=np.uint64)
    starts = np.arange(max(1, prefix.n - span + 1))
    return prefix.span_hash(starts, np.minimum(starts + span, prefix.n))


def fingerprint(text: str | None) -> str:
    return fingerprint_of(Prefix(code_points(text or "")))


def fingerprint_of(prefix: Prefix) -> str:
    spans = (SPAN, SHORT_SPAN) if prefix.n < SHORT else (SPAN,)
    return encode(prefix.n, int(prefix.span_hash(0, prefix.n)), *[sketch(span_hashes(prefix, span)) for span in spans])


def encode(n: int, whole: int, *least: np.ndarray) -> str:
    return ".".join([f"{n:x}", f"{whole:016x}", *[x.astype(">u4").tobytes().hex() for x in least]])


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, from 0 to 1."""
    if a == b:
        return 1.0
    mine, theirs = (f.split(".")[2:] for f in (a, b))
    at = min(len(mine), len(theirs)) - 1
    x, y = (np.frombuffer(bytes.fromhex(f[at]), dtype=">u4") for f in (mine, theirs))
    union = np.union1d(x, y)[:SKETCH]
    return float(np.isin(union, x).astype(int) @ np.isin(union, y).astype(int)) / len(union) if len(union) else 0.0


def edited(text: str, other: str) -> str:
    """text with its last half replaced by as much of other's beginning, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def annotate(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, out_col: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint column, in one pass without a shuffle."""
    return map_texts(docs, lambda: lambda texts: [[fingerprint(t) for t in texts]], f"{out_col} string", text_col, keep)


OUT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, begins_edited bigint, ends_edited bigint, begins_next bigint, ends_next bigint"


def with_next(docs: DataFrame, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's id and the columns of OUT: its fingerprint, that of its text edited with the next document by
    ascending id, how like both it and the next document's are to it, the characters that it begins and then ends with
    as the edited text does, and those that it begins and then ends with as the next text does.

    Rows are in the order of (id, hash of the text), null ids first, and are dealt to buckets of neighbours by boundaries
    from a bounded sample of such keys, so an id that many texts share is spread too. The first document of a bucket is
    also sent to the bucket before, and the first of all to the last, so every document meets its successor in
    one streaming pass over sorted partitions."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.struct(F.col("id").isNotNull().alias("is"), "id", F.xxhash64("text").alias("hash")).alias("at"))
    buckets = buckets or min(MAX_BUCKETS, max(4, 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    least = rows.agg(F.min("at")).first()[0]
    if least is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, {OUT}")
    # The cuts are keys of the table, so each is the first of the bucket that it begins.
    seen = bounded_sample(rows.select("at").where("id is not null"), "at", SAMPLED * buckets, seed=23)
    cuts = [c for c in quantiles(sorted(tuple(r[0]) for r in seen.collect()), buckets) if c > tuple(least)]
    place = f"struct<is:boolean,id:{kind},hash:bigint>"
    key = lambda c: F.struct(F.lit(c[0]).alias("is"), F.lit(c[1]).cast(kind).alias("id"), F.lit(c[2]).cast("long").alias("hash")).cast(place)
    bucketed = rows.withColumn("bucket", _bucket(F.col("at"), [key(c) for c in cuts]))
    # The first document of a bucket also goes to the bucket before, the first of all to the last.
    firsts = F.array(key(tuple(least)), *map(key, cuts))
    begins = F.get(firsts, F.col("bucket")) == F.col("at") if cuts else F.col("at") == key(tuple(least))
    guest = F.struct(F.when(F.col("bucket") == 0, len(cuts)).otherwise(F.col("bucket") - 1).cast("int").alias("bucket"), F.lit(True).alias("guest"))
    own = F.struct("bucket", F.lit(False).alias("guest"))
    dealt = bucketed.select("at", "id", "text", F.explode(F.when(begins, F.array(own, guest)).otherwise(F.array(own))).alias("c")).select("id", "text", "c.bucket", "c.guest", "at")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "guest", "at", "text")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        def row(text, mine, mark, other, theirs, other_mark):
            changed = edited(text, other)
            same = changed == text
            prefix = mine if same else Prefix(code_points(changed))
            changed_mark = mark if same else fingerprint_of(prefix)
            digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            return (len(text), digest, mark, changed_mark, likeness(mark, changed_mark), likeness(mark, other_mark), *common_ends(mine, prefix), *common_ends(mine, theirs))

        fields = [f.split() for f in OUT.split(", ")]
        types = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
        bucket, last, pending = None, None, False
        for piece in slices(batches, 1):
            out, held = [], []  # rows, and the ids that they belong to
            for i, (text, b, guest) in enumerate(zip(*(piece.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                if b != bucket:
                    bucket, pending = b, False
                if guest and not pending:
                    continue  # a further row of the successor's key
                prefix = Prefix(code_points(text))
                now = (text, prefix, fingerprint_of(prefix))
                if pending:
                    held.append(last[0])
                    out.append(row(*last[1:], *now))
                last, pending = (piece.column(0).slice(i, 1), *now), not guest
            if out:
                arrays = [pa.array(c, type=types[t]) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(held), *arrays], names=[id_col, *[n for n, _ in fields]])

    return dealt.select("id", "text", "bucket", "guest").mapInArrow(run, f"`{id_col}` {kind}, {OUT}")


def _bucket(value, cuts: list):
    """Column: the number of the sorted cuts that are at most the value, found by two looks among about sqrt(cuts)."""
    if not cuts:
        return F.lit(0)
    width = max(1, round(len(cuts) ** 0.5))
    parts = [F.array(*cuts[k : k + width]) for k in range(0, len(cuts), width)]
    coarse = F.array_size(F.filter(F.array(*cuts[::width]), lambda c: c <= value))
    part = F.get(F.array(*parts), coarse - 1)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + F.array_size(F.filter(part, lambda c: c <= value))).cast("int")
