"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of five words; two documents are linked if the Jaccard similarity of their sets
is 0.8 or more. Documents with one set (copies) are one record with a weight, however many there are. A record has
a minhash signature. Records are split recursively: at each node of a path a few signature places are sampled, by
a hash of the path alone, and a record goes on to one child for each, named by the place and its own value there.
The expected number of children is 1 / 0.8, so two records at the threshold share one child on average, and
dissimilar ones soon part; below the first levels, which only large buckets reach, it is BELOW. Buckets small enough are compared by brute force; larger ones are split on, and what is
still large at the last depth is compared in pairs of blocks, so no task holds more than two blocks, whose records and
bytes are bounded (BUCKET, BLOCK_RUNS). Buckets of mostly the same records are joined first. Independent
runs are repeated until the target recall for pairs at the threshold, averaged over how many of the signature places
that all runs draw from agree.

In a bucket, signatures first pick the records that have a likely partner (the miss probability is about 4e-5);
only for these the full sets are fetched, and intersections are counted exactly. A pair is counted in the first
bucket that both records share. Pairs never leave a task: a bucket returns for each record its number of links
and a local root. Components are found by alternating large and small stars, with a checkpoint each round.

Cases: a text of fewer than five words, but not none, is one run; a text without words (also the empty one) is
linked to equal texts only; a null text is linked to none. Rows that repeat an id are documents of their own; ids may be
of any type with an order, and null."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, named, packed, released, slices, small_batches, unpacked, words_of

WORDS = 5
#: Similarity at which documents are linked, as a fraction.
THRESHOLD = (4, 5)
PLACES = 64
FIRST_DEPTH, DEPTH_STEP, LAST_DEPTH = 2, 2, 6
#: Mean number of children below the first levels.
BELOW = 1.5
TARGET_RECALL = 0.998
BUCKET = 1_000
#: Runs of words of all records of a block, in expectation: a bucket of long texts has more blocks.
BLOCK_RUNS = 4_000_000
#: Share of a bucket's records from which it may join the bucket that is the largest for them.
ALIKE = 1 / 3
#: Signature agreement from which a pair is looked at; 0.8 is 4.4 standard deviations above it.
# (0.58 of 64 places are 37.1, so 38 must agree; at a similarity of 0.8 fewer do with a probability of 4.3e-5.)
LIKELY = 0.58

_rng = np.random.default_rng(77)
_A = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64)
_C = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, cache: dict, size: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of `size` words; of all words if there are fewer."""
    words = words_of(text)
    if len(cache) > 400_000:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh64_intdigest(w)
    ids = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(ids):
        return ids
    n = min(size, len(ids))
    total = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(0x100000001B3) + ids[k : len(ids) - n + 1 + k]
    return np.unique(_mix(total + np.uint64(n)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minhash values, one row of PLACES for each non-empty set."""
    out = np.zeros((len(sets), PLACES), dtype=np.uint32)
    if sets:
        flat = np.concatenate(sets)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        for i in range(PLACES):
            out[:, i] = np.minimum.reduceat((flat * _A[i] + _B[i]) >> np.uint64(32), starts)
    return out


def children(paths: np.ndarray, signature: np.ndarray, mean: float = THRESHOLD[1] / THRESHOLD[0]) -> tuple[np.ndarray, np.ndarray]:
    """For paths and the signatures of the records there: which row each child comes from, and its path.

    Every record at a node samples the same places: one, and another so often that the mean is met."""
    chance = _mix(paths[:, None] ^ _C)
    rows = np.arange(len(paths))
    first = np.argmin(chance, axis=1)
    chance[rows, first] = np.uint64((1 << 64) - 1)
    second = np.argmin(chance, axis=1)
    more = (_mix(paths + _MIX) >> np.uint64(11)).astype(float) / (1 << 53) < mean - 1
    row = np.concatenate((rows, rows[more]))
    place = np.concatenate((first, second[more]))
    child = _mix(_mix(paths[row] + _C[place]) ^ signature[row, place].astype(np.uint64))
    return row, child


def mean_children(level: int) -> float:
    return THRESHOLD[1] / THRESHOLD[0] if level < FIRST_DEPTH else BELOW


def descend(paths: np.ndarray, signature: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows and paths at level `last` from paths at level `first`."""
    row = np.arange(len(paths))
    for level in range(first, last):
        step, paths = children(paths, signature[row], mean_children(level))
        row = row[step]
    return row, paths


def lost(depth: int, similarity: float = THRESHOLD[0] / THRESHOLD[1]) -> float:
    """Probability that two records, so much of whose signatures agrees, share no path of the depth in one run."""
    q = 0.0
    for level in reversed(range(depth)):
        x, more = 1 - similarity + similarity * q, mean_children(level) - 1
        q = (1 - more) * x + more * x * x
    return q


def recall(runs: int, depth: int = LAST_DEPTH, similarity: float = THRESHOLD[0] / THRESHOLD[1]) -> float:
    """Probability that a pair of the similarity is found: some number of signature places agrees, at least LIKELY of
    them, and a path of some run is shared."""
    agree = range(math.ceil(LIKELY * PLACES), PLACES + 1)
    return sum(math.comb(PLACES, k) * similarity**k * (1 - similarity) ** (PLACES - k) * (1 - lost(depth, k / PLACES) ** runs) for k in agree)


def runs_needed(target: float = TARGET_RECALL, depth: int = LAST_DEPTH) -> int:
    if not target < recall(10_000, depth):
        raise ValueError(f"a recall of {target} needs longer signatures")
    return next(n for n in range(1, 10_000) if recall(n, depth) >= target)


def roots(runs: int) -> np.ndarray:
    return _mix(np.arange(1, runs + 1, dtype=np.uint64) * _MIX)


def _records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, key of the set, its size and signature, for each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(named(id_col).alias("id"), F.xxhash64(named(text_col).cast("string")).alias("text_hash"), named(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow.compute  # noqa: F401

        from pyspark import TaskContext

        cache: dict = {}
        part, row = TaskContext.get().partitionId(), 0
        for piece in slices(batches, 2):
            texts = piece.column(2).to_pylist()
            sets = [shingles(t, cache) for t in texts]
            keys = []
            for text, found in zip(texts, sets, strict=True):
                row += 1
                held = b"s" + found.tobytes() if len(found) else b"t" + text.encode("utf-8", "surrogatepass") if text is not None else b"n%d:%d" % (part, row)
                keys.append(hashlib.md5(held).digest())
            full = [i for i, s in enumerate(sets) if len(s)]
            made = dict(zip(full, signatures([sets[i] for i in full]), strict=True))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(keys, type=pa.binary()), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([made[i].tobytes() if i in made else None for i in range(len(sets))], type=pa.binary())],
                names=["id", "text_hash", "key", "n", "signature"],
            )

    return source.mapInArrow(run, f"id {kind}, text_hash bigint, key binary, n bigint, signature binary")


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key and shingles of the wanted sets, from one of their documents (wanted: key, id, text_hash)."""
    source = docs.select(named(id_col).alias("id"), F.xxhash64(named(text_col).cast("string")).alias("text_hash"), named(text_col).cast("string").alias("text"))
    rows = source.join(wanted.select("key", "id", "text_hash"), (source["id"].eqNullSafe(wanted["id"])) & (source["text_hash"] == wanted["text_hash"])).select("key", source["text"])

    def run(batches):
        import pyarrow.compute  # noqa: F401

        cache: dict = {}
        for piece in slices(batches, 1):
            sets = [shingles(t, cache).tobytes() for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sets, type=pa.binary())], names=["key", "shingles"])

    return rows.mapInArrow(run, "key binary, shingles binary").dropDuplicates(["key"])


def _paths(sets: DataFrame, runs: int) -> DataFrame:
    """path, key and n: every record at the first depth of every run."""

    def run(batches):
        start = roots(runs)
        for batch in batches:
            n = batch.num_rows
            signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(n, PLACES)
            row, path = descend(np.repeat(start, n), np.tile(signature, (runs, 1)), 0, FIRST_DEPTH)
            # Each path of a record once; all of them are here.
            order = np.lexsort((path, row % n))
            record, path = (row % n)[order], path[order]
            new = np.append(True, (record[1:] != record[:-1]) | (path[1:] != path[:-1]))
            record, path = record[new], path[new]
            held = pa.array(record)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column(0).take(held), batch.column(2).take(held)], names=["path", "key", "n"])

    return sets.select("key", "signature", "n").mapInArrow(run, "path bigint, key binary, n bigint")


def _deeper(rows: DataFrame, sets: DataFrame, depth: int) -> DataFrame:
    """path, key and n of the rows at a depth some levels further down."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            signature = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32).reshape(n, PLACES)
            row, path = descend(batch.column(0).to_numpy().view(np.uint64), signature, depth, depth + DEPTH_STEP)
            held = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column(1).take(held), batch.column(3).take(held)], names=["path", "key", "n"])

    return rows.select("path", "key", "n").join(sets.select("key", "signature"), "key").select("path", "key", "signature", "n").mapInArrow(run, "path bigint, key binary, n bigint")


def _blocks():
    """Blocks of a bucket of `size` records with `runs` runs of words."""
    return F.least(F.col("size"), F.greatest(F.ceil(F.col("size") / BUCKET), F.ceil(F.col("runs") / BLOCK_RUNS))).cast("int").alias("blocks")


def _merged(rows: DataFrame) -> DataFrame:
    """path, key and blocks of the buckets to compare (rows: path, key, n, size and blocks of the bucket).

    Near copies meet in many buckets, and each would be sent to the pairs of blocks of all of them. So a bucket joins the
    one that is the largest for the most of its records (ALIKE of them at least), if what comes of it sends no more rows
    to pairs of blocks. Records of one bucket stay together either way."""
    largest = rows.groupBy("key").agg(F.max(F.struct("size", "path")).alias("most")).select("key", F.col("most.path").alias("into"))
    shared = rows.join(largest, "key").groupBy("path", "into").agg(F.count("*").alias("shared"), F.first("size").alias("size"), F.first("blocks").alias("blocks"))
    most = F.max(F.struct("shared", "into")).alias("most")
    into = F.when(F.col("most.shared") >= F.col("size") * ALIKE, F.col("most.into")).otherwise(F.col("path")).alias("into")
    into = checkpointed(shared.groupBy("path").agg(most, F.first("size").alias("size"), F.first("blocks").alias("blocks")).select("path", into, "size", "blocks"))
    before = into.groupBy("into").agg(F.sum(F.col("size") * F.col("blocks")).alias("before"), F.count("*").alias("buckets")).where("buckets > 1")
    joined = into.select("path", "into").join(before, "into").select("path", "into", "before")
    moved = checkpointed(rows.select("path", "key", "n").join(joined, "path").groupBy("into", "key").agg(F.max("n").alias("n"), F.max("before").alias("before")))
    after = moved.groupBy("into").agg(F.count("*").alias("size"), F.sum("n").alias("runs"), F.max("before").alias("before")).select("into", "size", _blocks(), "before")
    better = checkpointed(after.where("size * blocks <= before").select("into", "blocks"))
    # A path of its own, as the bucket that gives its name may itself have joined another.
    one = moved.join(better, "into").select(F.xxhash64(F.lit("joined"), "into").alias("path"), "key", "blocks")
    apart = into.join(better, "into", "left_anti").select("path")
    return one.unionByName(rows.join(apart, "path").select("path", "key", "blocks"))


def _buckets(sets: DataFrame, runs: int) -> DataFrame:
    """path, key and blocks: the buckets to compare. Buckets over BUCKET records or BLOCK_RUNS runs of words at the last
    depth, or of joined buckets, have blocks > 1."""
    rows, depth, done = _paths(sets, runs), FIRST_DEPTH, None
    while True:
        rows = checkpointed(rows if depth == FIRST_DEPTH else rows.distinct())
        released(sets.sparkSession)
        # One row for each path comes from each task; buckets of one record end here.
        sizes = checkpointed(rows.groupBy("path").agg(F.count("*").alias("size"), F.sum("n").alias("runs")).where("size > 1").select("path", "size", _blocks()))
        large = sizes.where("blocks > 1")
        last = depth >= LAST_DEPTH or large.isEmpty()
        ready = sizes if last else sizes.where("blocks = 1")
        part = rows.join(ready, "path").select("path", "key", "n", "size", "blocks")
        done = part if done is None else done.unionByName(part)
        if last:
            done = checkpointed(done)
            released(sets.sparkSession)
            return _merged(done)
        rows = _deeper(rows.join(large.select("path"), "path"), sets, depth)
        depth += DEPTH_STEP


def _by_bucket(batches, columns: int):
    """Lists of the rows of each bucket, from rows sorted by the first three columns."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(columns)), strict=True):
            if row[:3] != now:
                if len(held) > 1:
                    yield now, held
                now, held = row[:3], []
            held.append(row)
    if len(held) > 1:
        yield now, held


def _likely(bucket, rows) -> np.ndarray:
    """Pairs (as a boolean matrix) whose signatures agree and whose first common bucket is this one."""
    path, low, high = bucket
    m = len(rows)
    signature = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint32).reshape(m, PLACES)
    size = np.array([r[6] for r in rows])
    agree = np.zeros((m, m), dtype=np.uint8)
    for i in range(PLACES):
        _, value = np.unique(signature[:, i], return_inverse=True)
        agree += value[:, None] == value
    likely = np.triu(agree >= LIKELY * PLACES, 1)
    # The similarity is at most the ratio of the sizes.
    likely &= np.minimum(size[:, None], size) * THRESHOLD[1] >= np.maximum(size[:, None], size) * THRESHOLD[0]
    if low != high:
        block = np.array([r[4] for r in rows])
        likely &= block[:, None] != block
    if likely.any():
        before = [np.array([p for p in r[7] if p < path], dtype=np.int64) for r in rows]
        likely &= intersections(before) == 0
    return likely


def _candidates(placed: DataFrame) -> DataFrame:
    """path, low, high, key of the records that have a likely partner in the bucket."""

    def run(batches):
        for bucket, rows in _by_bucket(batches, 8):
            likely = _likely(bucket, rows)
            found = np.flatnonzero(likely.any(axis=0) | likely.any(axis=1))
            if len(found):
                chosen = [rows[i] for i in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in chosen], type=t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()), (3, pa.binary()), (4, pa.int32()), (5, pa.binary()), (6, pa.int64()), (7, pa.list_(pa.int64())))], names=["path", "low", "high", "key", "block", "signature", "n", "paths"])

    return placed.mapInArrow(run, "path bigint, low int, high int, key binary, block int, signature binary, n bigint, paths array<bigint>")


def _exact(placed: DataFrame) -> DataFrame:
    """key, root, links: for each record of a bucket that has links there, a local root and the documents linked."""

    def run(batches):
        for bucket, rows in _by_bucket(batches, 10):
            likely = _likely(bucket, rows)
            at = np.argwhere(likely)
            if not len(at):
                continue
            used = np.unique(at)
            sets = [np.frombuffer(rows[i][8], dtype=np.uint64) for i in used]
            both = intersections(sets)
            place = np.searchsorted(used, at)
            common = both[place[:, 0], place[:, 1]]
            sizes = np.array([len(s) for s in sets])
            linked = at[common * (THRESHOLD[0] + THRESHOLD[1]) >= THRESHOLD[0] * (sizes[place[:, 0]] + sizes[place[:, 1]])]
            if not len(linked):
                continue
            weight = np.array([r[9] for r in rows], dtype=np.int64)
            links = np.zeros(len(rows), dtype=np.int64)
            np.add.at(links, linked[:, 0], weight[linked[:, 1]])
            np.add.at(links, linked[:, 1], weight[linked[:, 0]])
            label = np.arange(len(rows))
            while True:  # least labels along the links
                new = label.copy()
                np.minimum.at(new, linked[:, 0], label[linked[:, 1]])
                np.minimum.at(new, linked[:, 1], label[linked[:, 0]])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            out = np.unique(linked)
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][3] for i in out], type=pa.binary()), pa.array([rows[label[i]][3] for i in out], type=pa.binary()), pa.array(links[out])], names=["key", "root", "links"])

    return placed.mapInArrow(run, "key binary, root binary, links bigint")


def intersections(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections of different sets, by products of slices of the incidence matrix."""
    m = len(sets)
    universe, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    # What only one set holds is in no intersection.
    shared = held > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    universe = universe[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((m, m), dtype=np.float32)
    for start in range(0, len(universe), width):
        low, high = np.searchsorted(column, (start, start + width))
        part = np.zeros((m, width), dtype=np.float32)
        part[row[low:high], column[low:high] - start] = 1
        both += part @ part.T
    return np.rint(both).astype(np.int64)


def components(edges: DataFrame, a: str = "key", b: str = "root") -> DataFrame:
    """node and least node of its component, for the nodes of the edges, by alternating stars.

    Minima are pre-aggregated before any shuffle and met in a join. They are written first, so that both sides of the
    join are exchanges of their own and Spark can split the rows of a node of any degree among tasks."""
    now = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("least"))
        before = state
        # Large star: neighbours above a node go to the least of its neighbourhood.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpointed(both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: neighbours at or below a node, and itself, go to the least of these.
        low = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        now = checkpointed(small.where("u <> v").distinct())
        released(edges.sparkSession)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_recall: float = TARGET_RECALL) -> DataFrame:
    """For each document: id, text_hash, class_id (the least id of its class), n_links (documents linked to it, copies
    counted one by one), n_copies (documents of the same set), and `kept`: the row, by id and text_hash, that
    stands for the class."""
    small_batches(docs.sparkSession)
    records = checkpointed(_records(docs, id_col, text_col))
    sets = checkpointed(records.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct("id", "text_hash")).alias("first"), F.max("n").alias("n"), F.max("signature").alias("signature")))
    worded = sets.where("n > 0")
    buckets = checkpointed(_buckets(worded, runs_needed(target_recall)))
    released(docs.sparkSession)
    # The final paths of each record: a bounded list.
    paths = buckets.groupBy("key").agg(F.collect_list("path").alias("paths"))
    block = F.pmod(F.xxhash64("key", "path"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.struct(F.least(c, F.col("block")).alias("low"), F.greatest(c, F.col("block")).alias("high")))
    spread = buckets.withColumn("block", block).select("path", "key", "block", F.explode(pairs).alias("p")).select("path", "p.low", "p.high", "key", "block")
    placed = spread.join(worded.select("key", "signature", "n"), "key").join(paths, "key").select("path", "low", "high", "key", "block", "signature", "n", "paths")
    at = ["path", "low", "high"]
    likely = checkpointed(_candidates(placed.repartition(*at).sortWithinPartitions(*at)))
    released(docs.sparkSession)
    wanted = likely.select("key").distinct().join(sets.select("key", "copies", "first.id", "first.text_hash"), "key")
    wanted = checkpointed(wanted)
    shingled = _sets_of(docs, wanted, id_col, text_col)
    ready = likely.join(shingled, "key").join(wanted.select("key", "copies"), "key").select("path", "low", "high", "key", "block", "signature", "n", "paths", "shingles", "copies")
    linked = checkpointed(_exact(ready.repartition(*at).sortWithinPartitions(*at)))
    released(docs.sparkSession)
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    least = components(linked).withColumnRenamed("node", "key")
    named = sets.select("key", "copies", "first").join(least, "key", "left").join(links, "key", "left").withColumn("least", F.coalesce("least", "key"))
    named = checkpointed(named)
    heads = named.groupBy("least").agg(F.min("first").alias("kept"))
    info = named.join(heads, "least").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), "kept")
    return records.select("key", "id", "text_hash").join(info, "key").select(F.col("id").alias(id_col), "text_hash", F.col("kept.id").alias("class_id"), "n_links", "n_copies", F.struct(F.col("kept.id").alias("id"), F.col("kept.text_hash").alias("text_hash")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class: the least id, and of rows with that id and the same text any one. Null
    texts, which are of no class, all stay. The columns of docs, whatever their names."""
    worded = docs.where(named(text_col).isNotNull())
    kept = join(worded.select(named(id_col).alias("id"), named(text_col).alias("text")), "id", "text").select("kept").distinct().select(F.col("kept.id").alias("__id"), F.col("kept.text_hash").alias("__hash"))
    kept = checkpointed(kept)
    rows = packed(docs, id=named(id_col), text_hash=F.xxhash64(named(text_col).cast("string")), unworded=named(text_col).isNull())
    met = rows.where("not unworded").join(kept, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left_semi").dropDuplicates(["id", "text_hash"])
    return unpacked(met.select("__row").unionByName(rows.where("unworded").select("__row")), docs.columns)


def brute_force(texts: list) -> list[tuple]:
    """(least index of the class, links, copies) for each text by comparing all sets; for tests."""
    cache: dict = {}
    sets = [set(shingles(t, cache).tolist()) for t in texts]
    n = len(texts)
    linked = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                same = common * (THRESHOLD[0] + THRESHOLD[1]) >= THRESHOLD[0] * (len(sets[i]) + len(sets[j]))
            else:
                same = not sets[i] and not sets[j] and texts[i] is not None and texts[i] == texts[j]
            linked[i][j] = linked[j][i] = same
    label = list(range(n))
    changed = True
    while changed:
        new = [min([label[i], *(label[j] for j in range(n) if linked[i][j])]) for i in range(n)]
        changed, label = new != label, new
    copies = [sum(1 for j in range(n) if texts[j] is not None and sets[j] == sets[i] and (sets[i] or texts[i] == texts[j])) if texts[i] is not None else 1 for i in range(n)]
    return [(label[i], sum(linked[i]), copies[i]) for i in range(n)]
