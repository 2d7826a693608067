"""Shared plumbing of the corpus operators: Arrow-batched text maps with bounded memory,
the word rule used by matching operators, deterministic splits and bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import shared

#: Rows per Arrow batch sent to Python where the session does not say otherwise; batches of 64 MB, Spark's own bound, for
#: every task of an executor are too much beside its heap.
ARROW_ROWS = 1000
#: Bytes of text handled at once inside a Python worker; one longer text is handled alone.
SLICE_BYTES = 4_000_000

#: Bytes of a word after lower-casing A-Z (digits, a-z, all of UTF-8 beyond ASCII); the rest separate.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Lower-case A-Z and nothing else.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8."""
    return utf8(text).translate(WORD_BYTES).split()


def in_fold(doc_id, modulus: int, remainder: int):
    """Column: crc32(doc_id as text) mod modulus == remainder; false for a null id."""
    return F.coalesce(F.crc32(named(doc_id).cast("string").cast("binary")) % F.lit(modulus) == remainder, F.lit(False))


def small_batches(spark: SparkSession) -> None:
    """Batches of ARROW_ROWS for the session, unless the caller has chosen a size other than Spark's default."""
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(ARROW_ROWS))


def named(column: str):
    """Column of that very name, whatever signs it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, kept: list[str] | None = None, **columns) -> DataFrame:
    """One column `__row` that holds the kept columns of df (None: all), and the given ones beside it, so no name of the
    caller's can clash."""
    row = [named(c) for c in (df.columns if kept is None else kept)]
    return df.select(F.struct(*(row or [F.lit(True).alias("none")])).alias("__row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of the rows that `packed` held."""
    return df.select(*[F.col("__row").getField(n).alias(n) for n in names])


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 7) -> DataFrame:
    """Rows of df chosen by a hash of key, about `bound` of them at most in expectation.

    The fraction follows from one count; the choice does not depend on partitioning."""
    rows = df.count()
    if rows <= bound:
        return df
    cut = max(1, int(bound / rows * (1 << 30)))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < cut)


#: The folder of spark.checkpoint.dir, and tables written there.
shared_folder, checkpointed = shared.shared_folder, shared.written


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no table needs any more. It does so when the driver's JVM finds them
    unreferenced, for which a driver with little to do may not look for half an hour."""
    spark.sparkContext._jvm.System.gc()


def least_of_top(counts: DataFrame, bound: int) -> int | None:
    """The least n such that no more than `bound` rows of counts have it or more; None if the top n alone has more.

    It comes from a histogram of n (every value below 1024, 64 bars an octave above), not from a sort."""
    bar = F.when(F.col("n") < 1024, F.col("n").cast("double")).otherwise(1024 + F.floor(F.log2("n") * 64))
    least, held = None, 0
    for low, rows in sorted(((r["low"], r["rows"]) for r in counts.groupBy(bar.alias("bar")).agg(F.min("n").alias("low"), F.count("*").alias("rows")).collect()), reverse=True):
        held += rows
        if held > bound:
            break
        least = low
    return least


def bounded_rows(df: DataFrame, flag: str, bound: int, seed: int, *key: str) -> DataFrame:
    """df with the flag taken from some rows if it is set in far more than `bound`, as where one id has many texts."""
    rows = df.agg(F.count_if(flag)).first()[0]
    if rows <= 2 * bound:
        return df
    return df.withColumn(flag, F.col(flag) & (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) < int(bound / rows * (1 << 30))))


def quantiles(ordered: list, parts: int) -> list:
    """At most parts - 1 distinct cuts that deal the ordered values to parts of about equal size."""
    return sorted({ordered[len(ordered) * k // parts] for k in range(1, parts)}) if ordered else []


def slices(batches: Iterator[pa.RecordBatch], text_index: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece has at most `limit` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_index)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], list]], out_ddl: str, text_col: str = "text", keep: list[str] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """df with columns computed from one text column, in a single pass without a shuffle.

    `make` is called once in each task and returns a function from a list of texts (None where null) to one
    sequence per output column. `keep` names the columns passed through (None: all). A kept column that
    clashes with an output column gives way to it."""
    import pyarrow.compute  # noqa: F401

    small_batches(df.sparkSession)
    added = T.StructType.fromDDL(out_ddl)
    names = {f.name.lower() for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = packed(df, kept, text=named(text_col).cast("string"))
    schema = T.StructType([source.schema["__row"], *added.fields])
    types = [f.type for f in to_arrow_schema(added)]

    def run(batches):
        import pyarrow.compute  # noqa: F401

        function = make()
        for piece in slices(batches, 1, limit):
            found = function(piece.column(1).to_pylist())
            arrays = [pa.array(v, type=t) for v, t in zip(found, types, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(0), *arrays], names=["__row", *added.names])

    return source.mapInArrow(run, schema).select(*[F.col("__row").getField(c).alias(c) for c in kept], *added.names)
