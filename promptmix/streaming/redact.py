"""The stateless stages on streams: the same expressions over readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.held import held
from ..operators.spans import RegexRecogniser, clipped, redacted


def redact(df: DataFrame, text_col: str = "text", out_col: str = "redacted", recogniser=None) -> DataFrame:
    """df (static or streaming) with recognised entities marked in the text."""
    found = (recogniser or RegexRecogniser()).entities(F.col(text_col))
    spans = F.array_sort(F.transform(found, lambda x: F.named_struct(F.lit("start"), x["start"], F.lit("end"), x["end"], F.lit("label"), x["entity_type"])))
    # Texts without entities, most of them, stay as they are.
    rows = held(df, __spans=clipped(spans, F.length(text_col)))
    return held(rows, **{out_col: F.when(F.size("__spans") > 0, redacted(F.col(text_col), F.col("__spans"))).otherwise(F.col(text_col))}).drop("__spans")


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A parquet table as a stream of files; the path may be a file or a folder."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"  # a stream takes one file as a pattern only
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """All that is available now, written to Parquet files of a shared folder, with the stream's checkpoint beside them."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_to_table(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All that is available now, written to a memory table; for tests and small tables."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
