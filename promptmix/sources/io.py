"""Sources and sinks: JSON lines in three error modes, alias resolution, samples of several shapes, limits, summaries."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import non_empty

MASKED = "text string, masked_text string"
LABELLED = "source_text string, language string, privacy_mask array<struct<label:string,start:int,end:int,value:string,label_index:int>>"
NER = "original_text string, text string, raw_text string, ner_formatted_text string, ner_text string, masked_text string, type string"
GENERATED = "original_text string, ner_formatted_text string, obfuscated_samples string, real_to_fake_mapping map<string,array<string>>, generation_time_s double"
CORRUPT = "_corrupt_record"

#: Where each logical field is looked for, in order.
ALIASES = {
    "original": ("original_text", "text", "raw_text"),
    "ner": ("ner_formatted_text", "ner_text", "masked_text"),
    "sensitive": ("ner_formatted_text", "masked_text", "ner_text"),
    "record_id": ("record_id", "id", "uuid", "doc_id"),
}


def read_jsonl(spark: SparkSession, path: str, schema: str, bad_lines: str = "fail", stream: bool = False) -> DataFrame:
    """JSON lines of a given schema. bad_lines: `fail`, `drop`, or `keep` (their text in the column of CORRUPT)."""
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad_lines]
    held = T.StructType.fromDDL(schema if bad_lines != "keep" else f"{schema}, {CORRUPT} string")
    reader = (spark.readStream if stream else spark.read).schema(held).option("mode", mode)
    if bad_lines == "keep":
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_with_bad_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines of df as JSON, and lines that could not be read as they were."""
    fields = [c for c in df.columns if c != CORRUPT]
    df.select(F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*fields))).alias("value")).write.mode(mode).text(path)


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A data set by its format; other sources join as Spark data sources."""
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path)


class FolderSource(DataSource):
    """`spark.dataSource.register(FolderSource)`, then `spark.read.format("records").schema(...).option("path", folder)`:
    data sets laid out as folder/config/split*.jsonl (options config and split; the folder itself and `train` if not given).
    Each file is a partition; a line that is no object raises."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FolderReader(schema, self.options)


class FolderReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names = schema.fieldNames()
        self.pattern = os.path.join(options["path"], options.get("config", ""), f"{options.get('split', 'train')}*.jsonl")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(path) for path in sorted(glob.glob(self.pattern))]

    def read(self, partition: InputPartition):
        with open(partition.value, encoding="utf-8") as lines:
            for line in lines:
                if line.strip():
                    row = json.loads(line)
                    yield tuple(row.get(n) for n in self.names)


def field(df: DataFrame, logical: str) -> Column:
    """The first of a logical field's columns that df has and that is not empty in the row; list values are joined."""
    present = [c for c in ALIASES[logical] if c in df.columns]
    if not present:
        return F.lit("")
    text = lambda c: F.array_join(F.col(c), " ") if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c).cast("string")
    return non_empty(*map(text, present))


def without_statistics(df: DataFrame) -> DataFrame:
    """Records without the trailing line of statistics."""
    return df.where(F.coalesce(F.col("type"), F.lit("")) != "ner_statistics") if "type" in df.columns else df


def read_limit(df: DataFrame, id_col: str, n: int | None) -> DataFrame:
    """The first n rows by id, taken before any filter; all rows if n is none, 0 or less."""
    return df.orderBy(id_col).limit(n) if n and n > 0 else df


def samples_of(column: Column) -> Column:
    """array<struct<text, prob>> of a JSON array whose items are texts, [text, prob] pairs, or objects with a text."""
    items = F.from_json(column, "array<string>")

    def item(x: Column) -> Column:
        pair, record = F.from_json(x, "array<string>"), F.from_json(x, "struct<text:string,prob:double>")
        is_pair, is_record = F.startswith(F.ltrim(x), F.lit("[")) & pair.isNotNull(), F.startswith(F.ltrim(x), F.lit("{")) & record["text"].isNotNull()
        text = F.when(is_record, record["text"]).when(is_pair, F.get(pair, F.lit(0))).otherwise(x)
        prob = F.when(is_record, record["prob"]).when(is_pair, F.get(pair, F.lit(1)).try_cast("double"))
        return F.struct(text.alias("text"), F.coalesce(prob, F.lit(1.0)).alias("prob"))

    return F.coalesce(F.transform(items, item), F.array().cast("array<struct<text:string,prob:double>>"))


def append_summary(summary: DataFrame, path: str) -> list:
    """One-row summaries gathered in a JSON file on the driver: the first alone, later ones as an array; a file that
    cannot be read is begun afresh."""
    new = json.loads(summary.toJSON().first())
    held = None
    if os.path.exists(path):
        try:
            with open(path, encoding="utf-8") as f:
                held = json.load(f)
        except ValueError:
            held = None
    out = new if held is None else [*(held if isinstance(held, list) else [held]), new]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, ensure_ascii=False, indent=2)
    return out if isinstance(out, list) else [out]
