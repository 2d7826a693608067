"""Inputs of the registered queries: prompts composed from the star schema, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digits import shifted_lists
from ..functions.held import held
from ..operators.spans import parsed

VARIANTS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if a small table would leave some of them idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ner: a prompt for every order with person, place, identifier, date and amount marked; the person twice."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    mark = lambda word, kind: [F.lit("<redacted> "), word, F.lit(f" ({kind}) </redacted>")]
    text = F.concat(
        F.lit("Customer "), *mark(F.col("c_name"), "PERSON"), F.lit(" of "), *mark(F.col("n_name"), "GPE"), F.lit(" placed order "),
        *mark(F.col("o_orderkey").cast("string"), "ID"), F.lit(" on "), *mark(F.date_format("o_orderdate", "MMMM d, yyyy"), "DATE"), F.lit(" for "),
        *mark(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)), "MONEY"), F.lit(". Reply to "), *mark(F.col("c_name"), "PERSON"), F.lit("."),
    )
    return joined.select(F.col("o_orderkey").alias("doc_id"), text.alias("ner"))


def with_fakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ner, fakes: for every span VARIANTS candidates of other digits; a repeated word has the same ones."""
    rows = held(prompts(spark, sf_dir), words=F.transform(parsed(F.col("ner")), lambda s: s["word"]))
    return rows.select("doc_id", "ner", shifted_lists(F.col("words"), F.col("doc_id"), VARIANTS).alias("fakes"))


PATTERN = r"<redacted>\s*([^(]+?)\s*\(([^)]+)\)\s*</redacted>"
NER_SQL = """ner AS (
  SELECT o_orderkey AS doc_id, 'Customer <redacted> ' || c_name || ' (PERSON) </redacted> of <redacted> ' || n_name || ' (GPE) </redacted> placed order <redacted> '
    || o_orderkey || ' (ID) </redacted> on <redacted> ' || strftime(o_orderdate, '%B %-d, %Y') || ' (DATE) </redacted> for <redacted> $'
    || format('{:,.2f}', o_totalprice) || ' (MONEY) </redacted>. Reply to <redacted> ' || c_name || ' (PERSON) </redacted>.' AS ner
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
SPANS_SQL = NER_SQL + f""", lists AS (
  SELECT doc_id, regexp_extract_all(ner, '{PATTERN}', 1) AS w, regexp_extract_all(ner, '{PATTERN}', 2) AS t FROM ner),
spans AS (
  SELECT doc_id, pos - 1 AS pos, trim(w[pos]) AS word, trim(t[pos]) AS type FROM (SELECT doc_id, w, t, unnest(generate_series(1, len(w))) AS pos FROM lists))"""
#: A digit shifted by 1 to 9, by the digit at its place of a hash of (document|word, variant).
SHIFT_SQL = "list_aggregate(list_transform(string_split(word, ''), lambda c, i: CASE WHEN c BETWEEN '0' AND '9' THEN CAST((TRY_CAST(c AS INT) + 1 + (strpos('0123456789abcdef', substr(md5(doc_id || '|' || word || '|' || j), (i - 1) % 32 + 1, 1)) - 1) % 9) % 10 AS VARCHAR) ELSE c END), 'string_agg', '')"
FAKES_SQL = SPANS_SQL + f""", options AS (
  SELECT doc_id, pos, word, type, j, {SHIFT_SQL} AS fake FROM spans, (SELECT unnest(range({VARIANTS})) AS j)),
pieces AS (SELECT doc_id, string_split_regex(ner, '{PATTERN}') AS p FROM ner),
samples AS (
  SELECT o.doc_id, o.j AS sample_idx, any_value(p)[1] || string_agg(fake || p[pos + 2], '' ORDER BY pos) AS text
  FROM options o JOIN pieces USING (doc_id) GROUP BY o.doc_id, o.j)"""
