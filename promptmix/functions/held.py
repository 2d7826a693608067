"""Columns computed once. The optimizer may move an expression into the body of a lambda that uses its column, where it
would be evaluated for every element; a generator in between keeps it where it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns added (or replaced), each evaluated once a row."""
    kept = [c for c in df.columns if c not in columns]
    once = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__held")
    return df.select(*df.columns, once).select(*kept, *[F.col(f"__held.{n}").alias(n) for n in columns])
