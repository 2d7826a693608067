"""The corpus queries that SQL can express, against DuckDB on the test tables."""

import glob
import os

import duckdb
import pytest

from promptmix.llm.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        duck.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(ORACLE[name])
    place = [[d[0] for d in result.description].index(c) for c in columns]
    assert mine == sorted((tuple(r[i] for i in place) for r in result.fetchall()), key=repr)
