"""Every core query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from placetrail.plans import core_queries

SLOW = {"loop_scan_l2_tight", "loop_scan_warmup_first", "loop_scan_no_warmup", "loop_report_b", "loop_report_c"}


def rows(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
            return "null"
        if isinstance(v, str):
            return v
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return str(bool(v))
        try:
            return repr(round(float(v), 5) + 0.0)
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(value, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(core_queries.SQL) - SLOW))
def test_same_rows(spark, data, duck, name):
    got = __spark_entry__.queries()[name](spark, data).toPandas()
    want = duck.sql(core_queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_give_rows(spark, data):
    for name in sorted(set(core_queries.QUERIES) - set(core_queries.SQL)):
        assert not __spark_entry__.queries()[name](spark, data).isEmpty(), name


def test_entry_gives_loops(spark, data):
    assert __spark_entry__.entry(spark).count() == 107
