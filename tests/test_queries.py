"""Every registered core query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from quarrion.plans import registry


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "NULL"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return repr([plain(x) for x in value])
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value))
    try:
        return repr(float(value)) if not isinstance(value, (str, bool)) else str(value)
    except (TypeError, ValueError):
        return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, oracle, name):
    got = registry.QUERIES[name](spark, data).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in registry.ORACLE_SQL:
        want = oracle.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
