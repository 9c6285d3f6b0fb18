"""Every query with SQL against DuckDB, on the driver's small tables."""

import os

import duckdb
import pytest

import __spark_entry__
from earshot.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(str, frame.astype(object).where(frame.notna(), None).values.tolist()))


def number(frame):
    """Whole numbers as such where a null made them floats."""
    for c in frame.columns:
        if frame[c].dtype.kind in "fiu" or str(frame[c].dtype) in ("Int64", "Int32"):
            frame[c] = frame[c].astype(float)
    return frame


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    ours = number(__spark_entry__.queries()[name](spark, DATA).toPandas())
    assert rows(ours) == rows(number(duck.execute(registry.SQL[name]).df()))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
