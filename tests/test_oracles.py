"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")


def shown(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return f"{float(value):.7f}" if math.isfinite(float(value)) else str(value)
    return str(value)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(shown(v) for v in r) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert rows(entry.queries()[name](spark, DATA).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
