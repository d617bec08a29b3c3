"""Every registered query against its SQL in DuckDB, on the driver's small tables if they are there."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from cellframe import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: [(x is None, str(type(x)), x) for x in r])


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    sql = f"select {quoted} from ({registry.SQL[name]})"
    assert columns == sorted(duck.sql(registry.SQL[name]).columns)
    assert rows(df.select(*columns).collect()) == rows(duck.sql(sql).fetchall())
