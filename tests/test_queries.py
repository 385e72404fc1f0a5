"""Every query with SQL gives what DuckDB gives on the same tables; the others run."""

import math
from decimal import Decimal

import duckdb
import pytest

from pairlens.plans import registry
from pairlens.plans.fixtures import TABLES

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(x):
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return x


def rows(found):
    return sorted((tuple(plain(x) for x in r) for r in found), key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == names
    quoted = ", ".join(f'"{n}"' for n in names)
    assert rows(got.select(*names).collect()) == rows(duck.sql(f"select {quoted} from ({SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
