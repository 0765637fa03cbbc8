"""Every registered query with an oracle against DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module
from pixelloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bytes, bool)):
        return v
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return round(float(v), 9)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in table.select(names).to_pylist()), key=repr)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 64


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toArrow()) == rows(duck.sql(registry.ORACLE_SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
