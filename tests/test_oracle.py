"""Every query that has SQL, against DuckDB on the same files."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from tidemark import registry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.5f}"
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    ours = registry.queries()[name](spark, SF_DIR)
    theirs = duck.execute(SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    got, wanted = rows(ours.columns, ours.collect()), rows(columns, theirs.fetchall())
    assert len(got) == len(wanted)
    assert got == wanted
