"""Queries of the operators that have SQL, against DuckDB on the same files."""

from pathlib import Path

import duckdb
import pytest

from tidemark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    theirs = duck.execute(SQL[name])
    columns = sorted(c[0] for c in theirs.description)
    wanted = sorted((tuple(r) for r in duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()), key=repr)
    ours = QUERIES[name](spark, SF)
    assert sorted(ours.columns) == columns
    assert sorted((tuple(r) for r in ours.select(*columns).collect()), key=repr) == wanted
