"""Every registered query of the engine's own operators against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from conftest import SF, same_rows
from factloom.plans.oracles import oracle_sql
from factloom.plans.queries import queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_duckdb(spark, duck, name):
    ours, theirs = queries()[name](spark, SF).toPandas(), duck.sql(oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert same_rows(ours, theirs, sorted(ours.columns))


def test_entry_imports_without_optional_part():
    import __spark_entry__ as entry

    assert set(queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
