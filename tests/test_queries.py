"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


#: Queries whose result may be empty on the smallest tables.
FEW = {"correlated_subquery"}
#: What a column must show, each value once at least.
OUTCOMES = {
    "lateness_gate": {"admitted": {True, False}},
    "timed_id_floor": {"outcome": {"expired", "valid", "future", "malformed"}},
    "dedupe_receipts": {"outcome": {"accepted", "duplicate", "conflict"}},
    "database_admission": {"outcome": {"accepted", "duplicate", "refused"}},
    "validation_rejects": {"problem": {"none", "value", "tenant", "series"}},
    "catalog_jobs": {"latest_success": {None, True, False}, "paused": {True, False}},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    other = duck.sql(ORACLES[name])
    assert columns == sorted(other.columns)
    places = [other.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in places) for r in other.fetchall()), key=repr)
    assert mine == theirs
    assert theirs or name in FEW
    for column, outcomes in OUTCOMES.get(name, {}).items():
        assert {r[columns.index(column)] for r in theirs} == outcomes


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
