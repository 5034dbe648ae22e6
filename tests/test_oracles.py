"""Every registered query against its SQL oracle, on the smallest test tables."""

from __future__ import annotations

import duckdb
import pytest

from backhaul.checks.oracles import ORACLES
from backhaul.checks.queries import QUERIES, registered
from conftest import SF_DIR

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    ours = registered()[name](spark, str(SF_DIR))
    theirs = duck.sql(ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    got = plain(ours.columns, [tuple(r) for r in ours.collect()])
    assert got == plain(theirs.columns, theirs.fetchall())


