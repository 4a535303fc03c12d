"""Registered queries against their SQL on the smallest data, and streams against batch."""

import os

import duckdb
import pytest

from optlake import catalog
from optlake.catalog.registry import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.load()
SOME = ["a01_agreement", "g01_built_objects", "j04_owner_attribution", "j17_fragment_merge", "j07_modalias_match", "w09_highest_version", "a09_cost_ledger", "s08_indirect_sources", "t01_windowed_cost", "t02_build_status"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: "~" if x is None else repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert normal(df.collect(), df.columns) == normal(want.fetchall(), names)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
