"""Every treebank query against its DuckDB twin, over the whole smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from arborlake.plans.catalogue import CATALOGUE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "nation"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rounded(row):
    return tuple(round(x, 5) if isinstance(x, float) and math.isfinite(x) else x for x in row)


@pytest.mark.parametrize("name", CATALOGUE)
def test_query_equals_sql(spark, duck, name):
    query, sql = CATALOGUE[name]
    ours = query(spark, SF)
    names = sorted(ours.columns)
    found = Counter(rounded(r) for r in ours.select(*names).collect())
    if sql is None:
        assert found
        return
    theirs = duck.sql(sql)
    assert names == sorted(theirs.columns)
    expected = Counter(map(rounded, theirs.select(", ".join(f'"{n}"' for n in names)).fetchall()))
    assert found == expected, list((found - expected).items())[:3] + ["expected"] + list((expected - found).items())[:3]


def test_entry_is_registered(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
