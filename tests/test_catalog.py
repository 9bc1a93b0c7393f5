"""Each query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

from chronovox import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def spark(tmp_path_factory):
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("c"))).config("spark.sql.session.timeZone", "UTC").getOrCreate()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    other = sorted((tuple(plain(x) for x in r) for r in want.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall()), key=str)
    assert len(rows) == len(other)
    for a, b in zip(rows, other, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if not any(isinstance(x, str) or x is None for x in a) else str(a) == str(b)
