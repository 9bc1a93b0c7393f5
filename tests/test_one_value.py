"""Block matching of an image of one value, as the largest of very many draws is in every voxel."""

import duckdb
import numpy as np
from test_catalog import spark  # noqa: F401

from chronovox import catalog
from chronovox.operators import registration


def test_query_of_one_value(spark, tmp_path):  # noqa: F811
    rows = [(x, y, z, 50.0) for x in range(32) for y in range(32) for z in range(1, 4)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = {(r.r, r.c): r.v for r in catalog.QUERIES["block_matching"](spark, str(tmp_path)).collect()}
    assert got == {(r, c): v for r, c, v in con.sql(catalog.ORACLE_SQL["block_matching"]).fetchall()}


def test_extents_count_only_without_values(spark):  # noqa: F811
    image = spark.createDataFrame([(x, 0, 0, float(x)) for x in range(4)], "x long, y long, z long, v double")
    assert registration.between_extents(image, image) is None
    one = spark.createDataFrame([(x, 2, 0, 7.0) for x in range(4)], "x long, y long, z long, v double")
    assert np.allclose(registration.between_extents(one, image)[:3, 3], [0, -2, 0])
