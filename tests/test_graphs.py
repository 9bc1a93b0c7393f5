"""Components, stored results and their sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_catalog import spark  # noqa: F401

from chronovox.operators import checkpoints, graphs, lineage, voxels


def test_sizes_stay_bounded_over_rounds(spark):  # noqa: F811
    df = checkpoints.stored(spark.range(50).select("id", (F.col("id") + 1).alias("up")))
    for _ in range(30):
        df = checkpoints.stored(df.join(df.select(F.col("id").alias("up"), F.col("up").alias("next")), "up", "left").select("id", F.coalesce("next", "up").alias("up")))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 40
    assert {r.up for r in df.collect()} == {50}


@pytest.mark.parametrize("small", [0, 7, 1 << 18])
def test_components_against_search(spark, small):  # noqa: F811
    rng = np.random.Generator(np.random.PCG64(3))
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)]
    got = dict(map(tuple, graphs.named_by_least(spark.createDataFrame(edges, "a long, b long"), small).collect()))
    label = {x: x for e in edges for x in e}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert graphs.named_by_least(spark.createDataFrame([], "a long, b long"), small).collect() == []


def test_voxels_of_negative_places_and_beyond(spark):  # noqa: F811
    image = spark.createDataFrame([(-1, -1, 0, 1.0), (-1, 0, 0, 1.0), (-1, 0, -3, 1.0), (0, -2, 0, 1.0)], "x long, y long, z long, v double")
    assert len({r.component for r in voxels.components(image).collect()}) == 3
    with pytest.raises(Exception, match="numbered range"):
        voxels.components(image.withColumn("y", F.lit(500_000))).collect()


def test_cycles_raise(spark):  # noqa: F811
    with pytest.raises(ValueError, match="cycle"):
        lineage.to_root(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))
