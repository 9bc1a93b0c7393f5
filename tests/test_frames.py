"""Queries cover all frames of a table."""

import numpy as np
from test_catalog import spark  # noqa: F401

from chronovox import catalog


def test_displacement_of_all_frames(spark, tmp_path):  # noqa: F811
    at = np.random.Generator(np.random.PCG64(8)).random((80, 3))
    spark.createDataFrame([(k, p.tolist(), 0) for k, p in enumerate(at)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(r.id for r in catalog.QUERIES["nonlinear_displacement"](spark, str(tmp_path)).collect())
    assert got == [k for k in range(80) if k % 5 > 1]
