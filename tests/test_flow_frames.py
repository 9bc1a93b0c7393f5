"""Tracks go back to the first frame of a table."""

import numpy as np
from test_catalog import spark  # noqa: F401

from chronovox import catalog


def test_flow_reaches_the_first_frame(spark, tmp_path):  # noqa: F811
    at = np.random.Generator(np.random.PCG64(8)).random((32, 3))
    spark.createDataFrame([(k, p.tolist(), 0) for k, p in enumerate(at)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["flow_propagation"](spark, str(tmp_path)).collect()
    for t in range(8):
        assert {r.track for r in got if r.t == t} >= {k for k in range(32) if k % 8 == 7}
