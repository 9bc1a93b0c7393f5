"""Landmark pairs of all frames against all permutations."""

import itertools
import math

import numpy as np
from test_catalog import spark  # noqa: F401

from chronovox import catalog


def test_landmarks_of_all_frames(spark, tmp_path):  # noqa: F811
    at = np.random.Generator(np.random.PCG64(6)).random((56, 3)).astype(np.float32)
    label = [(k // 8) % 2 if k % 3 else 0 for k in range(56)]
    spark.createDataFrame([(k, p.tolist(), label[k]) for k, p in enumerate(at)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["landmark_assignment"](spark, str(tmp_path)).collect()
    for t in range(7):
        for g in (0, 1):
            a, b = ([k for k in range(56) if k % 8 == f and label[k] == g] for f in (t, t + 1))
            own = [r for r in got if r.t == t and r.g == g]
            few, many = sorted((a, b), key=len)
            best = min(sum(math.dist(at[i], at[j]) for i, j in zip(few, p)) for p in itertools.permutations(many, len(few)))
            assert len(own) == len({r.a for r in own}) == len({r.b for r in own}) == len(few)
            assert {r.a for r in own} <= set(a) and {r.b for r in own} <= set(b)
            assert math.isclose(sum(r.cost for r in own), best, abs_tol=1e-6)
    assert {r.t for r in got} == set(range(7))
