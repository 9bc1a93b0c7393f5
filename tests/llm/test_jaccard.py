"""The near-duplicates stage against the Jaccard similarity of all pairs."""

import re

import numpy as np
import pytest
from conftest import SCHEMA, text

import corpus_pipeline as pipeline
from chronovox.llm import jaccard


def brute_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def edited(t, seed, n):
    """t with n of its words replaced, apart from each other."""
    w = t.split()
    for p in np.random.Generator(np.random.PCG64(seed)).choice(len(w), n, replace=False):
        w[p] = f"new{seed}x{p}"
    return " ".join(w)


def families():
    rows = []
    for k in range(12):
        own = text(300 + k, 60 + 40 * k)
        rows += [own, own, own.upper()]
        for j, n in enumerate((1, 1, 2, 3, 5, 8, 12)):
            rows.append(edited(own, 100 * k + j, n))
    rows += [own + " " + text(900 + k, m) for k, m in enumerate((5, 60, 120, 200, 900))]
    return [*rows, "a b", "A  b", "a b c", "a b c d e", "a b c d e f", "", None, " \n"]


def components(texts):
    sets, group = [brute_set(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if (not both or 5 * len(sets[a] & sets[b]) >= 4 * both) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return group


@pytest.mark.parametrize("block", [500, jaccard.BLOCK])
def test_near_copies_against_all_pairs(spark, block):
    texts = families()
    got = dict(map(tuple, jaccard.near_copies(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", block=block).collect()))
    assert [got[k] for k in range(len(texts))] == components(texts)


def test_stage_drops_edited_copies_and_keeps_others(spark, tmp_path):
    texts = families()
    rows = [(100 + k, t, "en", "a", 0) for k, t in enumerate(texts)]
    got = sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect())
    assert got == sorted(100 + k for k in set(components(texts)))
