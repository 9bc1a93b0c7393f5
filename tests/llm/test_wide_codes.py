"""Wide SimHash codes: the bit planes against all pairs, and the pipeline's near-duplicates by them."""

import numpy as np
import pytest
from conftest import SCHEMA
from test_jaccard import edited, text

import corpus_pipeline as pipeline
from chronovox.llm import jaccard, simhash

SHARE = simhash.apart(0.8)


def drawn(n, seed, clones=0):
    """Codes of several families, of bits changed here and there."""
    r = np.random.default_rng(seed)
    codes = r.integers(0, 1 << 63, (max(1, n // 5), 3), dtype=np.uint64)[r.integers(0, max(1, n // 5), n)]
    codes[:clones] = codes[:1]
    for row in codes:
        for p in r.integers(0, 192, r.integers(0, 60)).tolist():
            row[p // 64] ^= np.uint64(1 << (p % 64))
    return codes


@pytest.mark.parametrize("n, buckets, clones", [(0, 1, 0), (1, 1, 0), (300, 3, 0), (700, 1, 0), (1000, 40, 0), (900, 2, 600)])
def test_linked_wide_against_all_pairs(n, buckets, clones):
    codes, bucket = drawn(n, n, clones), np.sort(np.random.default_rng(7).integers(0, buckets, n))
    differ = np.bitwise_count(codes[:, None] ^ codes[None])
    near = (differ.sum(axis=2) <= 57) & (differ[:, :, 0] <= 25) & (bucket[:, None] == bucket[None])
    want = np.arange(n)
    while n and (want != (least := np.where(near, want[None], n).min(axis=1))).any():
        want = least
    got = simhash.linked_wide(codes, bucket, 57, 25)
    assert len({(a, b) for a, b in zip(got.tolist(), want.tolist(), strict=True)}) == len(set(got.tolist())) == len(set(want.tolist()))


def test_share_of_differing_bits():
    r, found = np.random.default_rng(3), []
    for _ in range(200):
        h = r.integers(0, 1 << 63, 900, dtype=np.uint64)
        a, b = (np.frombuffer(simhash.code(h[k]), "<u8") for k in (slice(0, 810), slice(90, 900)))  # 720 of 900 in common
        found.append(np.bitwise_count(a ^ b).sum() / simhash.WIDE)
    assert np.mean(found) == pytest.approx(SHARE, abs=0.005) and simhash.radius(192, SHARE) > 192 * max(found)


@pytest.mark.parametrize("met", [simhash.MET, 8])
def test_wide_links_find_near_codes_in_pieces_too(spark, met):
    sets = [np.random.default_rng(k // 6).integers(0, 1 << 63, 300, dtype=np.uint64)[k % 6 * 4 : 270 + k % 6 * 4] for k in range(240)]
    codes = [simhash.code(s) for s in sets]
    links = simhash.wide_links(spark.createDataFrame([(c,) for c in codes], "code binary"), SHARE, met).collect()
    label = [int.from_bytes(c[:8], "little", signed=True) for c in codes]
    own = {x: x for x in label}
    for r in links:
        own = {x: own[r.b] if y == own[r.a] else y for x, y in own.items()}
    label = [own[x] for x in label]
    assert len(set(label)) == 40 and all(label[k] == label[k - k % 6] for k in range(240))


def test_stage_takes_candidates_from_simhash(spark, tmp_path, monkeypatch):
    own = text(1, 200)
    rows = [(k, t, "en", "a", 0) for k, t in enumerate([own, own, edited(own, 2, 2), text(3, 200)])]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [0, 3]
    monkeypatch.setattr(jaccard.simhash, "wide_links", lambda codes, share: spark.createDataFrame([], "a long, b long"))
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [0, 2, 3]
