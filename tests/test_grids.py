"""Images in blocks: round trips by every form, regions that open few blocks, layouts told by other programs' rules."""

import struct
import zlib

import numpy as np
import pytest
from test_catalog import spark  # noqa: F401

from chronovox.sources import binaries, grids

FIELDS = "image string, x long, y long, z long, v double"


def image(shape=(19, 7, 5), name="a", most=200, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, most, shape) * (rng.random(shape) < 0.5)
    v[-1, -1, -1] = 1
    return v, [(name, *map(int, p), float(v[tuple(p)])) for p in np.argwhere(v)]


def read(df):
    return sorted((r.x, r.y, r.z, r.v) for r in df.collect())


@pytest.mark.parametrize(("form", "kind", "pack"), [("klb", "u2", "zlib"), ("klb", "u1", "bzip2"), ("klb", "f4", "none"), ("klb", "i8", "zlib"), ("h5", "f8", "zlib"), ("h5", "i2", "none"), ("h5", "f4", "zlib"), ("inr", "i2", "none"), ("npy", "u4", "none"), ("mha", "f4", "none"), ("nii", "u1", "none")])
def test_round_trips(spark, tmp_path, form, kind, pack):  # noqa: F811
    (_, a), (_, b) = image(), image((3, 4, 11), "b", seed=2)
    df = spark.createDataFrame(a + b, FIELDS)
    grids.saved(grids.pieces(df, form, kind, (1.0, 2.0, 6.25), block=(8, 3, 2), pack=pack), str(tmp_path))
    got = grids.images(spark, str(tmp_path))
    for name, rows in (("a", a), ("b", b)):
        assert read(got.where(got.file.endswith(f"{name}.{form}"))) == sorted(r[1:] for r in rows)
    if form not in ("npy", "h5"):
        assert {(r.vx, r.vy, r.vz) for r in got.collect()} == {(1.0, 2.0, 6.25)}
    assert grids.images(spark, str(tmp_path), zeros=True).count() == 19 * 7 * 5 + 3 * 4 * 11
    if form not in ("klb", "h5"):  # the whole-file readers agree
        assert binaries.images(spark, str(tmp_path)).count() == got.count()


@pytest.mark.parametrize("form", ["klb", "h5"])
def test_a_region_opens_its_blocks_only(spark, tmp_path, form):  # noqa: F811
    v, rows = image((32, 32, 8))
    grids.saved(grids.pieces(spark.createDataFrame(rows, FIELDS), form, "u1", block=(8, 8, 2)), str(tmp_path))
    whole = grids.images(spark, str(tmp_path), most=1)  # a block a partition
    part = whole.where("x >= 9 AND x < 16 AND y = 3 AND z IN (4, 5)")
    assert whole.rdd.getNumPartitions() == 64 and part.rdd.getNumPartitions() == 1
    assert read(part) == sorted(r[1:] for r in rows if 9 <= r[1] < 16 and r[2] == 3 and r[3] in (4, 5))
    assert whole.where("z > 100").count() == 0 and whole.where("x = 3 AND v > 100").count() == (v[3] > 100).sum()


def test_many_chunks_have_an_index_of_several_levels(spark, tmp_path):  # noqa: F811
    v, rows = image((70, 70, 2))
    grids.saved(grids.pieces(spark.createDataFrame(rows, FIELDS), "h5", "u1", block=(1, 1, 1), pack="none"), str(tmp_path))
    assert len(grids.layout(f"{tmp_path}/a.h5").blocks) == 9800 and read(grids.images(spark, str(tmp_path))) == sorted(r[1:] for r in rows)


def test_fixed_bytes(spark, tmp_path):  # noqa: F811
    """A file put together by hand: 3 x 2 x 1 voxels in blocks of 2 x 2, the second compressed block narrower."""
    first, second = (zlib.compress(np.array(v, "<u2").tobytes()) for v in ([1, 2, 4, 5], [3, 6]))
    head = struct.pack("<B", 2) + struct.pack("<5I", 3, 2, 1, 1, 1) + struct.pack("<5f", 0.5, 0.5, 4, 1, 1) + bytes([1, 2]) + bytes(256) + struct.pack("<5I", 2, 2, 1, 1, 1)
    assert len(head) == 319
    (tmp_path / "own.klb").write_bytes(head + struct.pack("<2Q", len(first), len(first) + len(second)) + first + second)
    assert read(grids.images(spark, f"{tmp_path}/own.klb")) == [(0, 0, 0, 1), (0, 1, 0, 4), (1, 0, 0, 2), (1, 1, 0, 5), (2, 0, 0, 3), (2, 1, 0, 6)]
    np.save(tmp_path / "c.npy", np.arange(24).reshape(2, 3, 4))
    assert read(grids.images(spark, f"{tmp_path}/c.npy", zeros=True)) == [(x, y, z, 12.0 * x + 4 * y + z) for x in range(2) for y in range(3) for z in range(4)]


def test_rows_of_a_large_slice_are_blocks(monkeypatch):
    monkeypatch.setattr(grids, "VOXELS", 20)
    for slow in (False, True):
        blocks = grids.runs_of_rows((8, 9, 3), 2, 100, slow)
        assert sum(np.prod(b.shape) for b in blocks) == 216 and max(np.prod(b.shape) for b in blocks) <= 20
        assert [b.at for b in blocks] == (100 + 2 * np.cumsum([0, *[np.prod(b.shape) for b in blocks]])[:-1]).tolist()


def test_images_that_cannot_be_written(spark, tmp_path):  # noqa: F811
    for rows, kind, why in (([("a", -1, 0, 0, 9.0), ("a", 0, 0, 0, 1.0)], "u1", "negative"), ([("a", 0, 0, 0, 300.0)], "u1", "doesn't fit"), ([("a", 0, 0, 0, -1.0)], "u2", "doesn't fit"), ([("a", 0, 0, 0, 0.5)], "i4", "doesn't fit")):
        df = spark.createDataFrame(rows, FIELDS)
        with pytest.raises(Exception, match=why):
            grids.saved(grids.pieces(df, "klb", kind), str(tmp_path / "x"))
        with pytest.raises(Exception, match=why):
            binaries.images_encoded(df, kind).collect()
    (tmp_path / "odd.txt").write_text("no image")
    with pytest.raises(Exception, match="no format"):
        grids.images(spark, f"{tmp_path}/odd.txt").count()


def test_vectors(spark, tmp_path):  # noqa: F811
    rows = [("f", x, y, 0, x + 0.5, -y, 2.0) for x in range(3) for y in range(4)]
    df = spark.createDataFrame([tuple(map(float, r[4:])) + r[:4] for r in rows], "dx double, dy double, dz double, image string, x long, y long, z long")
    grids.saved(grids.pieces(df, "inr", "f4", values=("dx", "dy", "dz")), str(tmp_path))
    got = sorted((r.x, r.y, r.z, r.dx, r.dy, r.dz) for r in grids.images(spark, str(tmp_path), vectors=True).collect())
    assert got == sorted(r[1:] for r in rows)
