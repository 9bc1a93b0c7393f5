"""Files written and read back, and files of fixed text."""

import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_catalog import spark  # noqa: F401

from chronovox.sources import binaries, exports, texts

NODES = [(0, 0, 1.0, 2.0, 3.0), (1, 1, 1.5, 2.5, 3.5), (2, 2, 1.0, 0.0, 0.0), (3, 2, 0.0, 1.0, 0.0), (4, 3, 0.0, 0.0, 1.0), (7, 5, 9.0, 9.0, 9.0)]
EDGES = [(0, 1), (1, 2), (1, 3), (3, 4)]


def forest(spark):  # noqa: F811
    return spark.createDataFrame(NODES, "id long, t long, x double, y double, z double"), spark.createDataFrame(EDGES, "src long, dst long")


def test_lineage_round_trip(spark, tmp_path):  # noqa: F811
    nodes, edges = forest(spark)
    binaries.saved(binaries.lineage_encoded(nodes, edges), str(tmp_path))
    content = next(tmp_path.glob("*.bin")).read_bytes()
    assert struct.unpack_from("<3q", content) == (11, 2, 18)
    assert list(struct.unpack_from("<11q", content, 24)) == [-1, 0, 1, -2, 3, 4, -1, 2, -1, 7, -1]
    got = binaries.lineages(spark, str(tmp_path)).collect()
    assert sorted((r.id, r.t, r.x, r.y, r.z) for r in got) == NODES
    assert sorted((r.mother, r.id) for r in got if r.mother is not None) == EDGES


def test_gabriel_round_trip(spark, tmp_path):  # noqa: F811
    rows = [(0, 0, 1), (0, 1, 2), (3, 5, 9)]
    binaries.saved(binaries.gabriel_encoded(spark.createDataFrame(rows, "t long, a long, b long")), str(tmp_path))
    got = {(r.t, r.a, r.b) for r in binaries.gabriel_graphs(spark, str(tmp_path)).collect()}
    assert got == {x for t, a, b in rows for x in ((t, a, b), (t, b, a))}


def test_gabriel_files_are_bounded(spark, tmp_path):  # noqa: F811
    edges = spark.range(60_000).selectExpr("id % 3 AS t", "IF(id % 2 = 0, 0, id) AS a", "id + 1 AS b")  # half of them at one node
    twice = edges.union(edges.selectExpr("t", "b", "a"))
    binaries.saved(binaries.gabriel_encoded(twice, most=10_000), str(tmp_path / "g"))
    found = list((tmp_path / "g").iterdir())
    assert len(found) >= 6 and max(f.stat().st_size for f in found) <= 8 * 2 * 20_000 + 32
    got = binaries.gabriel_graphs(spark, str(tmp_path / "g")).select("t", "a", "b")
    want = edges.union(edges.selectExpr("t", "b", "a"))
    assert got.count() == 120_000 and got.exceptAll(want).isEmpty()


def test_gabriel_file_of_several_frames(spark, tmp_path):  # noqa: F811
    numbers = [-1, *range(2, 70_002), -3, 5, -2, 1, 4]
    (tmp_path / "all.bin").write_bytes(struct.pack(f"<2q4q{len(numbers)}q", 4, len(numbers), 7, 70_003, 9, 3, *numbers))
    got = [tuple(r) for r in binaries.gabriel_graphs(spark, str(tmp_path / "all.bin")).select("t", "a", "b").collect()]
    assert got == [(7, 0, k) for k in range(1, 70_001)] + [(7, 2, 4), (9, 1, 0), (9, 1, 3)]


@pytest.mark.parametrize("kind", ["u1", "f4", "u2"])
def test_image_round_trip(spark, tmp_path, kind):  # noqa: F811
    rows = [("a", 0, 0, 0, 3.0), ("a", 4, 2, 1, 200.0), ("b", 1, 1, 0, 7.0)]
    v = spark.createDataFrame(rows, "image string, x long, y long, z long, v double")
    binaries.saved(binaries.images_encoded(v, kind), str(tmp_path))
    got = binaries.images(spark, str(tmp_path)).collect()
    assert sorted((r.file[-5], r.x, r.y, r.z, r.v) for r in got) == rows


def _tiff(v: np.ndarray, deflate: bool) -> bytes:
    out, entry = bytearray(b"II*\0\0\0\0\0"), 4
    for z in range(v.shape[2]):
        raw = v[:, :, z].T.astype("<u2").tobytes()
        raw = zlib.compress(raw) if deflate else raw
        at = len(out)
        out += raw + b"\0" * (len(raw) % 2)
        struct.pack_into("<I", out, entry, len(out))
        tags = [(256, v.shape[0]), (257, v.shape[1]), (258, 16), (259, 8 if deflate else 1), (273, at), (277, 1), (279, len(raw))]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, x) for t, x in tags)
        entry = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def test_other_formats():
    v = (np.arange(24).reshape(4, 3, 2) * 7).astype("u2")
    for deflate in (False, True):
        assert (binaries._tiff(_tiff(v, deflate))[0] == v).all()
    assert (binaries._pnm(b"P5\n# c\n4 3\n255\n" + v[:, :, 0].T.astype("u1").tobytes())[0][:, :, 0] == v[:, :, 0]).all()
    head = b"NDims = 3\nDimSize = 4 3 2\nElementType = MET_USHORT\nElementSpacing = 1 1 5\nElementDataFile = LOCAL\n"
    got, size = binaries._meta(head + v.tobytes(order="F"))
    assert (got == v).all() and size == (1.0, 1.0, 5.0)
    n = bytearray(352)
    struct.pack_into("<i", n, 0, 348)
    struct.pack_into("<8h", n, 40, 3, 4, 3, 2, 1, 1, 1, 1)
    struct.pack_into("<h", n, 70, 512)
    struct.pack_into("<4f", n, 76, 1, 1, 1, 2)
    struct.pack_into("<f", n, 108, 352)
    n[344:348] = b"n+1\0"
    got, size = binaries._nifti(bytes(n) + v.tobytes(order="F"))
    assert (got == v).all() and size == (1.0, 1.0, 2.0)
    assert (binaries._npy((lambda b: (np.save(b, v), b.getvalue())[1])(io.BytesIO()))[0] == v).all()


def test_texts(spark, tmp_path):  # noqa: F811
    write = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    got = texts.points(spark, write("p.txt", "# c\n1 2 3\n\n% c\n4.5 -1e1\n// c\nnone\n")).orderBy("i").collect()
    assert [(r.i, r.x, r.y, r.z) for r in got] == [(0, 1, 2, 3), (1, 4.5, -10, 0)]
    m = texts.matrices(spark, write("m.txt", "(\nO8\n1 0 0 5\n0 1 0 6\n0 0 1 7\n0 0 0 1\n)\n"), -1.0).collect()[0].m
    assert m == [-1, 0, 0, -5, 0, -1, 0, -6, 0, 0, -1, -7, 0, 0, 0, -1]
    c = texts.correspondences(spark, write("c.txt", "# c\n1 2 - 7\n3 - 8 9\n")).collect()
    assert sorted((r.l, r.r) for r in c) == [(1, 7), (2, 7), (3, 8), (3, 9)]
    p = texts.parameters(spark, write("q.csv", "name,value,comment\nlabels,1,x\n,2,\nsize,6.25,\n")).where("name <> 'name'").collect()
    assert sorted((r.name, r.k, r.value) for r in p) == [("labels", 0, "1"), ("labels", 1, "2"), ("size", 0, "6.25")]
    b = texts.positions(spark, write("b.csv", "x,y,z,t\n1,2,3,4\nbad,2,3,4\n"), (1, 1, 5)).collect()
    assert [tuple(r) for r in b] == [(1, 2, 15, 4)]
    n = texts.node_labels(spark, write("d.csv", "id, m, x, y, z, r, th, ph, t, label\n5, -1, 0, 0, 0, 0, 0, 0, 1, 3\n")).collect()
    assert [tuple(r) for r in n] == [(5, 3)]


def test_detections(spark, tmp_path):  # noqa: F811
    one = '<Cell id="{}" lineage="0" parent="{}" m="{}" svIdx="1 2 " alpha="5" alphaPrior="2" nu="2" W="1 2 3 4 5 6 7 8 9"></Cell>'
    (tmp_path / "frame0001.xml").write_text("<doc>" + one.format(0, -1, "1 2 3") + one.format(1, -1, "-1.#IND 0 0") + "</doc>")
    (tmp_path / "frame0002.xml").write_text("<doc>" + one.format(0, 0, "2 2 4") + one.format(1, 9, "0 0 1") + "</doc>")
    found = texts.detections(spark, str(tmp_path), "Cell", 5.0)
    assert found.where("invalid").count() == 1
    nodes, edges = texts.numbered(found)
    assert [tuple(r) for r in edges.collect()] == [(0, 1)]
    assert [tuple(r) for r in nodes.orderBy("id").collect()] == [(0, 1, 0, 1, 2, 15, True, False), (1, 2, 0, 2, 2, 20, False, False), (2, 2, 1, 0, 0, 5, True, True)]
    r = found.where("t = 2 AND cell = 0").collect()[0]
    assert r.intensity == 3 and r.coeffs == [2, 4, 6, 10, 12, 18, 2, 2, 20] and r.supervoxels == [1, 2]


def test_mamut_round_trip(spark, tmp_path):  # noqa: F811
    nodes, edges = forest(spark)
    lines = exports.mamut_lines(nodes.withColumn("label", F.lit(1)), edges)
    (tmp_path / "m.xml").write_text("\n".join(r.line for r in lines.orderBy("section", "a", "b").collect()))
    spots = texts.spots(spark, str(tmp_path / "m.xml"))
    assert sorted(tuple(r) for r in spots.collect()) == NODES
    assert sorted((r.src, r.dst) for r in texts.spot_edges(spark, str(tmp_path / "m.xml"), spots).collect()) == EDGES


def test_mamut_documents(spark, tmp_path):  # noqa: F811
    from xml.etree import ElementTree

    n = 300
    nodes = spark.range(n).selectExpr("id", "id % 8 AS t", "id * 0.5D AS x", "1.0D AS y", "2.0D AS z", "1 AS label")
    edges = nodes.where("t > 0").selectExpr("id - 1 AS src", "id AS dst")
    exports.to_mamut(nodes, edges, str(tmp_path / "m"), most=50)
    documents = list((tmp_path / "m").glob("document=*/*.txt"))
    assert len(documents) == 6 and all(ElementTree.fromstring(f.read_bytes()).tag == "TrackMate" for f in documents)
    spots = texts.spots(spark, str(tmp_path / "m"))
    assert sorted(tuple(r) for r in spots.collect()) == [(k, k % 8, k / 2, 1, 2) for k in range(n)]
    got = texts.spot_edges(spark, str(tmp_path / "m"), spots).collect()
    assert sorted((r.track, r.src, r.dst) for r in got) == [(k - k % 8, k - 1, k) for k in range(n) if k % 8]


def test_amira_tulip_csv(spark, tmp_path):  # noqa: F811
    nodes, edges = forest(spark)
    labelled = nodes.withColumn("label", F.lit(1))
    frames = {r.name: bytes(r.content).decode() for r in exports.amira(labelled, edges, 2).collect()}
    assert len(frames) == 5 and "define POINT 6" in frames["frame-00002.am"] and "1.50000 2.50000 3.50000\n1.00000 2.00000 3.00000" in frames["frame-00002.am"]
    assert exports.tulip_lines(nodes, edges).where("line LIKE '(node %' AND section = 1").count() == len(NODES)
    exports.to_csv(exports.database_expanded(labelled, edges), str(tmp_path / "db"))
    got = spark.read.option("header", True).csv(str(tmp_path / "db"))
    assert got.columns == list(exports.DATABASE + exports.EXPANDED) and got.count() == len(NODES)


def test_correspondences_written(spark, tmp_path):  # noqa: F811
    couples = [(1, 5, 7), (1, 4, 7), (2, 6, 8), (2, 6, 9), (2, 6, 9), (3, None, 1)]
    df = spark.createDataFrame(couples, "g long, l long, r long")
    assert {r.g: r.line for r in exports.correspondence_lines(df).collect()} == {1: "4 5 - 7", 2: "6 - 8 9"}
    exports.to_correspondences(df, str(tmp_path / "c"))
    assert sorted((r.l, r.r) for r in texts.correspondences(spark, str(tmp_path / "c")).collect()) == [(4, 7), (5, 7), (6, 8), (6, 9)]
    with pytest.raises(Exception, match="all pairs"):
        exports.correspondence_lines(spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "g long, l long, r long")).collect()
