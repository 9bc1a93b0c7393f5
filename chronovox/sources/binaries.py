"""Binary files: lineage forests, Gabriel graphs, images. Codecs run on executors, one file or image at a time; trees,
images and, of graphs, ranges of pairs are the unit, so that no file needs rows of another. `saved` writes encoded files
from executors."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronovox.operators.lineage import to_root


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, content."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def saved(encoded: DataFrame, folder: str) -> None:
    """Writes each row (name, content) as folder/name; folder is a path or URI that executors share. A file appears by a
    rename once it is whole, so a task that runs twice does no harm."""

    def put(rows) -> None:
        import uuid

        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(at, recursive=True)
        for r in rows:
            part = f"{at}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(bytes(r["content"]))
            system.move(part, f"{at}/{r['name']}")

    encoded.select("name", "content").foreachPartition(put)


# Lineage forests: three counts, then ids in preorder (-1 after a leaf, -2 after a branching), first frames, positions.

def _preorder(rows: pd.DataFrame) -> pd.DataFrame:
    children: dict[int, list[int]] = {}
    at = {}
    first = None
    for r in rows.sort_values("id").itertuples():
        at[r.id] = (r.x, r.y, r.z)
        if pd.isna(r.mother):
            first = r
        else:
            children.setdefault(int(r.mother), []).append(r.id)
    order, places, pending = [], [], [first.id]
    while pending:
        own = pending.pop()
        below = children.get(own, [])
        if len(below) > 2:
            raise ValueError(f"the format holds binary trees only; node {own} has {len(below)} children")
        order += [own] + ([-1] if not below else [-2] if len(below) == 2 else [])
        places += at[own]
        pending += below
    return pd.DataFrame({"root": [first.id], "t": [int(first.t)], "ids": [order], "at": [places], "alone": [len(rows) == 1]})


def lineage_encoded(nodes: DataFrame, edges: DataFrame, parts: int = 1) -> DataFrame:
    """name, content: the forest of nodes (id, t, x, y, z) and edges (src, dst) in `parts` files, whole trees in each; trees
    of one node come last. A tree is encoded in one task."""
    roots = to_root(edges).select("id", "root")
    full = nodes.join(roots, "id", "left").join(edges.select(F.col("dst").alias("id"), F.col("src").alias("mother")), "id", "left")
    full = full.select("id", "t", "x", "y", "z", F.col("mother").cast("long").alias("mother"), F.coalesce("root", "id").alias("root"))
    trees = full.groupBy("root").applyInPandas(_preorder, "root long, t int, ids array<long>, at array<double>, alone boolean")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["alone", "root"])
        ids = np.concatenate([np.array([-1], dtype="<i8"), *[np.asarray(x, dtype="<i8") for x in rows["ids"]]])
        at = np.concatenate([np.asarray(x, dtype="<f8") for x in rows["at"]])
        out = struct.pack("<3q", len(ids), len(rows), len(at)) + ids.tobytes() + rows["t"].to_numpy("<u2").tobytes() + at.tobytes()
        return pd.DataFrame({"name": [f"forest-{rows['part'].iloc[0]:05d}.bin"], "content": [out]})

    return trees.withColumn("part", F.pmod(F.xxhash64("root"), F.lit(parts)).cast("int")).groupBy("part").applyInPandas(join, "name string, content binary")


def _forest(content: bytes) -> pd.DataFrame:
    n, m, k = struct.unpack_from("<3q", content)
    ids = np.frombuffer(content, "<i8", n, 24)
    starts = iter(np.frombuffer(content, "<u2", m, 24 + 8 * n).tolist())
    at = np.frombuffer(content, "<f8", k, 24 + 8 * n + 2 * m).reshape(-1, 3)
    own = ids[ids >= 0]
    mothers, times, frame = [], [], {}
    branchings, mother = [], None
    for token in ids.tolist():
        if token == -1:
            mother = branchings.pop() if branchings else None
        elif token == -2:
            branchings.append(mother)
        else:
            frame[token] = next(starts) if mother is None else frame[mother] + 1
            mothers.append(mother)
            times.append(frame[token])
            mother = token
    return pd.DataFrame({"id": own, "t": times, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "mother": pd.array(mothers, dtype="Int64")})


def _each(decode: Callable[[bytes], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches):
        for b in batches:
            for name, content in zip(b["file"], b["content"], strict=True):
                out = decode(content)
                out.insert(0, "file", name)
                yield out

    return run


def lineages(spark: SparkSession, path: str) -> DataFrame:
    """file, id, t, x, y, z, mother (null at a root): each file is read in one task, as its order carries the links."""
    return files(spark, path).mapInPandas(_each(_forest), "file string, id long, t long, x double, y double, z double, mother long")


# Gabriel graphs: two counts, pairs (t, how many numbers), then -(id + 1) of a source followed by id + 1 of its neighbours.

#: Pairs of a Gabriel file, about: a larger frame goes to several files.
PAIRS = 1 << 18


def gabriel_encoded(edges: DataFrame, most: int = PAIRS) -> DataFrame:
    """name, content: files of undirected edges (t, a, b). A file holds one frame, or a range of its pairs (source, neighbour)
    if there are more than `most`: pairs stream from a sort by ranges, so no task holds a frame. The neighbours of a source
    that ends a file may go on in the next one."""
    own, other = F.col("a").cast("long"), F.col("b").cast("long")
    both = F.inline(F.array(F.struct(own.alias("a"), other.alias("b")), F.struct(other.alias("a"), own.alias("b"))))
    pairs = edges.select(F.col("t").cast("long").alias("t"), both).repartitionByRange("t", "a", "b").sortWithinPartitions("t", "a", "b")

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t, a, b = np.concatenate(held, axis=1)
        for k in np.split(np.arange(len(t)), np.flatnonzero(np.diff(t)) + 1):
            first = np.flatnonzero(np.r_[True, np.diff(a[k]) != 0])
            n = np.insert(b[k] + 1, first, -(a[k][first] + 1)).astype("<i8")
            name = f"gabriel-{t[k[0]]:05d}-{a[k[0]]}-{b[k[0]]}.bin"
            content = struct.pack("<4q", 2, len(n), t[k[0]], len(n)) + n.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content])], ["name", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            before = np.c_[rows[:, :1] - 1 if last is None else last, rows[:, :-1]]
            last = rows[:, -1:].copy()
            held.append(rows[:, (rows != before).any(axis=0)])
            size += held[-1].shape[1]
            if size >= most:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    return pairs.mapInArrow(run, "name string, content binary")


def _graph(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The frames (t, end of its numbers) and the numbers of a file."""
    m, n = struct.unpack_from("<2q", content)
    frames = np.frombuffer(content, "<i8", m, 16).reshape(-1, 2)
    return np.c_[frames[:, 0], np.cumsum(frames[:, 1])], np.frombuffer(content, "<i8", n, 16 + 8 * m)


def gabriel_graphs(spark: SparkSession, path: str) -> DataFrame:
    """file, t, a, b in both directions. A file is decoded by pieces, as one can hold all frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                frames, numbers = _graph(memoryview(content.as_buffer()))
                source = 0
                for k in range(0, len(numbers), 1 << 16):
                    piece = numbers[k : k + (1 << 16)]
                    own = np.r_[source, piece]
                    place = np.maximum.accumulate(np.where(own < 0, np.arange(len(own)), 0))
                    source, goal = own[place[-1]], np.flatnonzero(piece > 0)
                    t = frames[np.searchsorted(frames[:, 1], goal + k, side="right"), 0]
                    columns = [pa.repeat(name, len(goal)), pa.array(t), pa.array(-own[place[1:]][goal] - 1), pa.array(piece[goal] - 1)]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "t", "a", "b"])

    return files(spark, path).mapInArrow(run, "file string, t long, a long, b long")


# Images. A decoder gives an array of axes x, y, z and the voxel size; formats tell themselves by their first bytes.

def _pairs(head: str) -> dict[str, str]:
    return {k.strip().upper(): v.strip() for k, _, v in (line.partition("=") for line in head.splitlines()) if v}


def _inr(content: bytes):
    end = content.index(b"##}")
    head = _pairs(content[:end].decode("latin-1"))
    bits = int(head.get("PIXSIZE", "8").split()[0])
    kind = "f" if "float" in head.get("TYPE", "") else "u" if "unsigned" in head.get("TYPE", "") else "i"
    order = ">" if head.get("CPU", "decm") in ("sun", "sgi") else "<"
    dims = [int(head.get(k, 1)) for k in ("VDIM", "XDIM", "YDIM", "ZDIM")]
    start = -(-(end + 3) // 256) * 256
    v = np.frombuffer(content, f"{order}{kind}{bits // 8}", int(np.prod(dims)), start).reshape(dims, order="F")
    return v[0], tuple(float(head.get(k, 1)) for k in ("VX", "VY", "VZ"))


def _npy(content: bytes):
    v = np.load(io.BytesIO(content), allow_pickle=False)
    return v.reshape(v.shape + (1,) * (3 - v.ndim)), (1.0, 1.0, 1.0)


def _pnm(content: bytes):
    """Binary grey maps (P5)."""
    words, at = [], 2
    while len(words) < 3:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        stop = at
        while not content[stop : stop + 1].isspace():
            stop += 1
        words.append(int(content[at:stop]))
        at = stop
    x, y, most = words
    v = np.frombuffer(content, ">u2" if most > 255 else "u1", x * y, at + 1).reshape(y, x)
    return v.T[:, :, None], (1.0, 1.0, 1.0)


#: Codes of NIfTI-1 and Analyze data types.
_NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def _nifti(content: bytes):
    o = "<" if struct.unpack_from("<i", content)[0] == 348 else ">"
    dims = struct.unpack_from(f"{o}8h", content, 40)
    shape = [max(1, d) for d in dims[1:4]]
    kind = _NIFTI[struct.unpack_from(f"{o}h", content, 70)[0]]
    start = int(struct.unpack_from(f"{o}f", content, 108)[0])
    v = np.frombuffer(content, f"{o}{kind}", int(np.prod(shape)), start).reshape(shape, order="F")
    return v, tuple(float(x) for x in struct.unpack_from(f"{o}3f", content, 80))


#: Names of MetaImage data types.
_META = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}


def _meta(content: bytes):
    """MetaImage with its data in the same file."""
    mark = b"ElementDataFile"
    start = content.index(b"\n", content.index(mark)) + 1
    head = _pairs(content[:start].decode("latin-1"))
    if head["ELEMENTDATAFILE"] != "LOCAL":
        raise ValueError("data in another file")
    dims = [int(x) for x in head["DIMSIZE"].split()]
    dims += [1] * (3 - len(dims))
    order = ">" if head.get("BINARYDATABYTEORDERMSB", head.get("ELEMENTBYTEORDERMSB", "False")) == "True" else "<"
    v = np.frombuffer(content, order + _META[head["ELEMENTTYPE"]], int(np.prod(dims)), start).reshape(dims, order="F")
    size = [float(x) for x in head.get("ELEMENTSPACING", "1 1 1").split()]
    return v, tuple((size + [1.0, 1.0])[:3])


def _tiff(content: bytes):
    """Grey TIFF in strips, plain or deflated, one page a slice."""
    import zlib

    o = "<" if content[:2] == b"II" else ">"
    #: Sizes and letters of TIFF field types.
    letters = {1: "B", 3: "H", 4: "I", 5: "II", 16: "Q"}
    at, slices, size = struct.unpack_from(f"{o}I", content, 4)[0], [], (1.0, 1.0)
    while at:
        (n,) = struct.unpack_from(f"{o}H", content, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{o}HHI", content, at + 2 + 12 * k)
            if kind in letters:
                form = f"{o}{letters[kind] * count}"
                where = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    (where,) = struct.unpack_from(f"{o}I", content, where)
                tags[tag] = struct.unpack_from(form, content, where)
        pack = tags.get(259, (1,))[0]
        if pack not in (1, 8, 32946) or tags.get(277, (1,))[0] != 1:
            raise ValueError(f"TIFF compression {pack} or several samples a pixel")
        raw = b"".join(zlib.decompress(s) if pack != 1 else s for s in (content[a : a + c] for a, c in zip(tags[273], tags[279], strict=True)))
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
        x, y = tags[256][0], tags[257][0]
        slices.append(np.frombuffer(raw, f"{o}{kind}{tags.get(258, (8,))[0] // 8}", x * y).reshape(y, x).T)
        per = lambda k: tags[k][1] / tags[k][0] if k in tags and tags[k][0] else 1.0
        size = per(282), per(283)
        (at,) = struct.unpack_from(f"{o}I", content, at + 2 + 12 * n)
    return np.stack(slices, axis=2), (*size, 1.0)


FORMATS: list[tuple[Callable[[bytes], bool], Callable]] = [
    (lambda c: c[:12] == b"#INRIMAGE-4#", _inr),
    (lambda c: c[:6] == b"\x93NUMPY", _npy),
    (lambda c: c[344:347] == b"n+1", _nifti),
    (lambda c: c[:4] in (b"II*\0", b"MM\0*"), _tiff),
    (lambda c: c[:2] == b"P5", _pnm),
    (lambda c: b"ElementDataFile" in c[:4096], _meta),
]


def images(spark: SparkSession, path: str, formats: list | None = None, zeros: bool = False) -> DataFrame:
    """file, x, y, z, v, vx, vy, vz: the voxels of images (those of value 0 only if `zeros`) and their size; a format is
    told by its first bytes, gzip is undone. A file of no known format raises. Slices are yielded one by one."""
    known = formats or FORMATS

    def run(batches):
        import gzip

        for b in batches:
            for name, content in zip(b["file"], b["content"], strict=True):
                content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                decode = next((d for fits, d in known if fits(content)), None)
                if decode is None:
                    raise ValueError(f"{name}: no known image format")
                v, size = decode(content)
                for z in range(v.shape[2]):
                    x, y = np.nonzero(np.ones(v.shape[:2], dtype=bool) if zeros else v[:, :, z])
                    yield pd.DataFrame({"file": name, "x": x, "y": y, "z": z, "v": v[x, y, z].astype(float), **dict(zip(("vx", "vy", "vz"), size, strict=True))})

    return files(spark, path).mapInPandas(run, "file string, x long, y long, z long, v double, vx double, vy double, vz double")


def stack(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, v of a folder of two-dimensional images; z is the rank of a file's name."""
    from pyspark.sql import Window

    rank = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    rank = rank.withColumn("z", (F.row_number().over(Window.orderBy("file")) - 1).cast("long"))
    return images(spark, path).drop("z").join(F.broadcast(rank), "file").select("x", "y", "z", "v")


def _tiff_encoded(v: np.ndarray) -> bytes:
    """One page a slice, one plain strip a page."""
    bits, sample = 8 * v.itemsize, {"u": 1, "i": 2, "f": 3}[v.dtype.kind]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for z in range(v.shape[2]):
        raw, at = v[:, :, z].tobytes(order="F"), len(out)
        out += raw + b"\0" * (len(raw) % 2)
        struct.pack_into("<I", out, link, len(out))
        # Tags of width, height, bits, compression, photometry, strip, samples, rows and bytes of a strip, sample kind.
        tags = [(256, v.shape[0]), (257, v.shape[1]), (258, bits), (259, 1), (262, 1), (273, at), (277, 1), (278, v.shape[1]), (279, len(raw)), (339, sample)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", k, 4, 1, x) for k, x in tags)
        link = len(out)
        out += b"\0\0\0\0"
    if len(out) >= 1 << 32:
        raise ValueError("the format holds less than 4 GiB")
    return bytes(out)


def meta_head(dims, kind: str, size: tuple[float, float, float]) -> bytes:
    name = next(n for n, k in _META.items() if k == kind)
    lines = ["ObjectType = Image", "NDims = 3", "DimSize = " + " ".join(map(str, dims)), "BinaryDataByteOrderMSB = False",
             "ElementSpacing = " + " ".join(map(str, size)), f"ElementType = {name}", "ElementDataFile = LOCAL\n"]
    return "\n".join(lines).encode()


def nifti_head(dims, kind: str, size: tuple[float, float, float]) -> bytes:
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *dims, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, next(n for n, k in _NIFTI.items() if k == kind), 8 * np.dtype(kind).itemsize)
    struct.pack_into("<4f", head, 76, 1, *size)
    struct.pack_into("<2f", head, 108, 352, 1)
    head[344:348] = b"n+1\0"
    return bytes(head)


def inr_head(dims, kind: str, size: tuple[float, float, float], channels: int = 1) -> bytes:
    """As many bytes as make a multiple of 256."""
    what = "float" if kind[0] == "f" else ("unsigned fixed" if kind[0] == "u" else "signed fixed")
    lines = ["#INRIMAGE-4#{", *[f"{k}DIM={n}" for k, n in zip("XYZ", dims, strict=True)], f"VDIM={channels}", f"TYPE={what}", f"PIXSIZE={8 * np.dtype(kind).itemsize} bits", "SCALE=2**0", "CPU=decm",
             *[f"V{k}={s}" for k, s in zip("XYZ", size, strict=True)]]
    head = "\n".join(lines) + "\n"
    return (head + "\n" * (-(len(head) + 4) % 256) + "##}\n").encode()


def images_encoded(voxels: DataFrame, kind: str = "u1") -> DataFrame:
    """name, content: one TIFF for each image of voxels (image, x, y, z, v); absent voxels are 0, the voxel size isn't kept.
    Negative places and values that the kind can't hold are errors. A file is put together in one task, as its pages link to
    each other; the forms that grids.pieces writes have no such limit."""
    from chronovox.sources.grids import _filled

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows[["x", "y", "z"]].to_numpy()
        if at.min() < 0:
            raise ValueError(f"image {rows['image'].iloc[0]} has negative places: shift it first")
        v = _filled(rows, (0, 0, 0), at.max(axis=0) + 1, kind, ["v"])[..., 0]
        return pd.DataFrame({"name": [f"{rows['image'].iloc[0]}.tif"], "content": [_tiff_encoded(v)]})

    return voxels.select("image", "x", "y", "z", "v").groupBy("image").applyInPandas(pack, "name string, content binary")
