"""Images in blocks: what a task reads or writes is a compressed block, or a run of rows of a plain file, never an image.

Reading is a data source, `grid`: its partitions are blocks, and comparisons of x, y and z with numbers are pushed down, so
that a region of interest opens its own blocks only. Formats: KLB, HDF5 (chunked or contiguous), INR, npy, NIfTI-1 and
MetaImage; a format is told by its first bytes, KLB by its name's ending, as its files have no mark of their own.

Writing makes pieces (name, piece, content): a header and one piece a block, put together by streaming them, in order, into a
file."""

from __future__ import annotations

import bz2
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from chronovox.operators.checkpoints import stored
from chronovox.sources import hierarchy

#: A partition reads about so many voxels, or one block.
VOXELS = 1 << 20
#: KLB's codes of data types and compressions, and its usual block.
KLB_KINDS = ("u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8", "f4", "f8")
KLB_PACKS = ("none", "bzip2", "zlib")
KLB_BLOCK = (96, 96, 8)
_KLB_HEAD = struct.Struct("<B5I5fBB256s5I")


@dataclass
class Block:
    """A box of voxels, x fastest unless `slow_x`, at a place of the file."""

    low: tuple[int, int, int]
    shape: tuple[int, int, int]
    at: int
    length: int


@dataclass
class Layout:
    """What a file's header says. `packs`: how blocks were packed, last step first; `slow_x`: z is the fastest axis."""

    dims: tuple[int, int, int]
    kind: str
    size: tuple[float, float, float]
    blocks: list[Block]
    packs: tuple[str, ...] = ()
    slow_x: bool = False
    channels: int = 1
    fill: float = 0.0

    def decoded(self, raw: bytes, b: Block) -> np.ndarray:
        """The values of a block, x by y by z, and channels if there are several."""
        for how in self.packs:
            raw = unpacked(how, raw, np.dtype(self.kind).itemsize)
        shape = b.shape if self.slow_x else b.shape[::-1]
        v = np.frombuffer(raw, self.kind, int(np.prod(shape)) * self.channels)
        v = v.reshape(*shape, self.channels) if self.channels > 1 else v.reshape(shape)
        return v if self.slow_x else v.swapaxes(0, 2)


def unpacked(how: str, raw: bytes, item: int) -> bytes:
    if how == "bzip2":
        return bz2.decompress(raw)
    if how == "zlib":
        return zlib.decompress(raw)
    if how == "shuffle":  # the first bytes of all items, then the second ones, and on
        n = len(raw) // item
        return np.frombuffer(raw, np.uint8, n * item).reshape(item, n).T.tobytes() + raw[n * item :]
    return raw


def _opened(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(at)


def _listed(path: str) -> list[str]:
    """The files of a folder, or the file itself."""
    from pyarrow import fs

    remote = "://" in path
    system, at = fs.FileSystem.from_uri(path) if remote else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and i.base_name[0] not in "._")
    return [f"{path.rstrip('/')}/{n}" for n in names]


def runs_of_rows(dims: tuple[int, int, int], item: int, at: int, slow_x: bool = False) -> list[Block]:
    """The blocks of a plain array: some slices, or some rows of a slice that is too large."""
    order = dims if slow_x else dims[::-1]  # slowest axis first
    slow, middle, fast = order
    turned = (lambda t: t) if slow_x else (lambda t: t[::-1])
    out = []
    if middle * fast <= VOXELS:
        some = max(1, VOXELS // max(1, middle * fast))
        for s in range(0, slow, some):
            n = min(some, slow - s)
            out.append(Block(turned((s, 0, 0)), turned((n, middle, fast)), at + s * middle * fast * item, n * middle * fast * item))
        return out
    some = max(1, VOXELS // fast)
    for s in range(slow):
        for m in range(0, middle, some):
            n = min(some, middle - m)
            out.append(Block(turned((s, m, 0)), turned((1, n, fast)), at + (s * middle + m) * fast * item, n * fast * item))
    return out


def klb_layout(f, name: str) -> Layout:
    """Block k ends at the k-th offset, counted from the header's end; x runs fastest among blocks, and edge blocks are
    as small as the image leaves them."""
    version, *rest = _KLB_HEAD.unpack(f.read(_KLB_HEAD.size))
    dims, size, (kind, pack), block = rest[:5], rest[5:10], rest[10:12], rest[13:18]
    if kind >= len(KLB_KINDS) or pack >= len(KLB_PACKS) or 0 in block:
        raise ValueError(f"{name}: no KLB file")
    if dims[3] != 1 or dims[4] != 1:
        raise ValueError(f"{name}: several channels or times in one file")
    counts = [-(-d // b) for d, b in zip(dims[:3], block[:3], strict=True)]
    n = int(np.prod(counts))
    ends = np.frombuffer(f.read(8 * n), "<u8").astype(np.int64)
    base, starts, blocks = _KLB_HEAD.size + 8 * n, np.r_[0, ends[:-1]], []
    for k in range(n):
        place = (k % counts[0], k // counts[0] % counts[1], k // (counts[0] * counts[1]))
        low = tuple(p * b for p, b in zip(place, block, strict=False))
        shape = tuple(min(b, d - a) for b, d, a in zip(block, dims, low, strict=False))
        blocks.append(Block(low, shape, base + int(starts[k]), int(ends[k] - starts[k])))
    return Layout(tuple(dims[:3]), f"<{KLB_KINDS[kind]}", tuple(size[:3]), blocks, (KLB_PACKS[pack],))


def _head(f, n: int = 1 << 16) -> bytes:
    f.seek(0)
    return f.read(n)


def _plain(dims, kind, size, at, slow_x=False, channels=1) -> Layout:
    dims = tuple(int(d) for d in dims)
    blocks = runs_of_rows(dims, np.dtype(kind).itemsize * channels, at, slow_x)
    return Layout(dims, kind, tuple(float(s) for s in size), blocks, (), slow_x, channels)


def _inr_layout(f, name: str) -> Layout:
    from chronovox.sources.binaries import _pairs

    raw = _head(f)
    end = raw.index(b"##}")
    head = _pairs(raw[:end].decode("latin-1"))
    bits = int(head.get("PIXSIZE", "8").split()[0])
    kind = "f" if "float" in head.get("TYPE", "") else "u" if "unsigned" in head.get("TYPE", "") else "i"
    order = ">" if head.get("CPU", "decm") in ("sun", "sgi") else "<"
    dims = [int(head.get(k, 1)) for k in ("XDIM", "YDIM", "ZDIM")]
    return _plain(dims, f"{order}{kind}{bits // 8}", [head.get(k, 1) for k in ("VX", "VY", "VZ")], -(-(end + 3) // 256) * 256, channels=int(head.get("VDIM", 1)))


def _npy_layout(f, name: str) -> Layout:
    f.seek(0)
    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if len(shape) > 3 or kind.hasobject:
        raise ValueError(f"{name}: up to three axes of numbers are read")
    return _plain((*shape, 1, 1)[:3], kind.str, (1, 1, 1), f.tell(), slow_x=not fortran)


def _nifti_layout(f, name: str) -> Layout:
    from chronovox.sources.binaries import _NIFTI

    raw = _head(f, 352)
    o = "<" if struct.unpack_from("<i", raw)[0] == 348 else ">"
    dims = [max(1, d) for d in struct.unpack_from(f"{o}8h", raw, 40)[1:4]]
    return _plain(dims, o + _NIFTI[struct.unpack_from(f"{o}h", raw, 70)[0]], struct.unpack_from(f"{o}3f", raw, 80), int(struct.unpack_from(f"{o}f", raw, 108)[0]))


def _meta_layout(f, name: str) -> Layout:
    from chronovox.sources.binaries import _META, _pairs

    raw = _head(f)
    at = raw.index(b"\n", raw.index(b"ElementDataFile")) + 1
    head = _pairs(raw[:at].decode("latin-1"))
    if head["ELEMENTDATAFILE"] != "LOCAL":
        raise ValueError(f"{name}: data in another file")
    dims = ([int(x) for x in head["DIMSIZE"].split()] + [1, 1])[:3]
    order = ">" if head.get("BINARYDATABYTEORDERMSB", head.get("ELEMENTBYTEORDERMSB", "False")) == "True" else "<"
    return _plain(dims, order + _META[head["ELEMENTTYPE"]], (head.get("ELEMENTSPACING", "1 1 1").split() + [1, 1])[:3], at)


def _hdf5_layout(f, name: str) -> Layout:
    """The data set Data, whose axes are z, y, x."""
    d = hierarchy.dataset(f, "Data")
    if len(d.shape) != 3:
        raise ValueError(f"{name}: three axes are read")
    turned = lambda t: tuple(t[::-1])
    if d.chunk is None:
        return _plain(turned(d.shape), d.kind, (1, 1, 1), d.at)
    blocks = [Block(turned(low), turned(d.chunk), at, length) for low, at, length in d.chunks]
    return Layout(turned(d.shape), d.kind, (1.0, 1.0, 1.0), blocks, d.packs)


FORMATS = [
    (lambda c, n: n.lower().endswith(".klb"), klb_layout),
    (lambda c, n: c[:8] == b"\x89HDF\r\n\x1a\n", _hdf5_layout),
    (lambda c, n: c[:12] == b"#INRIMAGE-4#", _inr_layout),
    (lambda c, n: c[:6] == b"\x93NUMPY", _npy_layout),
    (lambda c, n: c[344:347] == b"n+1", _nifti_layout),
    (lambda c, n: b"ElementDataFile" in c, _meta_layout),
]


def layout(path: str) -> Layout:
    with _opened(path) as f:
        head = _head(f, 4096)
        f.seek(0)
        read = next((r for fits, r in FORMATS if fits(head, path)), None)
        if read is None:
            raise ValueError(f"{path}: no format that is read in blocks")
        return read(f, path)


@dataclass
class Blocks(InputPartition):
    """Some blocks of a file."""

    file: str
    layout: Layout
    blocks: list[Block] = field(default_factory=list)

    def __init__(self, file: str, layout: Layout, blocks: list[Block]):
        self.file, self.layout, self.blocks = file, layout, blocks


class GridReader(DataSourceReader):
    def __init__(self, path: str, zeros: bool, vectors: bool, most: int):
        self.path, self.zeros, self.vectors, self.most = path, zeros, vectors, most
        self.low, self.high = dict.fromkeys("xyz", -np.inf), dict.fromkeys("xyz", np.inf)

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Bounds of x, y and z leave blocks out; Spark still applies every filter to the rows of the others."""
        for f in filters:
            axis = getattr(f, "attribute", ("",))[0]
            if axis in self.low:
                value = getattr(f, "value", None)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):  # of whole numbers
                    self.low[axis] = max(self.low[axis], value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[axis] = min(self.high[axis], value - isinstance(f, LessThan))
                if isinstance(f, In) and value:
                    self.low[axis], self.high[axis] = max(self.low[axis], min(value)), min(self.high[axis], max(value))
            yield f

    def _wanted(self, b: Block) -> bool:
        return all(a <= self.high[c] and a + n - 1 >= self.low[c] for c, a, n in zip("xyz", b.low, b.shape, strict=True))

    def partitions(self) -> list[Blocks]:
        """Of the files only headers are read here."""
        out = []
        for path in _listed(self.path):
            whole = layout(path)
            blocks, whole.blocks = [b for b in whole.blocks if self._wanted(b)], []
            if self.vectors and whole.channels < 3:
                raise ValueError(f"{path}: vectors have three channels")
            some, n = [], 0
            for b in blocks:
                size = int(np.prod(b.shape))
                if some and n + size > self.most:
                    out.append(Blocks(path, whole, some))
                    some, n = [], 0
                some.append(b)
                n += size
            if some:
                out.append(Blocks(path, whole, some))
        return out or [Blocks("", Layout((0, 0, 0), "u1", (1, 1, 1), []), [])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        whole = partition.layout
        with _opened(partition.file) as f:
            for b in partition.blocks:
                f.seek(b.at)
                v = whole.decoded(f.read(b.length), b)
                clip = tuple(slice(0, max(0, d - a)) for d, a in zip(whole.dims, b.low, strict=True))  # chunks can lie over the edge
                v = v[clip]
                first = v[..., 0] if whole.channels > 1 else v
                for k in range(v.shape[2]):
                    shown = np.ones(first.shape[:2], bool) if self.zeros or self.vectors else first[:, :, k] != 0
                    x, y = np.nonzero(shown)
                    values = [v[x, y, k, c].astype(np.float64) for c in range(3)] if self.vectors else [first[x, y, k].astype(np.float64)]
                    n = len(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([partition.file] * n, pa.string()), pa.array(x + b.low[0], pa.int64()), pa.array(y + b.low[1], pa.int64()), pa.array(np.full(n, k + b.low[2]), pa.int64()),
                         *[pa.array(a, pa.float64()) for a in values], *[pa.array(np.full(n, s), pa.float64()) for s in whole.size]],
                        ["file", "x", "y", "z", *(("dx", "dy", "dz") if self.vectors else ("v",)), "vx", "vy", "vz"])


class Grid(DataSource):
    """Options: path (a file or a folder), zeros (`true`: voxels of value 0 too), vectors (`true`: dx, dy, dz for v), voxels
    (how many a partition reads, or one block)."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def _set(self, name: str) -> bool:
        return self.options.get(name, "false").lower() == "true"

    def schema(self) -> str:
        return f"file string, x long, y long, z long, {'dx double, dy double, dz double' if self._set('vectors') else 'v double'}, vx double, vy double, vz double"

    def reader(self, schema) -> GridReader:
        return GridReader(self.options["path"], self._set("zeros"), self._set("vectors"), int(self.options.get("voxels", VOXELS)))


def images(spark: SparkSession, path: str, zeros: bool = False, vectors: bool = False, most: int = VOXELS) -> DataFrame:
    """file, x, y, z, v (or dx, dy, dz), vx, vy, vz: the voxels of a file or of a folder's files, those of value 0 only if
    `zeros`. A partition reads blocks of `most` voxels together, or one. Filters on x, y and z choose the blocks, for which the session's pushdown for Python sources is
    turned on."""
    spark.dataSource.register(Grid)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("grid").options(zeros=str(zeros).lower(), vectors=str(vectors).lower(), voxels=most).load(path)


def _packed(how: str, raw: bytes) -> bytes:
    return bz2.compress(raw) if how == "bzip2" else zlib.compress(raw) if how == "zlib" else raw


def _filled(rows: pd.DataFrame, low, shape, kind: str, names: list[str]) -> np.ndarray:
    """x by y by z by value: the rows' values at their places, 0 elsewhere; of two at one place the greater. Values that the
    kind can't hold are an error."""
    v = np.zeros((*shape, len(names)), f"<{kind}")
    rows = rows.sort_values(names)
    at = tuple(rows[c].to_numpy() - a for c, a in zip("xyz", low, strict=True))
    for k, name in enumerate(names):
        given = rows[name].to_numpy(np.float64)
        if kind[0] != "f":
            bounds = np.iinfo(v.dtype)
            if (given != np.floor(given)).any() or given.min(initial=0) < bounds.min or given.max(initial=0) > bounds.max:
                raise ValueError(f"a value doesn't fit {kind}: convert the image first")
        v[(*at, k)] = given
    return v


def _file_head(form: str, dims, kind: str, size, channels: int, block, pack: str, lengths: list[int]) -> bytes:
    """The bytes ahead of the blocks."""
    from chronovox.sources import binaries

    if form == "klb":
        return _KLB_HEAD.pack(2, *dims, 1, 1, *size, 1, 1, KLB_KINDS.index(kind), KLB_PACKS.index(pack), b"", *block, 1, 1) + np.cumsum(np.array(lengths, "<u8"), dtype="<u8").tobytes()
    if form == "h5":
        return hierarchy.head(tuple(dims[::-1]), tuple(block[::-1]), kind, lengths, pack == "zlib")
    if form == "npy":
        import io

        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": np.dtype(f"<{kind}").str, "fortran_order": True, "shape": tuple(dims)})
        return out.getvalue()
    return binaries.inr_head(dims, kind, size, channels) if form == "inr" else binaries.meta_head(dims, kind, size) if form == "mha" else binaries.nifti_head(dims, kind, size)


def pieces(voxels: DataFrame, form: str = "klb", kind: str = "u2", size: tuple[float, float, float] = (1.0, 1.0, 1.0), block: tuple[int, int, int] = KLB_BLOCK, pack: str = "zlib", values: tuple[str, ...] = ("v",)) -> DataFrame:
    """name, piece, content: for each image of voxels (image, x, y, z and value columns) a header, piece -1, and its blocks in
    the file's order. Forms: klb, h5, inr, npy, mha, nii; all but the first two have plain slices as blocks, and only inr
    several values a voxel. An image ends at its farthest voxel; absent voxels are 0. Negative places and values that the kind can't hold
    are errors: shift or convert the image first. A task holds a block."""
    if form not in ("klb", "h5", "inr", "npy", "mha", "nii") or (form == "h5" and pack == "bzip2") or (len(values) > 1 and form != "inr"):
        raise ValueError(f"{form} with {len(values)} values a voxel isn't written")
    names = list(values)
    rows = voxels.select(F.col("image").cast("string").alias("image"), *[F.col(c).cast("long").alias(c) for c in "xyz"], *names)
    low = F.least(*[F.min(c) for c in "xyz"])
    bounds = stored(rows.groupBy("image").agg(low.alias("low"), *[(F.max(c) + 1).alias(f"n{c}") for c in "xyz"]))
    if worst := bounds.where("low < 0").limit(1).collect():
        raise ValueError(f"image {worst[0]['image']} has negative places: shift it first")
    small = (lambda d: F.broadcast(d)) if bounds.count() <= 100_000 else (lambda d: d)
    packed = form in ("klb", "h5")
    width = [F.lit(b) if packed else F.col(f"n{c}") if c != "z" else F.lit(1) for b, c in zip(block, "xyz", strict=True)]
    counts = [F.ceil(F.col(f"n{c}") / w) for c, w in zip("xyz", width, strict=True)]
    number = sum((F.floor(F.col(c) / w) * (1 if k == 0 else counts[0] if k == 1 else counts[0] * counts[1]) for k, (c, w) in enumerate(zip("xyz", width, strict=True))), F.lit(0))
    placed = rows.join(small(bounds.drop("low")), "image").withColumn("piece", number.cast("long"))
    how = pack if packed else "none"

    def box(piece: int, dims) -> tuple[tuple, tuple]:
        b = block if packed else (*dims[:2], 1)
        n = [-(-d // w) for d, w in zip(dims, b, strict=True)]
        at = [p * w for p, w in zip((piece % n[0], piece // n[0] % n[1], piece // (n[0] * n[1])), b, strict=True)]
        return tuple(at), tuple(w if form == "h5" else min(w, d - a) for w, d, a in zip(b, dims, at, strict=True))

    def encode(g: pd.DataFrame) -> pd.DataFrame:
        first = g.iloc[0]
        at, shape = box(int(first["piece"]), [int(first[f"n{c}"]) for c in "xyz"])
        v = _filled(g, at, shape, kind, names)
        return pd.DataFrame({"image": [first["image"]], "piece": [first["piece"]], "content": [_packed(how, v.transpose(2, 1, 0, 3).tobytes())]})

    made = placed.groupBy("image", "piece").applyInPandas(encode, "image string, piece long, content binary")
    every = bounds.select("image", "nx", "ny", "nz", F.explode(F.sequence(F.lit(0), (counts[0] * counts[1] * counts[2] - 1).cast("long"))).alias("piece"))

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty: dict[tuple, bytes] = {}
        for g in batches:
            content = []
            for piece, own, *dims in zip(g["piece"], g["content"], g["nx"], g["ny"], g["nz"], strict=True):
                if own is None:
                    _, shape = box(piece, dims)
                    if shape not in empty:
                        empty[shape] = _packed(how, bytes(int(np.prod(shape)) * np.dtype(kind).itemsize * len(names)))
                    own = empty[shape]
                content.append(own)
            yield pd.DataFrame({"image": g["image"], "piece": g["piece"], "content": content})

    blocks = stored(every.join(made, ["image", "piece"], "left").select("image", "piece", "nx", "ny", "nz", "content").mapInPandas(filled, "image string, piece long, content binary"))
    ends = F.transform(F.array_sort(F.collect_list(F.struct("piece", F.octet_length("content").cast("long").alias("n")))), lambda s: s["n"])
    lengths = blocks.groupBy("image").agg(ends.alias("lengths")) if packed else bounds.select("image", F.array().cast("array<bigint>").alias("lengths"))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            content = [_file_head(form, [int(x) for x in d], kind, size, len(names), block, pack, [int(n) for n in e]) for e, *d in zip(g["lengths"], g["nx"], g["ny"], g["nz"], strict=True)]
            yield pd.DataFrame({"image": g["image"], "piece": -1, "content": content})

    head = lengths.join(bounds, "image").select("image", "nx", "ny", "nz", "lengths").mapInPandas(heads, "image string, piece long, content binary")
    return head.unionByName(blocks).select(F.concat("image", F.lit(f".{form}")).alias("name"), "piece", "content")


def saved(parts: DataFrame, folder: str) -> None:
    """Streams each name's pieces, in order, into folder/name; folder is a path or URI that executors share. A file appears
    by a rename once it is whole, so a task that runs twice does no harm."""

    def put(rows) -> None:
        import uuid

        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        system.create_dir(at, recursive=True)
        name, out, part = None, None, ""
        for r in rows:
            if r["name"] != name:
                if out is not None:
                    out.close()
                    system.move(part, f"{at}/{name}")
                name, part = r["name"], f"{at}/.{uuid.uuid4().hex}"
                out = system.open_output_stream(part)
            out.write(bytes(r["content"]))
        if out is not None:
            out.close()
            system.move(part, f"{at}/{name}")

    parts.repartition("name").sortWithinPartitions("name", "piece").select("name", "content").foreachPartition(put)
