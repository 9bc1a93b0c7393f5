"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components.

Fingerprints are compared without meeting all pairs: 64 bits are cut into five blocks, and two fingerprints within
three bits agree in two blocks at least, so each distinct fingerprint goes to ten buckets (two blocks each, about 25
bits). More fingerprints are cut into more blocks, of which more must agree: buckets' keys grow with the data (six
blocks: 20 buckets of 32 bits; seven: 35 of 36; eight: 56 of 40), and no cut misses a pair. In a bucket, the fingerprints' bits stand in vertical planes, 64 fingerprints to a word; a fingerprint meets 64
others at a time by carry-save counters over the planes, and leaves a word as soon as all in it exceed the radius.

Equal fingerprints are one row beforehand. A bucket of more than `block` rows is cut into blocks that meet in pairs, so
no task holds a large bucket; each piece returns a spanning forest of its links, never all of them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.llm.common import SMALL, joined_by_key, partitions, stored
from chronovox.operators.graphs import components

RADIUS = 3
BLOCK = 2048
#: The number of blocks of bits, for up to so many distinct fingerprints.
BLOCKS = ((5, 1 << 24), (6, 1 << 30), (7, 1 << 34), (8, None))


def cuts(blocks: int) -> list[tuple[int, int]]:
    """Offset and width of each block of the 64 bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def fingerprint(text: str | None) -> int:
    """A-Z in lower case, words, 3-word shingles with repeats; a bit is set if set in over half of the XXH64 values."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: both know ASCII only
    if not w:
        return 0
    shingles = map(b" ".join, zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else iter([b" ".join(w)])
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype="<u8", count=max(1, len(w) - 2))
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (bigint) of every row of docs. A null or empty text, or one without words, has fingerprint 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(x.as_py()) for x in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Joins the classes of `label` (each its least member) by the links a-b."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter
    return label


def linked(fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the least row of its class, linked by rows of the same bucket within the radius. bucket: sorted."""
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return label
    bits = np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = -(-n // 64)
    padded = np.zeros((64, words * 64), dtype=np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")  # bit k of the word w: row 64 w + k
    queries = np.negative(bits.T.astype(np.int8)).astype(np.int64).view(np.uint64)  # all ones where the bit is set
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    end = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    row, full = np.arange(n), np.uint64(0xFFFFFFFFFFFFFFFF)
    rows, word = row, (row + 1) // 64
    while True:
        inside = word * 64 < end[rows]
        rows, word = rows[inside], word[inside]
        if not len(rows):
            return label
        first = np.maximum(rows + 1 - word * 64, 0).astype(np.uint64)
        last = np.minimum(end[rows] - word * 64, 64).astype(np.uint64)
        valid = (full << first) & (full >> (np.uint64(64) - last))
        live, at, ok = rows, word, valid
        ones = np.zeros(len(live), dtype=np.uint64)
        twos, over = ones.copy(), ones.copy()
        for k in range(64):
            d = planes[k][at] ^ queries[k][live]
            carry = ones & d
            ones ^= d
            over |= twos & carry if radius == 3 else 0
            twos ^= carry
            if k % 8 == 7:  # blocks in which every distance exceeds the radius are given up
                stay = (~over & ok) != 0
                if not stay.all():
                    live, at, ok, ones, twos, over = live[stay], at[stay], ok[stay], ones[stay], twos[stay], over[stay]
                    if not len(live):
                        break
        if len(live):
            hits = ~over & ok
            grid = np.unpackbits(hits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, offset = np.nonzero(grid)
            label = _roots(n, live[which], at[which] * 64 + offset, label)
        word = word + 1


def links(distinct: DataFrame, block: int = BLOCK, blocks: int | None = None) -> DataFrame:
    """a, b (bigint): for fingerprints in `fp`, distinct, links that connect all within three bits; b is the root of
    its piece, not always a neighbour of a. `blocks` follows from their number if it isn't given."""
    if blocks is None:
        n = distinct.count()
        blocks = next(k for k, most in BLOCKS if most is None or n <= most)
    keys = []
    for t, agree in enumerate(combinations(cuts(blocks), blocks - RADIUS)):
        key = f"{t}L"
        for at, width in agree:
            key = f"({key} * {1 << width}L + (shiftrightunsigned(fp, {at}) & {(1 << width) - 1}L))"
        keys.append(key)
    spread = distinct.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))
    sizes = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pieces = F.expr(f"CAST(ceil(n / {block}) AS INT)")
    mine = F.pmod(F.xxhash64("fp", F.lit(9)), F.col("pieces")).cast("int")
    met = (
        spread.join(sizes, "key")
        .withColumn("pieces", pieces)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.expr("IF(pieces = 1, array(0), sequence(0, pieces - 1))")))
        .select(
            "fp", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"))
    )
    n = partitions(distinct.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fp, held_bucket = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def compared(fp: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
            root = linked(fp, bucket)
            some = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array(fp[root[some]])], ["a", "b"])

        for b in batches:
            fp = np.r_[held_fp, b.column(0).to_numpy(zero_copy_only=False)]
            bucket = np.r_[held_bucket, b.column(1).to_numpy(zero_copy_only=False)]
            if not len(bucket):
                continue
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield compared(fp[:cut], bucket[:cut])
            held_fp, held_bucket = fp[cut:], bucket[cut:]
        if len(held_fp):
            yield compared(held_fp, held_bucket)

    return met.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that links of three bits or fewer reach.

    Null and empty texts have fingerprint zero and link like any other. A row with a null id belongs to a component but
    is never its least id, unless all its ids are null. Repeated rows come out repeated. Other columns are left out."""
    found = stored(fingerprints(docs, id_col, text_col))
    distinct = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    root = components(links(distinct.select("fp"), block), SMALL)
    classes = distinct.join(root, distinct.fp == root.node, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    classes = stored(classes)
    lowest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(classes.join(lowest, "root").select("fp", "component_id", "rows"))
    return joined_by_key(found, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Wide codes: SimHash of WIDE bits, for radii that 64 bits can't tell from chance. No cut of the bits into blocks serves a
# wide radius, so a bucket is a choice of bits that agree, one of many ("tables"), as many as the radius asks for.

WIDE = 512
#: The bits that are compared in a bucket, the first of a code; all of them go into the choice of buckets.
COMPARED = 192
#: Pairs just as alike as asked are missed with this probability at most; more alike ones with less.
MISSED = 6e-8
#: Rows that meet at once, about: groups of four times as many are cut into pieces that meet in pairs. Few, so that batches
#: of rows on their way to Python stay small.
MET = 1 << 11
_WORDS = WIDE // 64
_RNG = np.random.Generator(np.random.PCG64(23))
_SALTS = _RNG.integers(0, 1 << 63, (2, _WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ITEM = np.dtype([("key", "<u2"), ("code", "<u8", COMPARED // 64)])


def code(hashes: np.ndarray) -> bytes:
    """The WIDE bits of a set of 64-bit hashes, which is not empty: a bit is set if set in over half of the mixed hashes.
    Bits are counted in bytes, eight to a word, up to 255 hashes at a time."""
    counts = np.zeros(WIDE, dtype=np.int64)
    for k in range(0, len(hashes), 255):
        h = hashes[k : k + 255, None] * _SALTS[0]
        h ^= h >> np.uint64(32)
        h *= _SALTS[1]
        h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").view("<u8")
        counts += bits.sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def apart(jaccard: float) -> float:
    """The share of bits in which the codes of two sets of this similarity differ: the angle of their vectors by pi."""
    return math.acos(2 * jaccard / (1 + jaccard)) / math.pi


def _differing(bits: int, share: float) -> np.ndarray:
    """The probability of each number of differing bits."""
    return np.array([math.comb(bits, d) * share**d * (1 - share) ** (bits - d) for d in range(bits + 1)])


def radius(bits: int, share: float) -> int:
    """The number of differing bits that is exceeded with the probability MISSED / 4 at most."""
    beyond = np.cumsum(_differing(bits, share)[::-1])[::-1]
    return int(np.flatnonzero(beyond > MISSED / 4)[-1])


def tables(bits: int, share: float) -> int:
    """How many choices of so many bits of WIDE miss a pair with the probability MISSED / 2 at most."""
    some = _differing(WIDE, share)
    agree = np.array([math.comb(WIDE - d, bits) / math.comb(WIDE, bits) for d in range(WIDE + 1)])
    n = 1
    while (some * (1 - agree) ** n).sum() > MISSED / 2:
        n += 1
    return n


def linked_wide(codes: np.ndarray, bucket: np.ndarray, most: int, first: int) -> np.ndarray:
    """For each row of codes (words of 64 bits) a row of its class, linked by rows of the same bucket that differ in `most`
    bits or fewer, of the first 64 in `first` or fewer. bucket: sorted. The first 64 bits stand in vertical planes as in
    linked(), counted by carry-save adders for 64 rows at a time; all bits are counted for the pairs that they leave.

    In large buckets, the rows near to a row go first and aren't compared with each other: they are one class."""
    n = len(codes)
    label, order, begin = np.arange(n), np.arange(n), np.arange(1, n + 1)
    if n < 2:
        return label
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[starts[1:], n]
    for at, end in zip(starts[ends - starts > 256].tolist(), ends[ends - starts > 256].tolist(), strict=True):
        for _ in range(64):
            if end - at <= 256:
                break
            own = order[at:end]
            differ = np.bitwise_count(codes[own] ^ codes[own[0]])
            near = (differ.sum(axis=1) <= most) & (differ[:, 0] <= first)
            count = int(near.sum())
            order[at:end] = np.r_[own[near], own[~near]]
            begin[at : at + count], label[at : at + count] = at + count, at
            at += count
    codes, end = codes[order], np.repeat(ends, ends - starts)
    bits = np.unpackbits(np.ascontiguousarray(codes[:, 0]).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    words = -(-n // 64)
    padded = np.zeros((64, words * 64), dtype=np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")  # bit k of the word w: row 64 w + k
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    rows, word = np.arange(n), begin // 64
    found_a, found_b = [], []
    while True:
        inside = word * 64 < end[rows]
        rows, word = rows[inside], word[inside]
        if not len(rows):
            break
        for k in range(0, len(rows), 1 << 11):  # pieces that stay in the cache
            own, at = rows[k : k + (1 << 11)], word[k : k + (1 << 11)]
            valid = full << np.maximum(begin[own] - at * 64, 0).astype(np.uint64)
            valid &= full >> (64 - np.minimum(end[own] - at * 64, 64)).astype(np.uint64)
            asked = np.negative(bits[own].T.astype(np.int64)).view(np.uint64)  # all ones where the bit is set
            left = ~_exceeding(planes[:, at] ^ asked, first) & valid
            some = np.flatnonzero(left)
            which, offset = np.nonzero(np.unpackbits(left[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = own[some[which]], at[some[which]] * 64 + offset
            near = sum(np.bitwise_count(codes[a, w] ^ codes[b, w]).astype(np.int64) for w in range(codes.shape[1])) <= most
            found_a.append(a[near])
            found_b.append(b[near])
        word = word + 1
    if found_a:
        label = _roots(n, np.concatenate(found_a), np.concatenate(found_b), label)
    root = np.empty(n, dtype=np.int64)
    root[order] = order[label]
    return root


def _exceeding(planes: np.ndarray, most: int) -> np.ndarray:
    """Words whose bit is set where more than `most` of the planes have it: sums of three planes a time become one plane of
    that weight and one of twice the weight, until each weight has one."""
    digits, level = [], list(planes)
    while level:
        carries = []
        while len(level) > 2:
            a, b, c = level.pop(), level.pop(), level.pop()
            u = a ^ b
            carries.append((a & b) | (u & c))
            level.append(u ^ c)
        if len(level) == 2:
            a, b = level
            carries.append(a & b)
            level = [a ^ b]
        digits.append(level[0])
        level = carries
    over, same = np.zeros_like(digits[0]), np.full_like(digits[0], 0xFFFFFFFFFFFFFFFF)
    for k in reversed(range(max(len(digits), most.bit_length()))):
        digit = digits[k] if k < len(digits) else np.zeros_like(over)
        if most >> k & 1:
            same &= digit
        else:
            over |= same & digit
            same &= ~digit
    return over


def wide_links(codes: DataFrame, share: float, met: int = MET) -> DataFrame:
    """a, b (bigint): links of the codes in `code` (of code(), distinct) that connect all pairs whose sets are as alike as
    `share`, the part of differing bits, says or more, but for those that MISSED allows, and some that are less alike. A code is named by its first 64 bits: codes equal in them
    are one name. Tables have more bits, and are more, where there are more codes."""
    spark = codes.sparkSession
    n = max(2, codes.count())
    bits = max(10, round(2 + math.log2(n) / 2))
    cut = min(bits, max(0, bits - 16, math.ceil(math.log2(n / met))))
    most, first, rng = radius(COMPARED, share), radius(64, share), np.random.Generator(np.random.PCG64(29))
    chosen = [np.sort(rng.choice(WIDE, bits, replace=False)) for _ in range(tables(bits, share))]

    def dealt(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            all_bits = np.unpackbits(own, axis=1, bitorder="little")
            items = np.zeros(b.num_rows, _ITEM)
            items["code"] = np.ascontiguousarray(own[:, : COMPARED // 8]).view("<u8")
            for t, some in enumerate(chosen):
                key = all_bits[:, some].astype(np.int64) @ (1 << np.arange(bits))
                order = np.argsort(key, kind="stable")
                route = key[order] >> (bits - cut)
                items["key"] = key & ((1 << (bits - cut)) - 1)
                ends = np.r_[np.flatnonzero(np.diff(route)) + 1, len(route)]
                counts = np.diff(np.r_[0, ends])
                columns = [pa.array((t << bits) + route[ends - 1]), pa.array(counts)]
                if whole:
                    offsets = pa.array(np.r_[0, ends].astype(np.int32) * _ITEM.itemsize).buffers()[1]
                    columns.append(pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(items[order].tobytes())]))
                yield pa.RecordBatch.from_arrays(columns, ["route", "n", "items"][: len(columns)])

    sizes = codes.select("code").mapInArrow(lambda b: dealt(b, False), "route bigint, n bigint").groupBy("route").agg(F.sum("n").alias("n"))
    large = F.broadcast(sizes.where(F.col("n") > 4 * met).select("route", F.expr(f"CAST(ceil(n / {met}) AS INT)").alias("pieces")))
    spread = (
        codes.select("code").mapInArrow(lambda b: dealt(b, True), "route bigint, n bigint, items binary")
        .join(large, "route", "left")
        .withColumn("mine", F.pmod(F.xxhash64("items"), F.coalesce("pieces", F.lit(1))).cast("int"))
        .withColumn("other", F.explode(F.expr("IF(pieces IS NULL, array(0), sequence(0, pieces - 1))")))
        .select("route", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "items")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def compared() -> pa.RecordBatch:
            items = np.frombuffer(b"".join(held), _ITEM)
            items = items[np.argsort(items["key"], kind="stable")]
            own = np.ascontiguousarray(items["code"])
            name, root = own[:, 0].view(np.int64), linked_wide(own, items["key"], most, first)
            links = np.unique(np.stack([name, name[root]], axis=1)[name != name[root]], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

        for b in batches:
            for *at, items in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                if at != now:
                    if held:
                        yield compared()
                    now, held = at, []
                held.append(items.as_buffer())
        if held:
            yield compared()

    keys = ["route", "low", "high"]
    return spread.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct()
