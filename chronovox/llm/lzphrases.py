"""Document fingerprints: Lempel-Ziv phrases and minimum-hash signatures.

A text's UTF-8 bytes are parsed as LZ78 does: a phrase is the shortest run that isn't a phrase yet. The set of phrases
is the dictionary that a compressor would build, and texts that compress alike share phrases. A fingerprint holds the
least hashes of that set (all of them, if there are few), from which the Jaccard likeness of two sets is estimated: of
the least hashes of the union, the share that both have. The dictionary holds all phrases of its text: a text of n bytes
has some n / log n of them, and a task holds the dictionaries of two texts, never more."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronovox.llm.common import partitions

KEPT = 128
_BASE = 0xD6E8FEB86659FD93
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        both = np.ones((2, n), dtype=np.uint64)
        both[0, 1:], both[1, 1:] = _BASE, pow(_BASE, -1, 1 << 64)
        _powers = tuple(np.cumprod(both, axis=1))
    return _powers


class Parse:
    """An LZ78 parse that can be fed in parts and copied in between."""

    def __init__(self):
        self.tree: dict[int, int] = {}
        self.node = 0
        self.fed = 0
        self.ends: list[int] = []

    def copy(self) -> Parse:
        other = Parse()
        other.tree, other.node, other.fed, other.ends = self.tree.copy(), self.node, self.fed, self.ends.copy()
        return other

    def feed(self, data: bytes) -> None:
        tree, node, end = self.tree, self.node, self.ends.append
        get = tree.get
        for i, c in enumerate(data, self.fed + 1):
            at = node | c
            node = get(at)
            if node is None:
                node = 0
                tree[at] = (len(tree) + 1) << 8
                end(i)
        self.node = node
        self.fed += len(data)


def _hashes(data: bytes, ends: list[int]) -> np.ndarray:
    """A 32-bit hash of each phrase."""
    if not ends:
        return np.zeros(0, np.uint32)
    ahead, back = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8) + np.uint64(1)) * ahead[: len(data)], out=sums[1:])
    end = np.array(ends)
    start = np.r_[0, end[:-1]]
    h = (sums[end] - sums[start]) * back[start]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)).astype(np.uint32)


def signature(data: bytes, ends: list[int], kept: int = KEPT) -> np.ndarray:
    """The least distinct hashes, ascending."""
    return np.unique(_hashes(data, ends))[:kept]


def text_signature(text: str | None, kept: int = KEPT) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    p = Parse()
    p.feed(data)
    return signature(data, p.ends, kept)


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated Jaccard likeness of the phrase sets, 0 to 1; two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    union = both[np.r_[True, both[1:] != both[:-1]]][:kept]
    shared = both[:-1][both[1:] == both[:-1]]
    return float((shared <= union[-1]).sum()) / len(union)


def encoded(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """doc_id, fingerprint (hex) of every row. A null text counts as empty, whose fingerprint is the empty string.
    Other columns are left out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array([encoded(text_signature(t.as_py(), kept)) for t in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def chained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (range, halo, doc_id, key, tie, text) such that, with each range sorted by halo, then key and tie descending, a
    row's successor in descending order of id stands after it in its range; the rows marked halo only follow, as the
    first row of the next range. Texts move once. The driver holds the first rows of the ranges: two numbers each. Null
    ids come last; rows of equal id follow by a hash of the text, by which many rows of one id are dealt to ranges too;
    only rows equal in both stay together. The last row's successor is the first."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text"))
    n = 4 * partitions(docs.sparkSession)
    ends = rows.select("key", "tie").repartitionByRange(n, "key", "tie").groupBy(F.spark_partition_id().alias("r")).agg(F.max(F.struct("key", "tie")).alias("m"))
    heads = [(k, *m) for k, m in enumerate(sorted({tuple(r["m"]) for r in ends.collect()}))]
    rows = rows.withColumn("range", _place([h[1:] for h in heads]))
    before = {r: heads[(k + 1) % len(heads)][0] for k, (r, _, _) in enumerate(heads)}  # the next higher range
    first = docs.sparkSession.createDataFrame([(r, k, t, before[r]) for r, k, t in heads], "__range int, __key long, __tie long, __before int")
    head = rows.join(F.broadcast(first), (F.col("range") == F.col("__range")) & (F.col("key") == F.col("__key")) & (F.col("tie") == F.col("__tie")), "left")
    places = F.when(F.col("__before").isNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("halo")))).otherwise(
        F.array(F.struct(F.col("range"), F.lit(False).alias("halo")), F.struct(F.col("__before").alias("range"), F.lit(True).alias("halo"))))
    return head.withColumn("p", F.explode(places)).select("p.range", "p.halo", "doc_id", "key", "tie", "text")


def _place(heads: list[tuple[int, int]]) -> Column:
    """The number of (key, tie) pairs in `heads`, ascending, that are smaller than a row's: found among every so-manieth
    first, then among those between two of these."""
    if not heads:
        return F.lit(0)
    step = isqrt(len(heads)) + 1
    pairs = lambda xs: F.array(*[F.struct(F.lit(a).cast("long").alias("key"), F.lit(b).cast("long").alias("tie")) for a, b in xs])
    own = F.struct("key", "tie")
    coarse = F.size(F.filter(pairs(heads[step - 1 :: step]), lambda h: h < own)) if len(heads) >= step else F.lit(0)
    groups = F.array(*[pairs(heads[k : k + step]) for k in range(0, len(heads), step)])
    fine = F.size(F.filter(F.coalesce(F.get(groups, coarse), F.array().cast("array<struct<key:bigint,tie:bigint>>")), lambda h: h < own))
    return (coarse * step + fine).cast("int")


def half_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """Each document beside its edited text, whose last floor(n_chars / 2) code points are replaced by as many (or all)
    first ones of the next document in descending order of id; the last one's next is the first.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (likeness to the
    edited text, and to the next document). Null texts count as empty. The two texts' common beginning is parsed once.
    Rows of equal id follow by a hash of the text; repeated rows are each other's next. ids must be integers."""
    rows = chained(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    n = partitions(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), map(lambda t: t.as_py(), b.column(5)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        before = None  # (range, halo, doc_id, text, signature, first half's parse and bytes)
        for span, halo, doc_id, text in ordered(batches):
            if halo and (before is None or before[0] != span or before[1]):
                continue  # equal rows of the next range's first
            data = text.encode("utf-8", "surrogatepass")
            half = text[: len(text) - len(text) // 2].encode("utf-8", "surrogatepass")
            whole = Parse()
            whole.feed(half)
            start = None if halo else whole.copy()
            whole.feed(data[len(half) :])
            sig = signature(data, whole.ends, kept)
            if before is not None and before[0] == span:
                _, _, last_id, last, last_sig, last_start, last_half = before
                edited = last_half + text[: len(last) // 2].encode("utf-8", "surrogatepass")
                last_start.feed(edited[len(last_half) :])
                other = signature(edited, last_start.ends, kept)
                done.append((last_id, len(last), hashlib.sha256(edited).hexdigest(), encoded(last_sig), encoded(other), likeness(last_sig, other, kept), likeness(last_sig, sig, kept)))
                if len(done) >= 1000:
                    yield batch(done)
                    done = []
            before = (span, halo, doc_id, text, sig, start, half)
        if done:
            yield batch(done)

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema)

    schema = pa.schema([("doc_id", _arrow(kind)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return rows.repartition(n, "range").sortWithinPartitions("range", "halo", F.col("key").desc(), F.col("tie").desc()).mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
