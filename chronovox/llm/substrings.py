"""Substring dedup: fixed-block anchors.

A window is `window` consecutive words; a block is half as long. Any window of a document holds one whole block of that
document's non-overlapping blocks, so of two documents that share a window, each one's blocks can be found in the other
by probing every position. Three passes over the texts, with only hashes between them:

1. each group of documents sends the hash of every rolling block-length window (a probe), marked if it is one of the
   group's reference blocks; a bucket of hashes answers which blocks were met in more than one document (hits);
2. windows around a hit are candidates: extending a hit to both sides, within its document, word by word, is to take all
   windows that hold it. Their hashes meet in buckets again, which know the least doc_id of each;
3. a window whose least doc_id is smaller than its own document's goes; runs of such windows are the maximal repeats.

Texts are shuffled once, by group; Spark reuses that exchange for all passes. Hashes travel packed: sorted, delta-coded,
their bytes transposed, so that the shuffle's compression works; a group sends equal hashes once, so a passage that a
third of all documents share costs a bucket one entry a group. No pair of documents is ever formed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text a group, and a bucket's share, on average.
GROUP_BYTES = 4 << 20
BUCKET_BYTES = 6 << 20
_LAST = np.iinfo(np.int64).max
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Integers as bytes, lowest bytes first, then the next, and so on."""
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def _unpack_sorted(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


class Words:
    """The words of a batch of texts as hashes, with the bounds of each document."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype="<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        base = int(offsets[0]) if len(offsets) else 0
        self.bytes = buf[base : int(offsets[-1])] if len(offsets) else buf[:0]
        offsets = offsets - base
        word = ~_SPACE[self.bytes]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = offsets[:-1][(offsets[:-1] < len(word)) & (offsets[:-1] < offsets[1:])]
        first[inner] = word[inner]
        last = np.ones(len(word), dtype=bool)
        last[:-1] = ~word[1:] | first[1:]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last & word) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # words of document k: bounds[k] to bounds[k + 1]
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        length = self.ends - self.starts
        order = np.argsort(-length, kind="stable")
        start, length = self.starts[order], length[order]
        h = length.astype(np.uint64) * _MUL
        long = int(np.searchsorted(-length, -256))
        for j in range(int(length[long]) if long < len(length) else 0):
            m = int(np.searchsorted(-length, -j))  # those longer than j
            x = (h[long:m] ^ self.bytes[start[long:m] + j]) * _MUL
            h[long:m] = x ^ (x >> np.uint64(32))
        for k in range(long):
            h[k] = xxhash.xxh64_intdigest(self.bytes[start[k] : start[k] + length[k]].tobytes())
        out = np.empty_like(h)
        out[order] = _mix(h)
        return out

    def windows(self, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which n words of one document start, and the hash of each such window."""
        total = len(self.hashes)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        base = _BASES[which]
        ahead = np.full(total, base, dtype=np.uint64)
        ahead[0] = 1
        back = np.full(total, pow(base, -1, 1 << 64), dtype=np.uint64)
        back[0] = 1
        sums = np.zeros(total + 1, dtype=np.uint64)
        np.cumsum(self.hashes * np.cumprod(ahead), out=sums[1:])
        at = np.flatnonzero(self.bounds[self.doc + 1] - np.arange(total) >= n)
        return at, _mix((sums[at + n] - sums[at]) * np.cumprod(back)[at])


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index in `wanted` (sorted) of each value, or -1. A small table of low bits spares most of the searching."""
    out = np.full(len(values), -1, dtype=np.int64)
    if not len(wanted) or not len(values):
        return out
    bits = np.uint64((1 << min(24, max(10, int(len(wanted)).bit_length() + 4))) - 1)
    table = np.zeros(int(bits) + 1, dtype=bool)
    table[wanted & bits] = True
    some = np.flatnonzero(table[values & bits])
    at = np.minimum(np.searchsorted(wanted, values[some]), len(wanted) - 1)
    same = wanted[at] == values[some]
    out[some[same]] = at[same]
    return out


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys in order, the stable order that sorts them, and where each run of equal ones starts."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return k, order, np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)


def _key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket above, 32 bits of the hash below."""
    return ((h % np.uint64(buckets)) << np.uint64(32)) | (h >> np.uint64(32))


def repeats_removed(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text: the words that stay, joined by one space) for every row of docs.

    A word goes if a window over it also starts in a document of smaller doc_id. Null and empty texts have no words. A
    null id counts as larger than any other, and rows of equal id take nothing from each other. Repeats within one
    document stay. Windows are compared by 64-bit hashes plus their bucket's number, so more data brings more bits.
    ids must be integers."""
    if window % 2 or window < 2:
        raise ValueError("the window must be an even number of words")
    block = window // 2
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).collect()[0]["b"]
    groups, buckets = max(1, -(-size // group_bytes)), max(1, -(-size // bucket_bytes))
    grouped = rows.select(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(groups)).alias("g"), "doc_id", "text")

    def ids(table: pa.Table) -> np.ndarray:
        return table.column("doc_id").fill_null(_LAST).to_numpy()

    def probes(table: pa.Table) -> pa.Table:
        w = Words(table.column("text"))
        at, h = w.windows(block)
        keys, order, start = _runs(_key(h, buckets))
        at = at[order]
        doc = w.doc[at]
        anchor = (at - w.bounds[doc]) % block == 0
        last = np.r_[start[1:], len(keys)] - 1 if len(start) else start
        many = doc[start] != doc[last]
        anchor = np.logical_or.reduceat(anchor, start) if len(start) else anchor
        keys = keys[start]
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
        parts = [slice(a, b) for a, b in zip(cut, np.r_[cut[1:], len(keys)][: len(cut)], strict=True)]
        return pa.table({
            "bucket": pa.array(bucket[cut], pa.int64()),
            "g": pa.array(np.full(len(cut), table.column("g")[0].as_py()), pa.int64()),
            "h": pa.array([_pack_sorted(keys[p].astype(np.uint32)) for p in parts], pa.binary()),
            "many": pa.array([np.packbits(many[p]).tobytes() for p in parts], pa.binary()),
            "anchor": pa.array([np.packbits(anchor[p]).tobytes() for p in parts], pa.binary()),
        })

    def met(table: pa.Table) -> pa.Table:
        lists = [_unpack_sorted(x.as_py(), "<u4") for x in table.column("h")]
        flag = lambda name: np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(y)).astype(bool) for x, y in zip(table.column(name), lists, strict=True)])
        keys, order, start = _runs(np.concatenate(lists))
        several = (np.diff(np.r_[start, len(keys)]) > 1) | np.logical_or.reduceat(flag("many")[order], start)
        hit = keys[start][several & np.logical_or.reduceat(flag("anchor")[order], start)].astype(np.uint64)
        bucket = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(32)
        g, h = [], []
        for of, own in zip(table.column("g").to_pylist(), lists, strict=True):
            if len(found := own[_among(own.astype(np.uint64), hit) >= 0]):
                g.append(of)
                h.append(_pack_sorted(found.astype(np.uint64) | bucket))
        return pa.table({"g": pa.array(g, pa.int64()), "h": pa.array(h, pa.binary())})

    def candidates(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = {"bucket": pa.int64(), "g": pa.int64(), "h": pa.binary(), "least": pa.binary(), "many": pa.binary()}
        if not len(table) or not len(answers):
            return pa.table({k: pa.array([], t) for k, t in names.items()})
        w = Words(table.column("text"))
        hits = np.sort(np.concatenate([_unpack_sorted(x.as_py(), "<u8") for x in answers.column("h")]))
        at, h = w.windows(block)
        count = np.zeros(len(w.hashes) + 1, dtype=np.int64)
        count[at[_among(_key(h, buckets), hits) >= 0] + 1] = 1
        count = np.cumsum(count)
        at, h = w.windows(window)
        some = count[at + window - block + 1] > count[at]
        at, h = at[some], h[some]
        bucket = (w.windows(window, 1)[1][some] % np.uint64(buckets)).astype(np.int64)
        own = ids(table)[w.doc[at]]
        order = np.lexsort((own, h, bucket))
        bucket, h, own = bucket[order], h[order], own[order]
        start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])]) if len(h) else np.zeros(0, np.int64)
        last = np.r_[start[1:], len(h)] - 1 if len(start) else start
        many, least, bucket, h = own[start] != own[last], own[start], bucket[start], h[start]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(h) else start
        parts = [slice(a, b) for a, b in zip(cut, np.r_[cut[1:], len(h)][: len(cut)], strict=True)]
        return pa.table({
            "bucket": pa.array(bucket[cut], pa.int64()),
            "g": pa.array(np.full(len(cut), table.column("g")[0].as_py()), pa.int64()),
            "h": pa.array([_pack_sorted(h[p]) for p in parts], pa.binary()),
            "least": pa.array([pack(least[p]) for p in parts], pa.binary()),
            "many": pa.array([np.packbits(many[p]).tobytes() for p in parts], pa.binary()),
        })

    def least(table: pa.Table) -> pa.Table:
        lists = [_unpack_sorted(x.as_py(), "<u8") for x in table.column("h")]
        own = [unpack(x.as_py(), "<i8") for x in table.column("least")]
        keys, order, start = _runs(np.concatenate(lists))
        lowest, keys = np.minimum.reduceat(np.concatenate(own)[order], start), keys[start]
        bucket = table.column("bucket")[0].as_py()
        g, h, low = [], [], []
        for of, x, y, many in zip(table.column("g").to_pylist(), lists, own, table.column("many"), strict=True):
            found = lowest[np.searchsorted(keys, x)]
            some = (found < y) | np.unpackbits(np.frombuffer(many.as_py(), np.uint8), count=len(x)).astype(bool)
            if some.any():
                g.append(of)
                h.append(_pack_sorted(x[some]))
                low.append(pack(found[some]))
        return pa.table({"g": pa.array(g, pa.int64()), "bucket": pa.array([bucket] * len(g), pa.int64()), "h": pa.array(h, pa.binary()), "least": pa.array(low, pa.binary())})

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}
        if not len(table):
            return pa.table({k: pa.array([], t) for k, t in names.items()})
        w = Words(table.column("text"))
        covered = np.zeros(len(w.hashes), dtype=bool)
        if len(answers):
            h = np.concatenate([_unpack_sorted(x.as_py(), "<u8") for x in answers.column("h")])
            low = np.concatenate([unpack(x.as_py(), "<i8") for x in answers.column("least")])
            bucket = np.repeat(answers.column("bucket").to_numpy(), [len(x.as_py()) // 8 for x in answers.column("h")])
            order = np.argsort(h, kind="stable")
            h, low, bucket = h[order], low[order], bucket[order]
            at, own = w.windows(window)
            found = _among(own, h)
            second = (w.windows(window, 1)[1] % np.uint64(buckets)).astype(np.int64)
            some = np.flatnonzero((found >= 0) & (bucket[found] == second))
            gone = at[some][low[found[some]] < ids(table)[w.doc[at[some]]]]
            edge = np.zeros(len(covered) + window + 1, dtype=np.int64)
            edge[gone] += 1
            edge[gone + window] -= 1
            covered = np.cumsum(edge)[: len(covered)] > 0
        removed = np.add.reduceat(np.r_[covered, False].astype(np.int64), w.bounds[:-1]) * (np.diff(w.bounds) > 0)
        kept = []
        for k, (text, a, b) in enumerate(zip(table.column("text"), w.bounds[:-1], w.bounds[1:], strict=True)):
            plain = text.as_py().encode("utf-8").split()
            kept.append(b" ".join([x for x, c in zip(plain, covered[a:b].tolist(), strict=True) if not c] if removed[k] else plain))
        return pa.table({
            "doc_id": table.column("doc_id"),
            "n_words": pa.array(np.diff(w.bounds), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    hits = grouped.groupBy("g").applyInArrow(probes, "bucket long, g long, h binary, many binary, anchor binary").groupBy("bucket").applyInArrow(met, "g long, h binary")
    asked = grouped.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(candidates, "bucket long, g long, h binary, least binary, many binary")
    answers = asked.groupBy("bucket").applyInArrow(least, "g long, bucket long, h binary, least binary")
    return grouped.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
