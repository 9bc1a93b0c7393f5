"""Runs: maximal stretches of words that repeat with a period, by the runs theorem.

Every run holds, within its first period, a word that is the longest Lyndon word of its place under one of two opposite
orders of the words and as long as the run's period. Under one order that longest Lyndon word ends where the inverse
suffix array has its next smaller value, under the other where it has the next larger one, so one suffix array gives all
candidates; how far a candidate repeats to either side is a minimum over a range of the array of common prefixes, of the
words and of the words reversed. Everything is numpy over many documents at a time; documents never meet in the suffix
array, as a document's number is part of each symbol."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of about so many bytes share a suffix array.
SOME = 2 << 20
#: Symbols compared at once.
_CHUNK = 1 << 16


def _matched(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from a and from b on are equal; each pair ends at the latest at a symbol that occurs once."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    while live.size:
        width = min(max(_CHUNK // live.size, 8), _CHUNK)
        step = np.arange(width)
        left = text[np.minimum((a[live] + out[live])[:, None] + step, len(text) - 1)]
        differ = left != text[np.minimum((b[live] + out[live])[:, None] + step, len(text) - 1)]
        any_, first = differ.any(1), differ.argmax(1)
        out[live] += np.where(any_, first, width)
        live = live[~any_]
    return out


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high], both included. Of the sparse table one level is held at a time."""
    out = np.zeros(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


@dataclass
class Suffixes:
    """Ranks of all suffixes and the common prefixes of neighbours in rank. Each document ends in a symbol of its own."""

    rank: np.ndarray
    common: np.ndarray

    @classmethod
    def of(cls, text: np.ndarray) -> Suffixes:
        """By doubling; after each round only suffixes that still tie are sorted again."""
        n = len(text)
        order = np.argsort(text, kind="stable")
        places = np.arange(n)
        new = np.r_[True, text[order[1:]] != text[order[:-1]]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, places, 0))
        live, h = places[~(new & np.r_[new[1:], True])], 1
        while live.size:
            suffix = order[live]
            key = rank[suffix] * n + rank[suffix + h]
            o = np.argsort(key, kind="stable")
            key, suffix = key[o], suffix[o]
            order[live] = suffix
            new = np.r_[True, key[1:] != key[:-1]]
            rank[suffix] = np.maximum.accumulate(np.where(new, live, 0))
            live, h = live[~(new & np.r_[new[1:], True])], 2 * h
        before = np.full(n, -1)
        before[order[1:]] = order[:-1]
        # A suffix whose symbol before equals that of its neighbour in rank shares one symbol less than the suffix before it.
        fresh = np.flatnonzero((before <= 0) | (places == 0) | (text[places - 1] != text[before - 1]))
        shared = np.zeros(n, np.int64)
        real = fresh[before[fresh] >= 0]
        shared[real] = _matched(text, real, before[real])
        last = np.zeros(n, np.int64)
        last[fresh] = fresh
        last = np.maximum.accumulate(last)
        common = np.empty(n, np.int64)
        common[rank] = shared[last] + last - places
        return cls(rank, common)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the common prefix of the suffixes a and b, which differ."""
        ra, rb = self.rank[a], self.rank[b]
        return _range_minima(self.common, np.minimum(ra, rb) + 1, np.maximum(ra, rb))


def _next_smaller(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place the next one of a smaller value; places in `ends` have none. Pointers jump along pointers."""
    n = len(values)
    padded = np.r_[values, values.min(initial=0) - 1]
    after = np.arange(1, n + 2)
    idle = np.zeros(n, bool)
    idle[ends] = True
    live = np.flatnonzero(~idle)
    while live.size:
        live = live[padded[after[live]] > padded[live]]
        after[live] = after[after[live]]
    return after[:n]


def runs_in(text: np.ndarray, ends: np.ndarray, least_length: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of at least so many words and periods, by start, then period. `text` has the
    documents' symbols one after another, different ones in different documents, and at each place of `ends` a document's
    last symbol, smaller than all its others."""
    none = np.zeros(0, np.int64)
    if len(text) < 2:
        return none, none, none
    forward = Suffixes.of(text)
    places = np.arange(len(text))
    own = ends[np.searchsorted(ends, places)]  # where a place's document ends
    found_i, found_p, found_right = [none], [none], [none]
    for values in (forward.rank, -forward.rank):
        p = _next_smaller(values, ends) - places
        i = np.flatnonzero(places + (least_exponent - 1) * p <= own)
        i = i[text[i] == text[i + p[i]]]
        right = forward.shared(i, i + p[i])
        # Within a run's first period a root is followed by more than least_exponent - 1 periods.
        far = right > (least_exponent - 2) * p[i]
        found_i.append(i[far])
        found_p.append(p[i[far]])
        found_right.append(right[far])
    i, p, right = map(np.concatenate, (found_i, found_p, found_right))
    if not i.size:
        return none, none, none
    # Documents with candidates once more, reversed.
    docs = np.unique(np.searchsorted(ends, i))
    begins = np.r_[0, ends[:-1] + 1]
    sizes = ends[docs] - begins[docs]
    top = np.cumsum(sizes + 1) - 1  # where the reversed documents end
    back = np.empty(int(top[-1]) + 1, text.dtype)
    inside = np.repeat(np.arange(len(docs)), sizes + 1)
    step = np.arange(len(back)) - (top - sizes)[inside]
    source = np.where(step == sizes[inside], ends[docs][inside], ends[docs][inside] - 1 - step)
    back[:] = text[source]
    at = np.searchsorted(docs, np.searchsorted(ends, i))
    mirrored = top[at] - (i - begins[docs][at])  # of the place before i; the end's for the first place
    left = Suffixes.of(back).shared(mirrored, mirrored - p)
    first = left < p  # later roots of a run find the same run again
    start, length, period = (i - left)[first], (left + p + right)[first], p[first]
    keep = (length >= least_length) & (length >= least_exponent * period)
    start, length, period = np.unique(np.stack([start[keep], length[keep], period[keep]]), axis=1)
    o = np.lexsort((period, start))
    return start[o], length[o], period[o]


def _documents(texts: list[bytes], least_length: int, least_exponent: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Number of words, runs, and the kept words, of each text."""
    words = [t.split() for t in texts]  # of bytes: at ASCII white space only
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    doc = np.repeat(np.arange(len(texts)), sizes + 1)
    codes = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode()
    symbols = np.zeros(len(doc), np.int64)
    inner = np.ones(len(doc), bool)
    inner[ends] = False
    symbols[inner] = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    symbols += doc * (len(codes.dictionary) + 1)
    start, length, period = runs_in(symbols, ends, least_length, least_exponent)
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    kept = np.cumsum(cover[:-1]) == 0
    begins = ends - sizes
    owner = doc[start]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k, ws in enumerate(words):
        low, high = bounds[k], bounds[k + 1]
        if low == high:
            yield len(ws), [], b" ".join(ws)
            continue
        b = begins[k]
        stays = kept[b : b + len(ws)].tolist()
        yield len(ws), list(zip((start[low:high] - b).tolist(), length[low:high].tolist(), period[low:high].tolist(), strict=True)), b" ".join(w for w, s in zip(ws, stays, strict=True) if s)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. `runs` lists start, length and (smallest) period of each maximal
    stretch of at least `least_length` words and `least_exponent` (2 or more) periods, by start, then period. `collapsed`
    has the words that lie in no run after its first period, joined by single spaces.

    Null and empty texts, and texts of white space, have no words. A text of any length is taken whole, in one task: some
    hundred bytes a word. Repeated rows come out repeated, null ids stay null, other columns are left out; no rows, no
    rows. Nothing is shuffled."""
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def portions(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = np.cumsum(pa.compute.binary_length(b.column(1)).to_numpy(zero_copy_only=False) + 1)
        cuts = np.flatnonzero(np.diff(sizes // SOME, prepend=0)).tolist()
        for low, high in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            if high > low:
                yield b.slice(low, high - low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole):
                n_words, runs, collapsed = zip(*_documents(b.column(1).to_pylist(), least_length, least_exponent), strict=True)
                flat = [dict(zip(("start", "length", "period"), r, strict=True)) for rs in runs for r in rs]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), pa.array(flat, _RUN))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n_words, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
