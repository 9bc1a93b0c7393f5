"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch that no earlier batch had are concatenated and indexed by a suffix array, as deep as the
longest piece. Every piece of the vocabulary is found by binary search as a range of the array: its occurrences. These
are edges from a position over a length; sorted by position and length (a counting sort into a table, as lengths are
few) they tell at once which stretch is which piece.

Relaxing the edges depends on the kind of model. For a BPE model, the best path by score sums isn't what the model
means: its pieces come from merging, again and again, the neighbours that form the best piece, the leftmost of equals.
So the edges are relaxed in that order, for all words at a time: in each round, every word takes its best edge that
joins two neighbouring symbols. Words of more than LONG characters are relaxed with a heap, in the same order. Characters that are
no piece become byte pieces. Round trips are exact except for U+2581, which the format decodes as a space."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Characters indexed at a time, words kept from batch to batch, and the longest word relaxed in rounds.
INDEXED = 600_000
REMEMBERED = 450_000
LONG = 48
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Pieces in the order of their ids, their scores, and their kinds: "normal", "byte", or "other" (control, unknown,
    unused), which never occurs in a text."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], unknown: int = 0, dummy_prefix: bool = True):
        self.pieces, self.kinds, self.unknown, self.dummy_prefix = pieces, kinds, unknown, dummy_prefix
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.alphabet = {c: n for n, c in enumerate(sorted({c for i in normal for c in pieces[i]}), 1)}
        if len(self.alphabet) >= 0xFFFF:
            raise ValueError("too many characters in the vocabulary")
        self.depth = max((len(pieces[i]) for i in normal), default=1)
        self.bytes = np.full(256, unknown, dtype=np.int32)
        for i, k in enumerate(kinds):
            if k == "byte":
                self.bytes[int(pieces[i][3:5], 16)] = i
        self.fallback = "byte" in kinds
        distinct = sorted({scores[i] for i in normal}, reverse=True)
        place = {s: n for n, s in enumerate(distinct)}
        self.rank = np.full(len(pieces) + 1, _NONE, dtype=np.int64)  # the last stands for no piece
        for i in normal:
            self.rank[i] = place[scores[i]]
        self.normal = np.array(normal, dtype=np.int32)
        self.lengths = np.array([len(pieces[i]) for i in normal], dtype=np.int64)
        codes = np.zeros((len(normal), self.width), dtype=np.uint64)
        for row, i in enumerate(normal):
            codes[row, : len(pieces[i])] = [self.alphabet[c] for c in pieces[i]]
        self.low = _keys(codes)
        top = codes.copy()
        for row, n in enumerate(self.lengths):
            top[row, n:] = 0xFFFF
        self.high = _keys(top)
        # A text is cut where no piece reaches across: before a run of spaces, and around line ends.
        inner = any(SPACE in p.lstrip(SPACE) for p in (pieces[i] for i in normal))
        self.cut = None if inner else re.compile(r" *[^ ]+| +" if "\n" in self.alphabet else r" *[^ \n]+| +|\n")
        self.lut = np.zeros(0x110000, dtype=np.uint16)
        for c, n in self.alphabet.items():
            self.lut[ord(c)] = n
        self.lut[32] = self.alphabet.get(SPACE, 0)

    @property
    def width(self) -> int:
        return -(-self.depth // 4) * 4

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From the file of a BPE model that leaves texts as they are (no normalization, spaces kept). Others raise an
        error, as merging would give other ids. The library reads the vocabulary only; it takes no part in encoding."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = {k: dict(_fields(v)) for k, v in _fields(sp.serialized_model_proto()) if k in (2, 3)}
        trainer, normalizer = spec.get(2, {}), spec.get(3, {})
        # The format's field numbers, and its defaults where a field is absent.
        if trainer.get(3, 1) != 2:
            raise ValueError(f"{path}: not a BPE model")
        if normalizer.get(2, b"") or normalizer.get(4, 1):
            raise ValueError(f"{path}: the model normalizes texts")
        if trainer.get(24, 0) or not normalizer.get(5, 1):
            raise ValueError(f"{path}: spaces are suffixes or not escaped")
        n = sp.get_piece_size()
        kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [kind(i) for i in range(n)], sp.unk_id(), bool(normalizer.get(3, 1)))


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message in the wire format of protocol buffers."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(message):
        field, kind = divmod(varint(), 8)
        if kind == 0:
            yield field, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield field, message[at : at + size]
            at += size


def _keys(codes: np.ndarray) -> np.ndarray:
    """Rows of codes as columns of 64-bit keys, four codes each, that compare alike."""
    shift = np.array([48, 32, 16, 0], dtype=np.uint64)
    return (codes.reshape(len(codes), -1, 4) << shift).sum(axis=2, dtype=np.uint64).T.copy()


def suffix_array(codes: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of codes other than 0 in the order of the `width` codes from there on, and those codes as sorted keys."""
    n = len(codes)
    padded = np.zeros(n + width + 4, dtype=np.uint64)
    padded[:n] = codes
    four = (padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:]
    columns = [four[k : k + n] for k in range(0, width, 4)]
    span, key = 4, four
    while span < width:  # prefix doubling
        rank = _ranks(key)
        key = rank << np.uint64(32)
        key[: len(rank) - span] |= rank[span:]
        span *= 2
    order = np.argsort(key[:n])
    order = order[codes[order] != 0]
    return order, [c[order] for c in columns]


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    k = keys[order]
    out = np.empty(len(keys), dtype=np.uint64)
    out[order] = np.cumsum(np.r_[False, k[1:] != k[:-1]]).astype(np.uint64)
    return out


def _search(columns: list[np.ndarray], keys: np.ndarray, right: bool) -> np.ndarray:
    """Where each key (a column) would stand among the sorted rows, left of equals or right of them."""
    # The first column alone narrows the range; the others are bisected inside it.
    low, high = np.searchsorted(columns[0], keys[0], "left"), np.searchsorted(columns[0], keys[0], "right")
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = np.minimum((low + high) // 2, len(columns[0]) - 1)
        before = np.full(len(low), right)
        for column, key in zip(columns[:0:-1], keys[:0:-1], strict=True):
            at = column[middle]
            before = (at < key) | ((at == key) & before)
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)


class Encoder:
    """Encodes batches of texts. Words it has met are kept; past REMEMBERED, only those that came again, or none if
    these are too many themselves. What is kept changes the time, never the result."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int32)

    def _forget(self) -> None:
        again = self.uses > 2
        if again.sum() > REMEMBERED // 2:
            again[:] = False
        words = [w for w, stay in zip(self.known, again.tolist(), strict=True) if stay]
        size = np.diff(self.ends)[again]
        self.flat = np.r_[self.flat[: self.ends[-1]][np.repeat(again, np.diff(self.ends))], np.zeros(1 << 16, dtype=np.int32)]
        self.known = {w: k for k, w in enumerate(words)}
        self.ends = np.r_[0, np.cumsum(size)]
        self.uses = np.ones(len(words), dtype=np.int32)

    def _edges(self, codes: np.ndarray) -> np.ndarray:
        """table[position, length - 1]: the piece there, or the row past all pieces."""
        v = self.v
        table = np.full((len(codes), v.depth), len(v.pieces), dtype=np.int32)
        order, columns = suffix_array(codes, v.width)
        if len(order):
            low = _search(columns, v.low, False)
            count = _search(columns, v.high, True) - low
            which = np.repeat(np.arange(len(low)), count)
            at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
            table[at, v.lengths[which] - 1] = v.normal[which]
        return table

    def _rounds(self, table: np.ndarray, start: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (start, end) after all merges. word: the word of each one-character symbol."""
        v, end = self.v, start + 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(start):
            key = np.full(len(start), _NONE, dtype=np.int64)
            pair = np.flatnonzero((word[1:] == word[:-1]) & (end[1:] - start[:-1] <= v.depth))
            r = v.rank[table[start[pair], end[pair + 1] - start[pair] - 1]]
            pair, r = pair[r < _NONE], r[r < _NONE]
            key[pair] = (r << 32) | pair
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(key, first)
            merged = best < _NONE
            size = np.diff(np.r_[first, len(start)])
            if not merged.all():
                rest = np.repeat(~merged, size)
                done.append((start[rest], end[rest]))
            at = best[merged] & 0xFFFFFFFF
            end = end.copy()
            end[at] = end[at + 1]
            stay = np.repeat(merged, size)
            stay[at + 1] = False
            start, end, word = start[stay], end[stay], word[stay]
        both = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*done, strict=True)] if done else [np.zeros(0, np.int64)] * 2
        order = np.argsort(both[0], kind="stable")
        return both[0][order], both[1][order]

    def _heap(self, table: np.ndarray, first: int, last: int) -> list[tuple[int, int]]:
        """The same for one long word, from position `first` to `last`."""
        v = self.v
        end, before = {p: p + 1 for p in range(first, last)}, {p: p - 1 for p in range(first + 1, last)}
        heap: list[tuple[int, int, int]] = []

        def offer(p: int) -> None:
            q = end[p]
            if q < last and (n := end[q] - p) <= v.depth and (r := int(v.rank[table[p, n - 1]])) < _NONE:
                heapq.heappush(heap, (r, p, p + n))

        for p in range(first, last):
            offer(p)
        while heap:
            _, p, to = heapq.heappop(heap)
            if p not in end or end[p] >= last or end.get(end[p]) != to:
                continue
            del end[end[p]]
            before.pop(end[p], None)
            end[p] = to
            if to < last:
                before[to] = p
            offer(p)
            if p > first:
                offer(before[p])
        return sorted(end.items())

    def _learn(self, words: list[str]) -> None:
        """Encodes new words and remembers them."""
        v = self.v
        text = "\0".join(words) + "\0"
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(lengths + 1) - lengths - 1
        codes = v.lut[raw]
        codes[starts + lengths] = 0
        table = self._edges(codes)
        at = np.arange(len(raw))
        inside = np.ones(len(raw), dtype=bool)
        inside[starts + lengths] = False
        word = np.repeat(np.arange(len(words)), lengths + 1)
        short = inside & (lengths[word] <= LONG)
        start, end = self._rounds(table, at[short], word[short])
        long = [self._heap(table, int(s), int(s + n)) for s, n in zip(starts[lengths > LONG], lengths[lengths > LONG], strict=True)]
        if long:
            more = np.array([x for w in long for x in w], dtype=np.int64)
            start, end = np.r_[start, more[:, 0]], np.r_[end, more[:, 1]]
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
        ids = table[start, end - start - 1]
        missing = np.flatnonzero(ids == len(v.pieces))
        count = np.ones(len(ids), dtype=np.int64)
        if len(missing):  # characters that are no piece, as bytes
            codes = [chr(raw[p]).encode("utf-8", "surrogatepass") if v.fallback else b"" for p in start[missing]]
            count[missing] = [len(c) or 1 for c in codes]
            filled = np.repeat(ids, count)
            place = np.cumsum(count) - count
            for k, c in zip(missing, codes, strict=True):
                filled[place[k] : place[k] + count[k]] = v.bytes[np.frombuffer(c, np.uint8)] if c else v.unknown
            ids = filled
        per_word = np.bincount(word[start], weights=count, minlength=len(words)).astype(np.int64)
        base = int(self.ends[-1])
        while base + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.flat[base : base + len(ids)] = ids
        n = len(self.known)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.ends = np.r_[self.ends, base + np.cumsum(per_word)]
        self.uses = np.r_[self.uses, np.zeros(len(words), dtype=np.int32)]

    def _words(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = (" " if self.v.dummy_prefix else "") + text.replace(SPACE, " ")
        return self.v.cut.findall(text) if self.v.cut else [text]

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids end."""
        cut = [self._words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self._forget()
        new, size = [], 0
        for w in set().union(*cut).difference(self.known):
            new.append(w)
            size += len(w) + 1
            if size > INDEXED:
                self._learn(new)
                new, size = [], 0
        if new:
            self._learn(new)
        counts = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(counts.sum()))
        self.uses += np.bincount(index, minlength=len(self.uses)).astype(np.int32)
        first, size = self.ends[index], self.ends[index + 1] - self.ends[index]
        upto = np.cumsum(size)
        ids = self.flat[np.arange(int(size.sum())) + np.repeat(first - (upto - size), size)]
        total = np.r_[0, upto]
        return ids, total[np.cumsum(counts)]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        raw = lambda p, k: bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") if k == "normal" else b""
        self.raw = [raw(p, k) for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]
        self.raw[vocabulary.unknown] = " ⁇ ".encode()
        self.prefix = vocabulary.dummy_prefix

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD; control pieces stand for nothing."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_encoders: dict[int, tuple[Encoder, Decoder]] = {}


def _coders(key: int, vocabulary: Vocabulary) -> tuple[Encoder, Decoder]:
    """One a worker process, kept from task to task."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary), Decoder(vocabulary)
    return _encoders[key]


def coded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", some: int = 500) -> DataFrame:
    """doc_id, ids (array of int), decoded (the ids' text) for every row of docs.

    Null and empty texts have no ids and decode to the empty text. Texts of any length are encoded whole, about `some`
    rows at a time. Repeated rows come out repeated; other columns are left out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") else id(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _coders(key, shared.value)
        for whole in batches:
            for k in range(0, whole.num_rows, some):
                b = whole.slice(k, some)
                ids, ends = encoder.encode(b.column(1).to_pylist())
                bounds = np.r_[0, ends]
                text = [decoder.decode(ids[i:j].tolist()) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def decoded(tokens: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row; a null list decodes to the empty text."""
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for b in batches:
            text = [decoder.decode(x.as_py() or ()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")
