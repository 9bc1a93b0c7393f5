"""Packing: documents as token ids, cut and put together into sequences of a fixed capacity.

Windows are filled by minimum bin slack: the largest remaining length opens a window, and dynamic programming over the
multiset of remaining lengths, a bit set of reachable sums, finds the choice that comes closest to the capacity; going
back through the sets gives how many of each length it takes. As documents may be cut, what is still free is filled by the
beginning of one more piece. Each task packs its own rows from a bounded stock, so nothing is shuffled."""

from __future__ import annotations

import json
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task packs once it holds so many ids, until its stock is down to the second number.
STOCK, LEFT = 1 << 21, 1 << 18


def chosen(counts: dict[int, int], lengths: list[int], target: int) -> dict[int, int]:
    """How many of each length (ascending in `lengths`, `counts` of each) sum closest to the target without passing it.
    Longer ones are tried first; the search ends once the target is reached."""
    mask, reach, steps = (1 << (target + 1)) - 1, 1, []
    for at in range(bisect_right(lengths, target) - 1, -1, -1):
        length = lengths[at]
        copies, some = min(counts[length], target // length), 1
        while copies:
            some = min(some, copies)
            steps.append((length, some, reach))
            reach |= (reach << (some * length)) & mask
            copies, some = copies - some, 2 * some
        if reach >> target:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, some, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + some
            total -= some * length
    return taken


class Packer:
    """Pieces are (document, start, length); a window is a list of them, and its place in it is a piece's place."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.pieces: dict[int, list[tuple[int, int]]] = {}
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []
        self.held = 0

    def put(self, doc: int, start: int, length: int) -> None:
        if length not in self.pieces:
            self.pieces[length] = []
            self.counts[length] = 0
            insort(self.lengths, length)
        self.pieces[length].append((doc, start))
        self.counts[length] += 1
        self.held += length

    def take(self, length: int) -> tuple[int, int, int]:
        doc, start = self.pieces[length].pop()
        self.counts[length] -= 1
        self.held -= length
        if not self.counts[length]:
            del self.pieces[length], self.counts[length]
            self.lengths.remove(length)
        return doc, start, length

    def add(self, doc: int, length: int) -> Iterator[list[tuple[int, int, int]]]:
        """The windows that a document fills alone; what is left of it joins the stock."""
        full = length - length % self.capacity
        for start in range(0, full, self.capacity):
            yield [(doc, start, self.capacity)]
        if length > full:
            self.put(doc, full, length - full)

    def windows(self, left: int) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows until the stock holds at most `left` ids or, with 0, nothing: the last window is then cut into
        sequences whose lengths are powers of two, which need no padding."""
        while self.held > left:
            top = self.lengths[-1]
            wanted = chosen(self.counts | {top: self.counts[top] - 1}, self.lengths, self.capacity - top)
            wanted[top] = wanted.get(top, 0) + 1
            again = min(self.counts[n] // k for n, k in wanted.items())
            free = self.capacity - sum(n * k for n, k in wanted.items())
            for _ in range(1 if free else again):
                window = [self.take(n) for n, k in wanted.items() for _ in range(k)]
                if free and self.held:  # all that is left is longer than the gap
                    doc, start, length = self.take(self.lengths[-1])
                    window.append((doc, start, free))
                    self.put(doc, start + free, length - free)
                elif free:
                    yield from powers(window)
                    return
                yield window


def powers(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A window cut into ones whose lengths are the powers of two that add up to its length."""
    total, todo = sum(n for *_, n in window), list(reversed(window))
    for bit in range(total.bit_length() - 1, -1, -1):
        free, out = total & (1 << bit), []
        while free:
            doc, start, length = todo.pop()
            some = min(length, free)
            out.append((doc, start, some))
            free -= some
            if length > some:
                todo.append((doc, start + some, length - some))
        if out:
            yield out


#: The bytes that a byte-level vocabulary writes as themselves; the others take the code points from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Fixed: how byte-level vocabularies split a text before the merges.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Coder:
    """Token ids of texts by a tokenizers file. Where the file is plain byte-level BPE whose ids follow its merges, tiktoken
    gives the same ids several times as fast; texts with added tokens, and all other files, go through tokenizers."""

    def __init__(self, definition: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        self.quick = None
        spec = json.loads(definition)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        if _plain(spec):
            import tiktoken

            byte = {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
            ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
            self.quick = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.quick is None or any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.quick.encode_ordinary(text), np.uint32)


def _plain(spec: dict) -> bool:
    """Whether a file is byte-level BPE without further steps, each merge making the next id."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec.get("truncation") or spec.get("padding") or model.get("type") != "BPE" or split.get("type") != "ByteLevel":
        return False
    if split.get("add_prefix_space") or not split.get("use_regex", True) or any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word", "normalized")):
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "unk_token")):
        return False
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs))


_coders: dict[int, Coder] = {}


def packed(docs: DataFrame, definition: str, end: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: a row for each piece of a document.

    `definition` is the content of a tokenizers file, which executors get by broadcast; a document is its text's ids without
    special tokens, then `end`. `ids` holds a piece's ids as little-endian unsigned 32-bit numbers. Sequences are full but
    for a task's last ones, whose lengths are powers of two, at most log2(capacity) of them. Their numbers have gaps: a
    task's number times 2^40, and on.

    Null and empty texts are the id `end` alone. A text of any length is coded whole, by one task. Repeated rows are packed
    each, null ids stay null, other columns are left out; no rows, no rows. Reruns over the same files and partitions agree.
    A task holds some 2^21 ids at a time, and one text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (key := hash(shared.value)) not in _coders:
            _coders.clear()
            _coders[key] = Coder(shared.value)
        coder, packer, number = _coders[key], Packer(capacity), TaskContext.get().partitionId() << 40
        own: dict[int, list] = {}  # document -> its id, ids, and how many of them are still to be put out
        seen, waiting, id_type, out = 0, 0, None, []

        def put(window: list[tuple[int, int, int]]) -> None:
            nonlocal number
            offset = 0
            for doc, start, length in window:
                entry = own[doc]
                out.append((entry[0], start, length, entry[1][start : start + length].tobytes(), len(entry[1]), number, offset))
                offset += length
                entry[2] -= length
                if not entry[2]:
                    del own[doc]
            number += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, *kinds], strict=True)], names)

        for b in batches:
            id_type = b.column(0).type
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.append(coder.ids(text.as_py()), np.uint32(end)).astype("<u4")
                own[seen] = [doc_id.as_py(), ids, len(ids)]
                for window in packer.add(seen, len(ids)):
                    put(window)
                seen += 1
                waiting += len(ids)
                if waiting >= STOCK:
                    for window in packer.windows(LEFT):
                        put(window)
                    waiting = packer.held
                    if out:
                        yield batch()
        for window in packer.windows(0):
            put(window)
        if out:
            yield batch()

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
