"""Packing: every id once and in order, sequences full or powers of two, the choice of lengths against all subsets."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import ROWS, SCHEMA, text
from tokenizers import Tokenizer

from chronovox.llm import packing, queries

DEFINITION = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


def test_closest_sums():
    rng = random.Random(4)
    for _ in range(200):
        items = [rng.randrange(1, 40) for _ in range(rng.randrange(0, 10))]
        target = rng.randrange(0, 120)
        counts = {n: items.count(n) for n in items}
        taken = packing.chosen(counts, sorted(counts), target)
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= target)
        assert sum(n * k for n, k in taken.items()) == best and all(0 < k <= counts[n] for n, k in taken.items())


def check(lengths, pieces, capacity):
    """pieces: (doc, start, length, sequence, offset)."""
    by_doc, by_sequence = {}, {}
    for doc, start, length, sequence, offset in pieces:
        assert length > 0
        by_doc.setdefault(doc, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for doc, n in lengths.items():
        at = 0
        for start, length in sorted(by_doc.pop(doc)):
            assert start == at
            at += length
        assert at == n
    assert not by_doc
    short = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0
        short += at < capacity
    return short


def test_windows_are_full():
    rng = random.Random(5)
    for n, most in ((0, 1), (1, 3), (3, 100), (200, 90), (400, 300), (300, 40), (50, 64), (500, 5)):
        lengths = {k: rng.randrange(1, most + 1) for k in range(n)}
        p, out = packing.Packer(64), []
        for k, length in lengths.items():
            out += p.add(k, length)
            if k % 90 == 89:
                out += p.windows(500)
        out += p.windows(0)
        pieces = [(doc, start, length, s, sum(x[2] for x in w[:i])) for s, w in enumerate(out) for i, (doc, start, length) in enumerate(w)]
        assert check(lengths, pieces, 64) <= 6  # a task's last window only


@pytest.mark.parametrize("odd", ["", " ", "<|endoftext|>a <|endoftext|>", "a" * 3000, "é☃ 漢字\r\n\t  x", "I'll've 12 ½ ''s", " \x85  ", "𝔘𝔫𝔦"])
def test_ids_are_the_librarys(odd):
    coder, whole = packing.Coder(DEFINITION), Tokenizer.from_str(DEFINITION)
    assert coder.quick is not None
    assert coder.ids(odd).tolist() == whole.encode(odd, add_special_tokens=False).ids


def test_other_files_go_through_the_library():
    words = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    coder = packing.Coder(words)
    assert coder.quick is None and coder.ids("Some words, here").tolist() == Tokenizer.from_str(words).encode("Some words, here", add_special_tokens=False).ids


def brute(rows, out, capacity=2048):
    whole = Tokenizer.from_str(DEFINITION)
    ids = {k: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows}
    for r in out:
        data = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(data) and r["doc_tokens"] == len(ids[r["doc_id"]])
    return check({k: len(v) for k, v in ids.items()}, [(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in out], capacity)


def test_the_query(spark, tmp_path):
    table = [(k, text(k, 20 + 37 * (k % 50)), "en", "a", 0) for k in range(1, 200)]
    table += [(900, None, None, None, None), (901, "", "en", "a", 0), (902, text(902, 30000), "en", "a", 0), (903, "so <|endoftext|> it ends", "en", "a", 0)]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_packing(spark, str(tmp_path)).collect()
    assert brute([(r[0], r[1]) for r in table], out) <= 11 * 3
    again = queries.op13_packing(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_small_stock_is_refilled(spark, monkeypatch):
    monkeypatch.setattr(packing, "STOCK", 3000)
    monkeypatch.setattr(packing, "LEFT", 400)
    rows = [(k, text(k, 5 + 41 * (k % 13))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    from pyspark.sql import functions as F

    out = packing.packed(df, DEFINITION, 1, capacity=256).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert brute(rows, out, 256) <= 8


def test_frames(spark, docs, empty):
    out = packing.packed(docs, DEFINITION, 1).collect()
    whole = Tokenizer.from_str(DEFINITION)
    n = sum(len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)  # repeated and null ids too
    assert sum(r["length"] for r in out) == n and all(len(r["ids"]) == 4 * r["length"] for r in out)
    assert packing.packed(empty, DEFINITION, 1).count() == 0
