"""Runs, against the definition by plain loops, and the query's digests."""

import hashlib
import random
import zlib

import numpy as np
from conftest import ROWS, SCHEMA, text

from chronovox.llm import queries, runs


def plain_runs(ws, least_length, least_exponent):
    """Every maximal stretch by its smallest period."""
    out = []
    for q in range(1, len(ws) // least_exponent + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least_length, least_exponent * q):
                s = ws[i : i + length]
                if not any(all(s[k] == s[k + r] for k in range(length - r)) for r in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(ws, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def cases():
    rng = random.Random(3)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 3, ["a", "b"] * 4, ["a"] * 200, list("abcabcabcabcabd"), list("zyxwvutsrq"), list("aabaabaabaabaab") * 4]
    for _ in range(300):
        n, k = rng.randrange(1, 60), rng.randrange(1, 4)
        out.append([rng.choice("abcd"[:k]) for _ in range(n)])
    for _ in range(60):
        root = [rng.choice("ab") for _ in range(rng.randrange(1, 9))]
        out.append([rng.choice("ab") for _ in range(rng.randrange(5))] + root * rng.randrange(2, 9) + root[: rng.randrange(len(root))] + [rng.choice("abc") for _ in range(rng.randrange(6))])
    a, b = ["x"], ["x", "y"]
    while len(b) < 300:
        a, b = b, b + a  # Fibonacci words are the richest in runs
    return [*out, b, list("ab") * 3000 + ["c"] + ["d"] * 4000]


def test_runs_equal_the_definition():
    texts = [" ".join(c).encode() for c in cases()]
    for length, exponent in ((6, 4), (1, 2), (1, 3), (10, 2)):
        some = texts if exponent > 3 else texts[:-1]
        for t, (n, found, left) in zip(some, runs._documents(some, length, exponent), strict=True):
            ws = t.decode().split()
            assert n == len(ws) and found == (want := plain_runs(ws, length, exponent)), (t, length, exponent)
            assert left.decode() == collapsed(ws, want)


def test_next_smaller_values():
    rng = np.random.default_rng(1)
    for v in (rng.permutation(500), np.arange(500), np.arange(500)[::-1].copy()):
        ends = np.array([499])
        v[499] = -5
        got = runs._next_smaller(v, ends)
        assert all(got[i] == next(j for j in range(i + 1, 500) if v[j] < v[i]) for i in range(499))


def test_frames(spark, docs, empty):
    got = sorted(runs.periodic_runs(docs).collect(), key=str)
    assert len(got) == len(ROWS) and runs.periodic_runs(empty).count() == 0
    by = {(r[0], r[1]): r for r in ROWS}
    for r in got:
        assert r["doc_id"] in {k for k, _ in by}
    nine = next(r for r in got if r["doc_id"] == 9)  # three words, thirty times
    assert [tuple(x) for x in nine["runs"]] == [(0, 90, 3)] and nine["collapsed"] == "é☃ 漢字 Ünïcode" and nine["n_words"] == 90
    none = [r for r in got if r["doc_id"] in (4, 5, 6)]
    assert all(r["runs"] == [] and r["collapsed"] == "" and r["n_words"] == 0 for r in none) and len(none) == 3
    assert runs.periodic_runs(docs.select("doc_id", "text").withColumnRenamed("doc_id", "runs").withColumnRenamed("text", "n_words"), "runs", "n_words").count() == len(ROWS)


def test_the_query(spark, tmp_path):
    table = [(k, text(k, 30 + 17 * (k % 9)), "en", "a", 0) for k in range(1, 150)]
    table += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, "one\ttwo \n" * 40, "en", "a", 0), (203, "x " * 3000, "en", "a", 0)]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(r[0] for r in table)
    planted = 0
    for k, t, *_ in table:
        ws = (t or "").split()
        h, n = zlib.crc32(str(k).encode()), len(ws)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
            planted += 1
        found = plain_runs(ws, 6, 4)
        r = got[k]
        assert r["n_runs"] == len(found) and r["collapsed_sha256"] == hashlib.sha256(collapsed(ws, found).encode()).hexdigest()
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
        if found:
            s, length, q = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, length, q, 1000 * length // q)
        else:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (None,) * 4
    assert planted > 5
