"""The registered queries over a small folder of tables: what their contracts fix."""

import hashlib
import re
import zlib

import pytest
from conftest import SCHEMA, text
from test_operators import brute_fingerprint, brute_statistics, split

from chronovox.llm import queries

#: Distinct ids, a null text, an empty one, white space, repeated texts.
DOCS = [(k, text(k, 40 + 7 * k) + (" insult slur" if k % 4 == 0 else ""), "en" if k % 2 else "de", "abc"[k % 3], 0) for k in range(1, 60)]
DOCS += [(70, None, None, None, None), (71, "", "en", "a", 0), (72, " \n\t", "de", "b", 0), (73, text(5, 75), "en", None, 0), (74, text(5, 75), "en", "a", 0), (75, "é☃ 漢字 " * 60, "de", "a", 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(DOCS, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], 1 if r[0] % 5 else 0, int(r[0] % 4 == 0)) for r in DOCS], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows(spark, folder, name):
    out = {r["doc_id"]: r.asDict() for r in queries.QUERIES[name](spark, folder).collect()}
    assert sorted(out) == sorted(r[0] for r in DOCS)
    return out


def held_out(k):
    return zlib.crc32(str(k).encode()) % 4 == 2


def test_fingerprints_and_edited_texts(spark, folder):
    got = rows(spark, folder, "op1_lz_fingerprints")
    own = {r[0]: r[1] or "" for r in DOCS}
    ids = sorted(own, reverse=True)
    for k, after in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = own[k], own[after]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
    assert got[6]["fingerprint"] != got[5]["fingerprint"] == got[73]["fingerprint"] == got[74]["fingerprint"]


def test_toxicity_columns(spark, folder):
    for k, r in rows(spark, folder, "op2_toxicity").items():
        assert r["held_out"] == held_out(k) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1


def test_surrogates_keep_documents(spark, folder):
    got = rows(spark, folder, "op3_pii_surrogates")
    assert all(r[1] == got[r[0]]["text"] and got[r[0]]["n_entities"] in (0, -1) for r in DOCS)


def test_shards(spark, folder):
    got = rows(spark, folder, "op6_sharding")
    for k, t, *_ in DOCS:
        data = (t or "").encode()
        assert (got[k]["size"], got[k]["text_crc32"], got[k]["law"], got[k]["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
    by = {}
    for r in got.values():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_quality_columns(spark, folder):
    got = rows(spark, folder, "op7_quality_rules")
    for k, t, *_ in DOCS:
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat = brute_statistics(t)
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n_words, word_chars, n_symbols, n_dup_lines, n_repeat)
        assert r["base_failed"] == (n_words < 50 or 100 * n_repeat > 50 * n_words) and not (r["kept"] and r["base_failed"])


def test_languages(spark, folder):
    got = rows(spark, folder, "op8_language_id")
    for k, t, *_ in DOCS:
        assert got[k]["held_out"] == held_out(k) and (got[k]["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", t or "")) and 0 <= got[k]["score"] <= 1
    assert {r["lang_pred"] for r in got.values()} <= {"en", "de", "und"}


def test_simhash_columns(spark, folder):
    got = rows(spark, folder, "op9_simhash")
    assert all(got[k]["fingerprint"] == f"{brute_fingerprint(t):016x}" and got[k]["component_id"] <= k for k, t, *_ in DOCS)
    assert got[74]["component_id"] == got[73]["component_id"] and got[72]["component_id"] == got[71]["component_id"] == 70


def test_mix_columns(spark, folder):
    got = rows(spark, folder, "op10_mixing")
    sizes = {}
    for _, t, _, s, _ in DOCS:
        sizes[s] = sizes.get(s, 0) + len(split(t))
    for k, t, _, s, _ in DOCS:
        assert got[k]["size"] == len(split(t)) and got[k]["source_size"] == sizes[s] and got[k]["taken"] <= 2 * got[k]["size"]
