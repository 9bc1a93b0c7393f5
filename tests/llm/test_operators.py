import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from conftest import ROWS, SCHEMA, text
from pyspark.sql import functions as F

from chronovox.llm import langid, lzphrases, mixing, quality, sentencepieces, sharding, simhash, substrings, surrogates, toxicity
from chronovox.llm.common import words


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_substrings_against_brute_force(docs):
    got = sorted(map(tuple, substrings.repeats_removed(docs, 50, group_bytes=2000, bucket_bytes=3000).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)
    where = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        w = split(t)
        for p in range(len(w) - 49):
            where[tuple(w[p : p + 50])].append(i)
    want = []
    for i, t, *_ in ROWS:
        w, gone = split(t), set()
        for p in range(len(w) - 49):
            if any(j is not None and (i is None or j < i) for j in where[tuple(w[p : p + 50])]):
                gone |= set(range(p, p + 50))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want, key=str)


def test_substrings_of_an_empty_table(empty):
    assert substrings.repeats_removed(empty).collect() == []


def brute_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_brute_force(docs):
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    fp = [brute_fingerprint(t) for _, t, *_ in ROWS]
    group = list(range(len(ROWS)))
    for a in range(len(ROWS)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                group = [group[a] if g == group[b] else g for g in group]
    least = lambda k: min((r[0] for r, g in zip(ROWS, group, strict=True) if g == group[k] and r[0] is not None), default=None)
    assert got == sorted(((r[0], f"{fp[k]:016x}", least(k)) for k, r in enumerate(ROWS)), key=str)


@pytest.mark.parametrize("block", [3, 4096])
def test_links_connect_all_within_the_radius(spark, block):
    rng = np.random.Generator(np.random.PCG64(5))
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = set()
    for c in centre:
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                c ^= np.uint64(1 << int(b))
            fp.add(int(c))
    fp = sorted(fp)
    root = dict(map(tuple, simhash.components(simhash.links(spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in map(np.uint64, fp)], "fp long"), block)).collect()))
    own = {x: int(np.uint64(x).view(np.int64)) for x in fp}
    label = {x: x for x in fp}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in fp:
        for b in fp:
            if a < b and (a ^ b).bit_count() <= 3:
                label[find(b)] = find(a)
    classes = lambda f: sorted(sorted(x for x in fp if f(x) == r) for r in {f(x) for x in fp})
    assert classes(find) == classes(lambda x: root.get(own[x], own[x]))


def test_a_chain_of_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    root = dict(map(tuple, simhash.components(edges).collect()))
    assert len({root[k] for k in range(61)}) == 1 and root[100] == root[101] != root[0]


def phrases(b):
    out, start = set(), 0
    for i in range(len(b)):
        if b[start : i + 1] not in out:
            out.add(b[start : i + 1])
            start = i + 1
    return out


def test_lz_fingerprints(docs, empty):
    distinct = {r[0]: r[1] or "" for r in ROWS if r[0] is not None}
    source = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in lzphrases.half_edited(source, kept=10**6).collect()}
    ids = sorted(distinct, reverse=True)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, r = distinct[i], got[i]
        edited = t[: len(t) - len(t) // 2] + distinct[j][: len(t) // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (phrases(x.encode()) for x in (t, edited, distinct[j]))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1, abs=1e-9)
        assert r["near_next"] == pytest.approx(len(a & c) / len(a | c) if a | c else 1, abs=1e-9)
    assert got[1]["fingerprint"] == got[3]["fingerprint"]
    assert lzphrases.half_edited(docs).count() == len(ROWS)
    assert lzphrases.half_edited(empty).collect() == []
    assert lzphrases.half_edited(docs.where("doc_id = 1")).collect()[0]["near_next"] == 1.0


def test_permutation_is_a_bijection():
    for n in (0, 1, 2, 3, 10, 97, 1000):
        p = sharding.Permutation(n, seed=n)
        place = p.place(np.arange(n))
        assert sorted(place) == list(range(n)) and (p.row(place) == np.arange(n)).all()


def test_shards(docs, empty):
    rows = sharding.shuffled_shards(docs.select("doc_id", F.xxhash64("text").alias("x")), 4, ["doc_id", "x"], seed=1).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == len(ROWS) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shuffled_shards(empty.select("doc_id"), 4, ["doc_id"]).collect() == []


def brute_statistics(t):
    w = split(t)
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, docs):
    more = spark.createDataFrame([(90, "a b c a b c # | a\nx y\nx y\n\n\nx y", "", "", 0), (91, "a a a a", "", "", 0)], SCHEMA)
    got = quality.statistics(docs.select("doc_id", "text", "w", "h" if "h" in docs.columns else "w").unionByName(more.select("doc_id", "text"), allowMissingColumns=True))
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got.collect()), key=str)
    assert got == sorted(((r[0], *brute_statistics(r[1])) for r in [*ROWS, *map(tuple, more.collect())]), key=str)


def test_decision_list():
    rng = np.random.Generator(np.random.PCG64(3))
    rows = []
    for _ in range(900):
        a, b = int(rng.integers(0, 100)), int(rng.integers(0, 100))
        rows.append(({"a": a, "b": b}, int(a > 80 or (a < 20 and b > 70))))
    rules = quality.learn(rows, ["a", "b"])
    wrong = sum(any(r.covers(x) for r in rules) != bool(y) for x, y in rows)
    assert 1 <= len(rules) <= 4 and wrong <= 9
    assert quality.learn([], ["a"]) == [] and quality.learn([({"a": 1}, 0)] * 9, ["a"]) == []


def test_verdict_matches_rules(docs, spark):
    rules = [quality.Rule((quality.Condition("symbols", True, 100), quality.Condition("word_length", False, 900)))]
    stats = quality.statistics(docs)
    for r in stats.select("*", *(F.expr(e).alias(f) for f, e in quality.FEATURES.items()), quality.verdict(rules).alias("kept"), quality.base_failed().alias("failed")).collect():
        assert r["kept"] == (not r["failed"] and not rules[0].covers(r.asDict()))


def test_language(spark, docs, empty):
    rows = [(k, t * 3, lang) for k, (t, lang) in enumerate([("the house of the king and this", "en"), ("das haus und der könig ist", "de"), ("that was the thing with them", "en"), ("nicht für die schule sondern", "de")])]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names, scores = model.predict(["this is the thing", "das ist nicht der", None, "12 34!", ""])
    assert names == ["en", "de", "und", "und", "und"] and (scores >= 0).all() and (scores <= 1).all()
    counts = collections.Counter(r["lang_pred"] for r in langid.identify(docs, model).collect())
    assert sum(counts.values()) == len(ROWS) and counts["und"] == 3
    assert langid.identify(empty, langid.train(empty)).collect() == []


def test_machine_learns_interactions(spark, docs, empty):
    rng = np.random.Generator(np.random.PCG64(4))
    rows = []
    for k in range(1500):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        rows.append((k, " ".join([f"w{x}" for x in rng.integers(0, 300, 20)] + ["insult"] * a + ["group"] * b), int(a and b)))
    machine = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    both, one, other = machine.score([toxicity.terms(t) for t in ("insult x group", "insult x", "group x")])
    assert both > 0.8 and one < 0.3 and other < 0.3
    scores = [r["score"] for r in toxicity.scored(docs, machine).collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    nothing = toxicity.train(empty.select("doc_id", "text", F.lit(None).cast("int").alias("toxic")))
    assert toxicity.scored(empty, nothing).collect() == []


def test_toxicity_labels_apart_from_texts(spark, docs):
    """Labels that repeat, lack a document, or are null; null and repeated ids and null texts among the documents."""
    rng = np.random.Generator(np.random.PCG64(8))
    rows = [(k, " ".join([f"w{x}" for x in rng.integers(0, 300, 20)] + ["insult"] * (k % 3 == 0))) for k in range(100, 900)]
    marks = [(k, int(k % 3 == 0)) for k, _ in rows]
    texts = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    labels = spark.createDataFrame(marks + marks[:300] + [(5000, 1), (None, 1), (101, None), (2, 0), (4, 0)], "doc_id long, toxic int")
    machine = toxicity.train(texts, labels)
    bad, good = machine.score([toxicity.terms("w1 insult w2"), toxicity.terms("w1 w2")])
    assert bad > 0.5 and good < 0.2
    again = toxicity.train(texts.repartition(5), labels.repartition(3))
    assert np.array_equal(again.w, machine.w) and np.array_equal(again.v, machine.v)


def fill(sizes, weights, total):
    """Water-filling by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped = set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        rest = [s for s in order if s not in capped]
        want = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if want[s] > 2 * sizes[s]}
        if not over:
            return want | {s: 2 * sizes[s] for s in capped}
        capped |= over


def test_mixing(spark, empty):
    rng = np.random.Generator(np.random.PCG64(6))
    rows = [(k, [None, "a", "b", "ć", "z"][k % 5] if k > 400 else "hot", int(rng.lognormal(4, 1))) for k in range(1000)]
    rows += [(k, "tiny", 0) for k in range(1000, 1003)] + [(None, "a", 7), (3, "a", 9), (3, "a", 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mixed(df, [5, 2, 1]).join(df.select("doc_id", "source").distinct(), "doc_id").collect()
    sizes = collections.Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = fill(sizes, [5, 2, 1], 1.5 * sum(sizes.values()))
    again = sorted(map(tuple, mixing.mixed(df.repartition(7), [5, 2, 1]).select("doc_id", "taken").collect()), key=str)
    assert again == sorted(map(tuple, mixing.mixed(df, [5, 2, 1]).select("doc_id", "taken").collect()), key=str)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    unique = [r for r in got if r["doc_id"] != 3]
    for r in unique:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9) and r["source_size"] == sizes[r["source"]]
    taken = collections.Counter()
    for r in unique:
        taken[r["source"]] += r["taken"]
    for s in ("b", "ć", "z", None, "hot"):
        assert taken[s] == pytest.approx(want[s], rel=0.03, abs=40)
    assert mixing.mixed(empty.select("doc_id", "source", F.size(words(F.col("text"))).alias("size")), [1]).collect() == []


def tiny_vocabulary():
    plain = ["▁", "a", "b", "c", "ab", "▁a", "bc", "abc", "▁ab", "▁▁", "cc", "▁abc"]
    pieces = ["<unk>", "<s>", "</s>", *(f"<0x{k:02X}>" for k in range(256)), *plain]
    scores = [0.0] * 259 + [-100.0] * 4 + [-1.0, -2.0, -0.5, -3.0, -4.0, -9.0, -9.0, -5.0]
    return sentencepieces.Vocabulary(pieces, scores, ["other"] * 3 + ["byte"] * 256 + ["normal"] * len(plain))


def merged(v, t):
    """Merging by the book."""
    if not t:
        return []
    score = {v.pieces[i]: v.rank[i] for i in v.normal}
    s = list("▁" + t.replace(" ", "▁"))
    while pairs := [(score[s[k] + s[k + 1]], k) for k in range(len(s) - 1) if s[k] + s[k + 1] in score]:
        _, k = min(pairs)
        s[k : k + 2] = [s[k] + s[k + 1]]
    at = {p: i for i, p in enumerate(v.pieces)}
    return [x for p in s for x in ([at[p]] if p in score else [v.bytes[b] for b in p.encode()])]


def test_pieces_against_merging(spark, docs, empty):
    v = tiny_vocabulary()
    rng = np.random.Generator(np.random.PCG64(8))
    texts = ["".join(rng.choice(list("abc abcab \né☃"), rng.integers(0, 90))) for _ in range(300)] + ["", "abc" * 100, " " * 70]
    ids, ends = sentencepieces.Encoder(v).encode([*texts, None])
    got = [ids[a:b].tolist() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
    assert got == [*(merged(v, t) for t in texts), []]
    d = sentencepieces.Decoder(v)
    assert [d.decode(x) for x in got] == [*texts, ""]
    rows = sentencepieces.coded(docs, v)
    assert sorted(((r["doc_id"], r["decoded"]) for r in rows.collect()), key=str) == sorted(((r[0], r[1] or "") for r in ROWS), key=str)
    assert {r["text"] for r in sentencepieces.decoded(rows, v).collect()} == {r[1] or "" for r in ROWS}
    assert sentencepieces.coded(empty, v).collect() == []


def test_pieces_against_the_library():
    path = "/opt/tokenizers/piece_bpe_32k.model"
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=path)
    e = sentencepieces.Encoder(sentencepieces.Vocabulary.load(path))
    texts = [r[1] or "" for r in ROWS] + ["  two  spaces ", "naïve ☃\t\n", "<s>x</s>", "a" * 500]
    ids, ends = e.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)] == [sp.encode(t) for t in texts]


def test_surrogates():
    s = surrogates.Surrogates(b"k")
    t = ('Write to bob.07@mail1.example.com or BOB.07@mail1.example.com, call +1 (212) 555-0199 or 212-555-0199 from 10.1.2.3, pay 4532015112830366, '
         'token = "59b79a44c83160ff605db5295c3f1b8f59a30bf7" ssn 123-45-6789. Mr. John Smith met Dr. Иван; Smith left. Mrs. Mary Smith stayed.')
    new, spans = s.replace(t)
    by = collections.defaultdict(list)
    for x in spans:
        by[x["kind"]].append((t[x["start"] : x["end"]], x["surrogate"]))
    assert {k: len(v) for k, v in by.items()} == {"email": 2, "phone": 2, "ip": 1, "card": 1, "secret": 1, "ssn": 1, "name": 6}
    assert all(a not in new.split() and len(a) == len(b) or k in ("name", "ip") for k, v in by.items() for a, b in v)
    assert by["email"][0][1].lower() == by["email"][1][1].lower() and by["email"][0][1].endswith(".example.com")
    digits = lambda x: re.sub(r"\D", "", x)[-10:]
    assert digits(by["phone"][0][1]) == digits(by["phone"][1][1])
    assert surrogates.luhn(by["card"][0][1])
    names = dict(by["name"])
    assert names["John"] in surrogates.NAMES["latin m"] and names["Mary"] in surrogates.NAMES["latin f"]
    assert new.count(names["Smith"]) == 3 and names["Иван"] in surrogates.NAMES["cyrillic m"]
    assert s.replace(t) == (new, spans) != surrogates.Surrogates(b"l").replace(t)
    assert s.replace(None) == (None, []) and s.replace("nothing here 12 v2.0") == ("nothing here 12 v2.0", [])


def test_surrogates_are_distinct():
    p = surrogates.Permutations(b"k")
    assert len({p.string(f"{k:04d}", ["0123456789"], "t") for k in range(10000)}) == 10000
    s = surrogates.Surrogates(b"k")
    assert len({s.surrogate("name", n) for g in surrogates.NAMES.values() for n in g}) == sum(map(len, surrogates.NAMES.values()))


def test_surrogates_of_a_table(docs, empty):
    rows = surrogates.replaced(docs, b"k")
    assert rows.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in rows.collect()), key=str) == sorted(((r[0], r[1]) for r in ROWS), key=str)
    assert surrogates.replaced(empty, b"k").collect() == []


def test_sizes_of_texts_are_whole(docs):
    assert docs.where("doc_id = 8").select(F.size(words(F.col("text")))).collect()[0][0] == len(text(8, 20000).split())
