"""Distinct entities keep distinct surrogates, spellings of one stay spellings of one, over classes that lie close."""

import random

import pytest
from conftest import SCHEMA

from chronovox.llm import queries, surrogates


@pytest.mark.parametrize("text", [
    "from 01.2.3.4 and 1.2.3.4 too", "Mr. John met Mr. JoHN today.", "api_key=o377o353 and api_key=8ca4e2d8", "", "Mr. ΑΘΑΝΆΣΙΟΣ met Mr. Αθανάσιος.",
    "token: deadbeef01 token: DEADBEEF01 token: DeadBeef01", 'secret = "0123456789abcdef0" secret = 0123456789abcdef0', "call +٤٩ 30 1234567 or +49 30 1234567", "Mr. ẞaab İlker ǅon"])
def test_texts_that_once_failed(text):
    s = surrogates.Surrogates(b"a key")
    new, found = s.replace(text)
    by = {}
    for f in found:
        by.setdefault((f["kind"], f["image"]), set()).add(f["entity"])
        assert f["image"] == s.entity(f["kind"], f["surrogate"]) and f["surrogate"] in new
    assert all(len(v) == 1 for v in by.values())


def test_spellings_are_one_entity():
    s = surrogates.Surrogates(b"a key")
    for text, n in (("from 01.2.3.4 and 1.2.3.4 too", 1), ("Mr. John met Mr. JoHN and Mr. JOHN.", 1), ("api_key=o377o353 and api_key=8ca4e2d8", 2), ("at a@b.org or A@B.org", 1),
                    ("card 4111 1111 1111 1111 is 4111111111111111", 1), ("2001:0db8:0000:0000:0000:ff00:0042:8329 is 2001:db8:0:0:0:ff00:42:8329", 1)):
        found = s.replace(text)[1]
        assert len({f["entity"] for f in found}) == len({f["image"] for f in found}) == n


def some(kind, rng):
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexes, mixed = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz"
    if kind == "ip":
        return ".".join(rng.choice(("", "0")) * (x < 100) + str(x) for x in (rng.randrange(256), rng.randrange(3), rng.randrange(256), rng.randrange(3)))
    if kind == "secret":
        while True:
            out = pick(rng.choice((hexes[:12], "abcdo012", mixed)), rng.choice((8, 8, 8, 9, 32)))
            out = rng.choice((str.lower, str.upper, lambda x: "".join(rng.choice((c, c.upper())) for c in x)))(out)
            if any(c.isdigit() for c in out) and any(c.isalpha() for c in out):
                return out
    if kind == "name":
        out = rng.choice(("", "Ann", "mar", "Jo", "pet")) + rng.choice(("a", "ia", "hn", "ra", "ova", "ски", "ιος")) if rng.random() < 0.5 else rng.choice(rng.choice(list(surrogates.NAMES.values())))
        out = out if rng.random() < 0.7 else pick("abeor", 3) + rng.choice(("", "a", "ova"))
        return rng.choice((str.title, str.upper, lambda x: x[0].upper() + "".join(rng.choice((c, c.upper())) for c in x[1:])))(out)
    if kind == "email":
        return f"{pick('ab1.'[:3], 2)}@{rng.choice(('', 'x.', 'exampla.'))}{rng.choice(('exampld.com', 'example.com', 'myexample.org', 'b.com', 'exemple.com'))}"
    if kind == "iban":
        return f"GB{rng.randrange(100):02d}{pick('0123', 4)}{pick('0123AB', 4)}{pick('01', 4)}"
    digits = pick("0123456789", {"card": rng.choice((13, 16)), "ssn": 9, "phone": rng.choice((7, 10, 12))}[kind])
    return f"{digits[:3]}-{digits[3:5]}-{digits[5:]}" if kind == "ssn" else digits


@pytest.mark.parametrize("kind", ["ip", "secret", "name", "email", "iban", "card", "ssn", "phone"])
def test_classes_do_not_meet(kind):
    """Small alphabets, so that images of neighbouring classes would meet often."""
    rng, s = random.Random(kind), surrogates.Surrogates(b"a key")
    image, back = {}, {}
    for _ in range(6000):
        text = some(kind, rng)
        a, b = surrogates.canonical(kind, text), surrogates.canonical(kind, s._surrogate(kind, text))
        assert image.setdefault(a, b) == b and back.setdefault(b, a) == a, text


def entity_rows():
    rng = random.Random(9)
    out = []
    for k in range(120):
        a, b = some("name", rng), some("name", rng)
        out.append((k, f"Mr. {a} (a{k % 40}@firm{k % 7}.org, {some('ip', rng)}) wrote api_key={some('secret', rng)} to Mrs. {b}, card 4111 1111 1111 1111, ssn {some('ssn', rng)}; {a} left.", "en", "a", 0))
    return [*out, (500, None, None, None, None), (501, "", "en", "a", 0), (502, "nothing here", "en", "b", 0)]


def test_the_query_on_a_table_full_of_entities(spark, tmp_path):
    table = entity_rows()
    spark.createDataFrame(table, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op3_pii_surrogates(spark, str(tmp_path)).collect()}
    assert sorted(got) == [r[0] for r in table]
    s, pairs = surrogates.Surrogates(queries.KEY), set()
    for k, t, *_ in table:
        text, last = "", 0
        for start, end, kind in s.find(t or ""):
            new = s._surrogate(kind, t[start:end])
            text += t[last:start] + new
            last = end
            pairs.add((kind, surrogates.canonical(kind, t[start:end]), surrogates.canonical(kind, new)))
        assert got[k]["text"] == (None if t is None else text + t[last:])
        assert [(e["start"], e["end"], e["kind"]) for e in got[k]["entities"] or []] == s.find(t or "")
        assert k >= 500 or got[k]["n_entities"] >= 4
    assert len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs}) > 400


def test_shared_surrogates_move_on(spark, monkeypatch):
    """With digests' luck out of reach, a permutation made to fail: two numbers get one surrogate."""
    rows = [(k, f"ssn 123-45-678{k % 3} here") for k in range(9)]
    plain = surrogates.Surrogates(b"k")
    images = [plain._surrogate("ssn", f"123-45-678{k}") for k in range(3)]
    moved = {plain.entity("ssn", "123-45-6780"): 1}
    out = surrogates.replaced(spark.createDataFrame(rows, "doc_id long, text string"), b"k", moved=moved).collect()
    for r in out:
        want = plain._surrogate("ssn", images[0]) if r["doc_id"] % 3 == 0 else images[r["doc_id"] % 3]
        assert r["text"] == f"ssn {want} here"
    calls = []
    honest = surrogates.collisions

    def once(found):
        calls.append(1)
        if len(calls) > 1:
            return honest(found)
        return found.sparkSession.createDataFrame([("ssn", "x", 2, ["0" * 16, plain.entity("ssn", "123-45-6780")])], "kind string, image string, n long, entities array<string>")

    monkeypatch.setattr(surrogates, "collisions", once)
    again = surrogates.distinct(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()
    assert len(calls) == 2 and sorted(r["text"] for r in again) == sorted(r["text"] for r in out)
