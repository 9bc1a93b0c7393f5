"""Words that matter in pairs only, with nothing to tell alone."""

import random

import numpy as np

from chronovox.llm import toxicity


def rows(n, rule, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for k in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = [rng.choice(words) for _ in range(12)] + ["alpha"] * a + ["omega"] * b
        rng.shuffle(text)
        out.append((k, " ".join(text), int(rule(a, b))))
    return out


def test_either_but_not_both(spark):
    machine = toxicity.train(spark.createDataFrame(rows(4000, lambda a, b: a != b), "doc_id long, text string, toxic int"))
    assert set(toxicity.terms("alpha omega")) & set(machine.buckets.tolist())
    texts = ["w1 w2 w3", "alpha w1 w2 w3", "omega w1 w2 w3", "alpha omega w1 w2 w3"]
    none, a, b, both = machine.score([machine.terms(t) for t in texts])
    assert min(a, b) > 0.8 and max(none, both) < 0.2


def test_pairs_are_all_and_once():
    words = np.array([3, 5, 8, 100, 2000], "<i4")
    found = [(int(i), int(j)) for a, b, _ in toxicity._pair_buckets(words) for i, j in zip(a, b)]
    assert sorted(found) == [(a, b) for k, a in enumerate([3, 5, 8, 100, 2000]) for b in [3, 5, 8, 100, 2000][k + 1 :]]
    (at,) = [x for _, _, x in toxicity._pair_buckets(words)]
    assert ((0 <= at) & (at < toxicity.PAIRS)).all() and list(toxicity._pair_buckets(words[:1]))[0][0].size == 0
    assert toxicity._words("Alpha, alpha omega").size == 2 and toxicity._words(None).size == 0
