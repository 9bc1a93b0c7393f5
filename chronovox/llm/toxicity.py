"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x the damped count of a term. The pairwise part
learns what an additive model misses: that an insult beside a group's mention, or a second insult, weighs more than
either alone. Terms are words and their stems (first letters, as many as STEMS says), so that inflected and compounded
forms of a marking word count together. Terms are hashed. Buckets get parameters if they tell labels apart alone (their
document frequency differs between the labels) or beside another word (documents with both have another share of label 1
than those with either): what matters in pairs only is kept too, and what matters in neither way can't drown it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.llm.common import bounded_sample, stored

BUCKETS = 1 << 20
STEMS = (3, 4, 5, 6, 7)
_TERM = re.compile(r"[^\W_]+")
_hash = xxhash.xxh64_intdigest


def _buckets(word: str) -> list[int]:
    """Of a word and its stems. No word holds the mark of a stem."""
    whole, letters = word.encode("utf-8", "surrogatepass"), len(word)
    if len(whole) == letters:
        forms = [whole, *[whole[:k] + b"*" for k in STEMS if letters > k]]
    else:
        forms = [whole, *[word[:k].encode("utf-8", "surrogatepass") + b"*" for k in STEMS if letters > k]]
    return [_hash(f, 11) % BUCKETS for f in forms]


_kept_buckets = lru_cache(1 << 15)(_buckets)


def terms(text: str | None) -> dict[int, int]:
    """Bucket -> count over the whole text."""
    out: dict[int, int] = {}
    for word, n in Counter(_TERM.findall((text or "").lower())).items():
        for k in _kept_buckets(word):
            out[k] = out.get(k, 0) + n
    return out


Bag = tuple[np.ndarray, np.ndarray]


def _words(text: str | None) -> np.ndarray:
    """Buckets of the whole words."""
    return np.unique(np.fromiter((_kept_buckets(w)[0] for w in set(_TERM.findall((text or "").lower()))), "<i4"))


def bag(counts: dict[int, int]) -> Bag:
    """Buckets, ascending, and their counts."""
    ids, n = np.fromiter(counts, "<i4", len(counts)), np.fromiter(counts.values(), "<i4", len(counts))
    order = np.argsort(ids)
    return ids[order], n[order]


class Machine:
    """buckets: sorted, those with parameters."""

    def __init__(self, buckets: np.ndarray, factors: int, seed: int = 1):
        self.buckets = buckets
        self.index = np.full(BUCKETS, -1, dtype=np.int32)
        self.index[buckets] = np.arange(len(buckets))
        self.used = frozenset(buckets.tolist())
        self.known: dict[str, tuple[int, ...]] = {}
        rng = np.random.Generator(np.random.PCG64(seed))
        self.w0 = 0.0
        self.w = np.zeros(len(buckets) + 1)
        self.v = rng.normal(0, 0.05, size=(len(buckets) + 1, factors))
        self.w[-1], self.v[-1] = 0, 0

    def features(self, bags: list[Bag]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, parameter of each entry, value of each entry). A document without known terms has one zero entry."""
        owner = np.repeat(np.arange(len(bags)), [len(ids) for ids, _ in bags])
        which = self.index[np.concatenate([ids for ids, _ in bags])].astype(np.int64)
        value = 1.0 + np.log(np.concatenate([n for _, n in bags]))
        known = which >= 0
        none = np.flatnonzero(np.bincount(owner[known], minlength=len(bags)) == 0)
        owner = np.r_[owner[known], none]
        order = np.argsort(owner, kind="stable")
        which = np.r_[which[known], np.full(len(none), len(self.buckets))][order]
        value = np.r_[value[known], np.zeros(len(none))][order]
        return np.searchsorted(owner[order], np.arange(len(bags))), which, value

    def margin(self, offsets, which, value):
        xv = self.v[which] * value[:, None]
        sums = np.add.reduceat(xv, offsets)
        pairs = 0.5 * (np.square(sums).sum(axis=1) - np.add.reduceat(np.square(xv).sum(axis=1), offsets))
        return self.w0 + np.add.reduceat(self.w[which] * value, offsets) + pairs, sums

    def terms(self, text: str | None) -> dict[int, int]:
        """Those of terms() that have parameters. What words came to is kept for a while."""
        out: dict[int, int] = {}
        for word, n in Counter(_TERM.findall((text or "").lower())).items():
            own = self.known.get(word)
            if own is None:
                if len(self.known) >= 1 << 18:
                    self.known.clear()
                own = self.known[word] = tuple([k for k in _buckets(word) if k in self.used])
            for k in own:
                out[k] = out.get(k, 0) + n
        return out

    def score(self, docs: list[dict[int, int]]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(*self.features([bag(d) for d in docs]))[0], -30, 30)))

    def fit(self, bags: list[Bag], y: np.ndarray, epochs: int = 40, rate: float = 0.1, decay: float = 3e-4, batch: int = 256, seed: int = 2) -> None:
        """Adagrad on the log loss, with decaying parameters."""
        offsets, which, value = self.features(bags)
        ends = np.r_[offsets[1:], len(which)]
        gw0, gw, gv = 1e-6, np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        self.w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        rng = np.random.Generator(np.random.PCG64(seed))
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                lengths = ends[own] - offsets[own]
                start = np.r_[0, np.cumsum(lengths)[:-1]]
                at = np.repeat(offsets[own] - start, lengths) + np.arange(lengths.sum())
                i, x = which[at], value[at]
                z, sums = self.margin(start, i, x)
                g = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y[own]
                each = np.repeat(g, lengths) * x
                dv = each[:, None] * (np.repeat(sums, lengths, axis=0) - self.v[i] * x[:, None])
                used, back = np.unique(i, return_inverse=True)
                aw = np.bincount(back, each, len(used)) / len(own) + decay * self.w[used] / 10
                av = np.zeros((len(used), self.v.shape[1]))
                np.add.at(av, back, dv)
                av = av / len(own) + decay * self.v[used]
                gw[used] += aw * aw
                gv[used] += av * av
                self.w[used] -= rate * aw / np.sqrt(gw[used])
                self.v[used] -= rate / 4 * av / np.sqrt(gv[used])
                self.w[-1], self.v[-1] = 0, 0
                d0 = g.mean()
                gw0 += d0 * d0
                self.w0 -= rate * d0 / np.sqrt(gw0)


def _differing(bags: DataFrame, n: dict[int, int], least_z: float) -> np.ndarray:
    """Buckets whose document frequency differs between the labels by least_z standard errors, in 4 documents at least;
    none without both labels."""
    if not n.get(0) or not n.get(1):
        return np.zeros(0, dtype=np.int64)
    counts = bags.select("toxic", F.explode("buckets").alias("k")).groupBy("k").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
    pooled = F.col("all") / float(n[0] + n[1])
    gap = F.abs(F.col("bad") / float(n[1]) - (F.col("all") - F.col("bad")) / float(n[0]))
    z = gap / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n[0] + 1 / n[1]))
    return np.array(sorted(r["k"] for r in counts.where((F.col("all") >= 4) & (z >= least_z)).select("k").collect()), dtype=np.int64)


#: Pairs are counted in so many buckets first, and those of buckets that differ by the second number of standard errors
#: exactly; pairs are in so many documents at least.
PAIRS, APART, TOGETHER = 1 << 21, 6.0, 16


def _pair_buckets(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first, second, bucket) of all pairs of ascending words, some at a time."""
    step = max(1, (1 << 18) // max(1, len(words)))
    for k in range(0, len(words), step):
        i, j = np.triu_indices(min(step, len(words) - k), 1, len(words) - k)
        a, b = words[i + k], words[j + k]
        mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xD1B54A32D192ED03)
        yield a, b, (mixed >> np.uint64(64 - 21)).astype(np.int64)


def _interacting(bags: DataFrame, n: dict[int, int]) -> np.ndarray:
    """Buckets of words that, beside another one, have another share of label 1 than both have alone, by APART standard
    errors. Counting pairs takes time with the square of a document's frequent words; a table of PAIRS counts a task and
    label, and the pairs of buckets that differ, are all that leaves the tasks."""
    if not n.get(0) or not n.get(1):
        return np.zeros(0, dtype=np.int64)
    spark = bags.sparkSession
    each = bags.select("toxic", F.explode("words").alias("k")).groupBy("k").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all")).where(F.col("all") >= TOGETHER)
    each = stored(each)
    frequent = np.zeros(BUCKETS, bool)
    frequent[[r["k"] for r in each.select("k").toLocalIterator()]] = True
    shared = spark.sparkContext.broadcast(frequent)
    held = bags.select("toxic", "words")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, PAIRS), "<i4")
        waiting: list[list[np.ndarray]] = [[], []]
        sizes = [0, 0]

        def added(label: int) -> None:
            if sizes[label]:
                out[label] += np.bincount(np.concatenate(waiting[label]), minlength=PAIRS).astype("<i4")
            waiting[label], sizes[label] = [], 0

        for b in batches:
            for label, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.asarray(words.values)
                for _, _, at in _pair_buckets(own[shared.value[own]]):
                    waiting[label].append(at)
                    sizes[label] += len(at)
                    if sizes[label] >= PAIRS:
                        added(label)
        added(0)
        added(1)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["counts"])

    total = np.zeros((2, PAIRS))
    for r in held.repartition(4).mapInArrow(counted, "counts binary").toLocalIterator():  # one after another: a table is large
        total += np.frombuffer(r["counts"], "<i4").reshape(2, PAIRS)
    share = total.sum(0) / (n[0] + n[1])
    apart = np.abs(total[1] / n[1] - total[0] / n[0]) >= APART * np.sqrt(np.maximum(share, 1e-12) * (1 / n[0] + 1 / n[1]))
    differ = spark.sparkContext.broadcast(apart & (total.sum(0) >= TOGETHER))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.asarray(words.values)
                for i, j, at in _pair_buckets(own[shared.value[own]]):
                    some = differ.value[at]
                    if some.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), label, np.int32)), pa.array(i[some].astype(np.int32)), pa.array(j[some].astype(np.int32))], ["toxic", "i", "j"])

    both = held.mapInArrow(pairs, "toxic int, i int, j int").groupBy("i", "j").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all")).where(F.col("all") >= TOGETHER)
    for c in "ij":
        both = both.join(F.broadcast(each.select(F.col("k").alias(c), F.col("bad").alias(f"bad_{c}"), F.col("all").alias(f"all_{c}"))), c)
    alone = lambda c: (F.col(f"bad_{c}") + 0.5) / (F.col(f"all_{c}") + 1.0)
    far = lambda c: F.abs(F.col("bad") / F.col("all") - alone(c)) >= APART * F.sqrt(alone(c) * (1 - alone(c)) / F.col("all"))
    found = both.where(far("i") & far("j")).select(F.explode(F.array("i", "j")).alias("k")).distinct()
    return np.array(sorted(r["k"] for r in found.toLocalIterator()), dtype=np.int64)


def train(rows: DataFrame, labels: DataFrame | None = None, max_rows: int = 10_000, least_z: float = 3.0, factors: int = 8) -> Machine:
    """rows: doc_id, text; labels: doc_id, toxic. Without labels, rows has toxic too. Rows whose toxic is neither 0 nor 1
    don't count, nor, with labels, null ids; a null text is empty.

    About max_rows labelled rows of each label are used, those of least hash of the id, in full; all if there are
    fewer. With labels, these are sampled before they meet any text: each pair of id and label counts once, so at most
    about 2 * max_rows pairs are broadcast at any size, and texts are scanned where they lie. Copies count once: of
    rows whose terms and counts all agree, one of each label stays. Terms stay on the executors; the driver gets the
    buckets that tell labels apart, alone by least_z standard errors or in pairs (at most BUCKETS numbers), and of each
    sampled row its counts in these. Texts of any length are learned whole. The intercept is
    moved from the sample's share of label 1 to that of all labels. Without both labels the score is a constant."""
    marked = (rows if labels is None else labels).where("toxic IN (0, 1)").withColumn("toxic", F.col("toxic").cast("int"))
    if labels is not None:
        marked = marked.where("doc_id IS NOT NULL").select("doc_id", "toxic").distinct()
    share = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                ids, n = bag(terms(text.as_py()))
                same = xxhash.xxh128_digest(ids.tobytes() + n.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([same]), pa.array([ids], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int32())), pa.array([_words(text.as_py())], pa.list_(pa.int32()))], ["toxic", "same", "buckets", "counts", "words"])

    sample = bounded_sample(marked, "toxic", "doc_id", max_rows)
    if labels is not None:
        sample = rows.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    bags = sample.select("text", "toxic").mapInArrow(run, "toxic int, same binary, buckets array<int>, counts array<int>, words array<int>")
    bags = stored(bags.dropDuplicates(["toxic", "same"]))
    n = {r["toxic"]: r["count"] for r in bags.groupBy("toxic").count().collect()}
    machine = Machine(np.union1d(_differing(bags, n, least_z), _interacting(bags, n)), factors)
    shared = rows.sparkSession.sparkContext.broadcast(machine.index)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, same, ids, counts in zip(*[b.column(k) for k in range(4)], strict=True):
                ids, counts = (np.asarray(x.values, dtype="<i4") for x in (ids, counts))
                some = shared.value[ids] >= 0
                yield pa.RecordBatch.from_arrays([pa.array([label.as_py()], pa.int32()), pa.array([same.as_py()]), pa.array([ids[some].tobytes()]), pa.array([counts[some].tobytes()])], ["toxic", "same", "buckets", "counts"])

    found = sorted(map(tuple, bags.drop("words").mapInArrow(known, "toxic int, same binary, buckets binary, counts binary").collect()))
    y = np.array([r[0] for r in found], dtype=np.float64)
    if len(machine.buckets):
        machine.fit([(np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], "<i4")) for r in found], y)
    odds = lambda a, b: np.log((a + 1) / (b + 1))
    machine.w0 += odds(share.get(1, 0), share.get(0, 0)) - odds(n.get(1, 0), n.get(0, 0))
    return machine


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row; null and empty texts have the score of a text without known terms. Texts of any
    length are scored whole, a thousand rows at a time; repeated rows come out repeated, other columns are left out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                own = b.slice(k, 1000)
                score = shared.value.score([shared.value.terms(t.as_py()) for t in own.column(1)])
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")
