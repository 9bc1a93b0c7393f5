"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities, languages x hash buckets, of fixed width; it is broadcast, and a batch of
texts is scored in numpy: each n-gram adds its bucket's column, and only the buckets that occur are touched."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.llm.common import bounded_sample, group_sizes, remainder

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Texts are scored in pieces of about so many characters.
PIECE = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first text, last text, ...) in pieces: start of each text, bucket of each n-gram (orders x characters; BUCKETS
    where an n-gram would leave its text), letters of each text, index of the first text.

    White space, digits and symbols all count as one separator, so that only letters and word ends carry weight."""
    k = 0
    while k < len(texts):
        first, size = k, 0
        while k < len(texts) and (k == first or size + len(texts[k]) <= PIECE):
            size += len(texts[k])
            k += 1
        lowered = [t.lower() for t in texts[first:k]]
        lengths = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters()[codes]
        c = np.where(letter, codes, 32).astype(np.uint64)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(c))
        out = np.full((len(ORDERS), len(c)), BUCKETS, dtype=np.int32)
        for row, n in enumerate(ORDERS):
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, dtype=np.uint64)
            for j in range(n):
                h = (h ^ c[j : len(c) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            fits = left[: len(h)] >= n
            out[row, : len(h)][fits] = (h[fits] >> np.uint64(20)).astype(np.int64) % BUCKETS
        starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
        yield starts, out, _sums(letter.astype(np.float64), starts, lengths), first


def _sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each text's values; 0 for an empty one."""
    out = np.zeros(len(starts))
    some = np.flatnonzero(lengths)
    if len(some):
        out[some] = np.add.reduceat(values, starts[some])
    return out


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, docs: np.ndarray, smoothing: float = 0.5):
        """counts: languages x BUCKETS; docs: documents of each language."""
        self.languages = languages
        p = counts.astype(np.float64) + smoothing
        p = np.log(p / p.sum(axis=1, keepdims=True)) if len(languages) else p
        self.logp = np.zeros((len(languages), BUCKETS + 1), dtype=np.float32)
        self.logp[:, :BUCKETS] = p
        self.prior = np.log((docs + 1.0) / (docs.sum() + len(languages))) if len(languages) else np.zeros(0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and their posterior probabilities; `und` with 0 where a text is null or has no letter."""
        plain = [t or "" for t in texts]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for starts, out, letters, first in grams(plain):
            lengths = np.diff(np.r_[starts, out.shape[1]])
            total = np.stack([
                sum(_sums(table[row].astype(np.float64), starts, lengths) for row in out) for table in self.logp
            ]) + self.prior[:, None]
            best = total.argmax(axis=0)
            posterior = 1.0 / np.exp(total - total.max(axis=0)).sum(axis=0)
            for k in np.flatnonzero(letters > 0):
                names[first + k] = self.languages[best[k]]
                scores[first + k] = posterior[k]
        return names, scores


def train(rows: DataFrame, max_docs: int = 6000) -> Model:
    """rows: doc_id, text, lang. Rows of null text or language don't count.

    About max_docs documents a language are used, those of least hash of the id, in full; all if there are fewer. Every
    language is learned: the model has one row of BUCKETS numbers each. The numbers of
    documents of the languages are broadcast, and all documents are scanned where they lie; only the sample, bounded by
    max_docs a language, is dealt to 16 tasks or as many as there are languages, whose counts are added up by language, and
    the driver gets one sparse row a language. Texts of any length are learned whole; no rows make a model that knows nothing."""
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                docs[lang] = docs.get(lang, 0) + len(own)
                total = counts.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                for _, out, _, _ in grams(own):
                    total += np.bincount(out.ravel(), minlength=BUCKETS + 1)
        for lang, total in counts.items():
            some = np.flatnonzero(total[:BUCKETS])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([docs[lang]], pa.int64()), pa.array([some.astype("<i4").tobytes()]), pa.array([total[some].astype("<i8").tobytes()])],
                ["lang", "docs", "buckets", "counts"],
            )

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for ids, n in zip(table.column("buckets"), table.column("counts"), strict=True):
            total[np.frombuffer(ids.as_py(), "<i4")] += np.frombuffer(n.as_py(), "<i8")
        some = np.flatnonzero(total)
        return pa.table({"lang": table.column("lang").slice(0, 1), "docs": pa.array([pc.sum(table.column("docs")).as_py()], pa.int64()), "buckets": pa.array([some.astype("<i4").tobytes()]), "counts": pa.array([total[some].tobytes()])})

    schema = "lang string, docs bigint, buckets binary, counts binary"
    sizes = group_sizes(rows, "lang")
    sample = bounded_sample(rows, "lang", "doc_id", max_docs, sizes=sizes).select("text", "lang").repartition(max(16, len(sizes)))
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for r in sample.mapInArrow(run, schema).groupBy("lang").applyInArrow(added, schema).toLocalIterator():
        counts[r["lang"]] = total = np.zeros(BUCKETS, dtype=np.int64)
        total[np.frombuffer(r["buckets"], "<i4")] = np.frombuffer(r["counts"], "<i8")
        docs[r["lang"]] = r["docs"]
    languages = sorted(docs)
    return Model(languages, np.array([counts[x] for x in languages]).reshape(len(languages), BUCKETS), np.array([docs[x] for x in languages], dtype=np.float64))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row. An empty table gives an empty one; other columns are left out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(remainder(F.col("doc_id")) != 2).select("doc_id", "text", "lang")
