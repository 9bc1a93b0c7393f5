"""Near copies by SimHash and Jaccard similarity: texts whose sets of 5-word shingles have 4/5 or more in common.

Candidates are found by SimHash: wide codes of the sets, bits that agree, bit planes (simhash.wide_links). A pair of
similarity 0.8 is missed with a probability of 6e-8, a more similar one less; sets of a few shingles more often (4 of 5 in
common: 3e-5). What is linked there is only a candidate: links are decided by the exact similarity of the whole sets (of
64-bit hashes of shingles).

Equal sets are one row beforehand, and candidates that hang together meet once. A group of more than `block` shingles is cut
into blocks that meet in pairs, so no task holds a large group; each piece returns a spanning forest of its links, never
all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.llm import simhash
from chronovox.llm.common import SMALL, joined_by_key, partitions, stored
from chronovox.operators.graphs import components

SIZE = 5
#: The least similarity of a link, as a fraction: exact in whole numbers.
LEAST = (4, 5)
BLOCK = 1 << 18


def shingles(text: str | None) -> np.ndarray:
    """The set of hashes of the 5-word shingles, ascending; A-Z count as lower case. A text of fewer words is one shingle,
    one without words has none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: both know ASCII only
    if not w:
        return np.zeros(0, dtype="<u8")
    runs = map(b" ".join, zip(*(w[k:] for k in range(SIZE)), strict=False)) if len(w) >= SIZE else iter([b" ".join(w)])
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 5) for s in runs), dtype="<u8", count=max(1, len(w) - SIZE + 1)))


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least row of its class, linked by similarities of LEAST or more. No set is empty."""
    n = len(sets)
    label = np.arange(n)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n < 2:
        return label
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(len(known), dtype=bool)
    for i in range(n - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        own = ids[starts[i] : starts[i + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[ids[starts[i + 1] :]].astype(np.int64), starts[i + 1 : -1] - starts[i + 1])
        mark[own] = False
        near = LEAST[1] * common >= LEAST[0] * (sizes[i] + sizes[i + 1 :] - common)
        joined = np.unique(np.r_[label[i], label[i + 1 :][near]])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return label


def near_copies(docs: DataFrame, id_col: str, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, component_id: the least doc_id that links of similarity 0.8 or more reach. Ids are never null, and rows of
    one id have one text. Texts without words are alike. Repeated rows come out repeated. Other columns are left out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, size, codes = [], [], []
            for x in b.column(1):
                own = shingles(x.as_py())
                same.append(int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 3)).view(np.int64)) if len(own) else 0)
                size.append(len(own))
                codes.append(simhash.code(own) if len(own) else None)
            name = [None if c is None else int.from_bytes(c[:8], "little", signed=True) for c in codes]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(same, pa.int64()), pa.array(size, pa.int64()), pa.array(name, pa.int64()), pa.array(codes, pa.binary())],
                ["doc_id", "same", "size", "name", "code"])

    found = stored(rows.mapInArrow(signed, f"doc_id {kind}, same bigint, size bigint, name bigint, code binary"))
    once = [F.first(c).alias(c) for c in ("size", "name", "code")]
    distinct = stored(found.groupBy("same").agg(F.min("doc_id").alias("least"), *once, F.count(F.lit(1)).alias("rows")))

    codes = stored(distinct.where("size > 0").select("code").distinct())
    near = components(simhash.wide_links(codes, simhash.apart(LEAST[0] / LEAST[1])), SMALL)
    spread = distinct.where("size > 0").join(near, F.col("name") == near.node, "left").select("same", "size", F.coalesce("root", "name").alias("key"))
    groups = stored(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all")).where("n > 1").select("key", "all"))
    met = stored(
        spread.join(groups, "key")
        .withColumn("pieces", F.expr(f"CAST(ceil(all / {block}) AS INT)"))
        .withColumn("mine", F.pmod(F.xxhash64("same", F.lit(9)), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.expr("IF(pieces = 1, array(0), sequence(0, pieces - 1))")))
        .select("same", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"))
    )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for same, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([same], pa.int64()), pa.array([shingles(text.as_py()).tobytes()])], ["same", "hashes"])

    asked = distinct.join(met.select("same").distinct(), "same", "left_semi").select("same", F.col("least").alias("doc_id"))
    sets = rows.join(asked, "doc_id").select("same", "text").dropDuplicates(["same"]).mapInArrow(whole, "same bigint, hashes binary")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, same, own = None, [], []

        def links() -> pa.RecordBatch:
            names, root = np.array(same, dtype=np.int64), linked(own)
            some = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[root[some]])], ["a", "b"])

        for b in batches:
            for bucket, name, hashes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if bucket != now:
                    if len(own) > 1:
                        yield links()
                    now, same, own = bucket, [], []
                same.append(name)
                own.append(np.frombuffer(hashes.as_py(), "<u8"))
        if len(own) > 1:
            yield links()

    pairs = met.join(sets, "same").select("bucket", "same", "hashes").repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    root = components(pairs.mapInArrow(compared, "a bigint, b bigint"), SMALL)
    classes = stored(distinct.join(root, distinct.same == root.node, "left").select("same", "least", "rows", F.coalesce("root", "same").alias("root")))
    lowest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(classes.join(lowest, "root").select("same", "component_id", "rows"))
    return joined_by_key(found.select("doc_id", "same"), named, "same").select("doc_id", "component_id")
