"""Connected components of undirected graphs by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.operators.checkpoints import stored


def least_members(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of edges a-b, ascending, and the least member of each one's component."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        p, q = label[x], label[y]
        differ = p != q
        x, y, p, q = x[differ], y[differ], p[differ], q[differ]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (shorter := label[label]).tobytes() != label.tobytes():
            label = shorter
    return nodes, nodes[label]


def components(edges: DataFrame, small: int = 0) -> DataFrame:
    """node, root: for every end of an edge (a, b: bigint), a member of its component that all its members share.

    Rounds of contraction: each node joins the neighbour of least hash, or stays if its own is the least; edges are
    mapped to the joined nodes and deduplicated; then the rounds' maps are followed back. Hashes differ from round to
    round, so a fixed share of the nodes is expected to go in each, however they are linked: rounds grow with the
    logarithm of the nodes. A node with very many neighbours is one row of a pre-aggregated minimum. Once at most
    `small` edges are left, one task solves these."""
    maps = []
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while (n := edges.count()) > small:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
        to = stored(both.groupBy("node").agg(F.min(ranked("to")).alias("m")).select("node", F.least(F.col("m"), ranked("node"))["x"].alias("to")))
        maps.append(to)
        left = to.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        right = to.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        edges = stored(
            edges.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
    if n:
        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
            if ends:
                node, root = least_members(*(np.concatenate(x) for x in zip(*ends, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])

        out = stored(edges.coalesce(1).mapInArrow(solve, "node bigint, root bigint"))
    elif maps:
        out = maps.pop().withColumnRenamed("to", "root")
    else:
        out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while maps:
        after = out.select(F.col("node").alias("to"), "root")
        out = stored(maps.pop().join(after, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    return out


def named_by_least(edges: DataFrame, small: int = 1 << 18) -> DataFrame:
    """node, component: the least member of the component of every end of an edge (a, b: bigint)."""
    root = components(edges, small)
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    return root.join(least, "root").select("node", "component")
