"""Backward flow: the way of each cell's neighbourhood to the frame before, and tracks that follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronovox.operators import spatial
from chronovox.operators.checkpoints import stored


def both_ways(graph: DataFrame) -> DataFrame:
    """t, a, b of undirected edges, in both directions."""
    return graph.select("t", "a", "b").unionByName(graph.select("t", F.col("b").alias("a"), F.col("a").alias("b")))


def neighbour_weights(graph: DataFrame, edges: DataFrame, near: float = 4.0, far: float = 1.0, none: float = 0.0) -> DataFrame:
    """t, a, b, w for neighbours a, b of a frame's undirected graph: how well the links of b (edges: src, dst) go along with
    those of a. A mother of b counts `near` if it neighbours a mother of a, `far` if it shares a neighbour with one, else
    `none`; of several mothers the best counts. Daughters count likewise and are added up. An a whose weights are all 0 gives
    each neighbour 1."""
    g = both_ways(graph).distinct()
    hop = g.select(F.col("a").alias("p"), F.col("b").alias("q"), F.lit(1).alias("close"))
    two = hop.select("p", F.col("q").alias("m")).join(hop.select(F.col("p").alias("m"), "q"), "m").select("p", "q").distinct().withColumn("close", F.lit(0))
    tie = stored(hop.unionByName(two).groupBy("p", "q").agg(F.max("close").alias("close")))
    score = F.when(F.col("close") == 1, near).when(F.col("close") == 0, far).otherwise(none)

    def side(own: str, other: str, best: bool):
        """Each link of b against all links of a."""
        link = edges.select(F.col(own).alias("n"), F.col(other).alias("o"))
        pairs = g.join(link.select(F.col("n").alias("b"), F.col("o").alias("q")), "b").join(link.select(F.col("n").alias("a"), F.col("o").alias("p")), "a", "left")
        each = pairs.join(tie, ["p", "q"], "left").groupBy("a", "b", "q").agg(F.max(score).alias("s"))
        return each.groupBy("a", "b").agg((F.max("s") if best else F.sum("s")).alias("s"))

    back, on = side("dst", "src", True), side("src", "dst", False)
    w = g.join(back, ["a", "b"], "left").withColumnRenamed("s", "s1").join(on, ["a", "b"], "left").select(
        "t", "a", "b", (F.coalesce("s1", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))).alias("w"))
    most = w.groupBy("a").agg(F.max("w").alias("most"))
    return w.join(most, "a").select("t", "a", "b", F.when(F.col("most") == 0, 1.0).otherwise(F.col("w")).alias("w"))


def displacements(nodes: DataFrame, edges: DataFrame, weights: DataFrame, most: float = float("inf")) -> DataFrame:
    """id, dx, dy, dz for every node: the weighted medoid of its neighbours' ways to their mothers' mean place, of neighbours
    nearer than `most`; 0 where no neighbour has a mother."""
    at = nodes.select("id", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    mothers = edges.select(F.col("dst").alias("b"), F.col("src").alias("id")).join(at, "id").groupBy("b").agg(*[F.avg(f"p{c}").alias(f"m{c}") for c in "xyz"])
    way = mothers.join(at.withColumnRenamed("id", "b"), "b").select("b", *[F.col(f"p{c}") for c in "xyz"], *[(F.col(f"m{c}") - F.col(f"p{c}")).alias(c) for c in "xyz"])
    own = nodes.select(F.col("id").alias("a"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    gap = F.sqrt(sum(F.pow(F.col(f"p{c}") - F.col(f"o{c}"), 2) for c in "xyz"))
    v = stored(weights.join(way, "b").join(own, "a").where(gap < most).select(F.col("a").alias("g"), F.col("b").alias("i"), "w", "x", "y", "z"))
    chosen = spatial.medoid(v).select("g", "i").join(v, ["g", "i"]).select(F.col("g").alias("id"), *[F.col(c).alias(f"d{c}") for c in "xyz"])
    return nodes.select("id").join(chosen, "id", "left").select("id", *[F.coalesce(f"d{c}", F.lit(0.0)).alias(f"d{c}") for c in "xyz"])


def propagated(nodes: DataFrame, edges: DataFrame, last: int, first: int, n: int = 10, ratio: float = 1.25, most: float = float("inf"), graph: DataFrame | None = None) -> DataFrame:
    """track, t, x, y, z: tracks followed from frame `last` back to `first`.

    Tracks start at the nodes of the last frame, named by their id. A step moves each track by the displacement of the
    node nearest to it. Then nodes of the frame before whose distance to the nearest track exceeds `ratio` times their
    density start tracks of their own. All displacements and densities are computed at once; only the steps go frame by
    frame, and each is checkpointed. A frame without nodes leaves tracks where they are."""
    nodes = nodes.where(F.col("t").between(first, last)).select("id", "t", "x", "y", "z")
    graph = spatial.gabriel(nodes) if graph is None else graph
    moves = stored(displacements(nodes, edges, neighbour_weights(graph, edges), most))
    dense = stored(spatial.density(nodes, n))
    step = stored(nodes.where(F.col("t") == last).select(F.col("id").alias("track"), "t", "x", "y", "z"))
    parts = [step]
    for t in range(last, first, -1):
        near = spatial.knn(step.withColumnRenamed("track", "id"), nodes.where(F.col("t") == t), 1, itself=True).select(F.col("a").alias("track"), F.col("b").alias("id")).join(moves, "id").drop("id")
        moved = stored(step.join(near, "track", "left").select("track", F.lit(t - 1).cast(nodes.schema["t"].dataType).alias("t"), *[(F.col(c) + F.coalesce(f"d{c}", F.lit(0.0))).alias(c) for c in "xyz"]))
        here = nodes.where(F.col("t") == t - 1)
        reach = spatial.knn(here, moved.withColumnRenamed("track", "id"), 1, itself=True).select(F.col("a").alias("id"), "d")
        new = here.join(reach, "id", "left").join(dense.select("id", "density"), "id", "left").where(F.col("d").isNull() | (F.col("d") > ratio * F.col("density")))
        step = stored(moved.unionByName(new.select(F.col("id").alias("track"), "t", "x", "y", "z")))
        parts.append(step)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kept_tracks(tracks: DataFrame, nodes: DataFrame, radius: int = 5, reach: float = 1.0, n: int = 10) -> DataFrame:
    """tracks (track, t, x, y, z) with kept (0 or 1): places within `reach` densities of a node, closed along the track."""
    near = spatial.knn(tracks.select(F.col("track").alias("id"), "t", "x", "y", "z"), nodes, 1, itself=True).join(
        spatial.density(nodes, n).select(F.col("id").alias("b"), "density"), "b").select(F.col("a").alias("track"), "t", (F.col("d") <= reach * F.col("density")).cast("int").alias("flag"))
    w = Window.partitionBy("track").orderBy("t").rowsBetween(-radius, radius)
    grown = tracks.join(near, ["track", "t"], "left").withColumn("grown", F.max(F.coalesce("flag", F.lit(0))).over(w))
    return grown.withColumn("kept", F.min("grown").over(w)).drop("grown", "flag")
