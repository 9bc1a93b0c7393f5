"""Changes of a lineage: nodes added, removed and fused, ways to a reference frame, labels carried along.

nodes: id, t, x, y, z; edges: src, dst. Tables are never changed in place: each operator returns new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronovox.operators.checkpoints import stored

PLACE = ["x", "y", "z"]


def added(nodes: DataFrame, edges: DataFrame, new: DataFrame, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes and edges with new (k, t, x, y, z, of): each gets the next id after the largest, in order of k, and an edge
    from the node `of` (to it, if `reverse`); a null `of` makes a root. k tells the new nodes apart."""
    largest = nodes.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("__top"))
    # Ranks over ranges: the rows of a range are numbered inside it, ranges by their counts.
    ranged = stored(new.repartitionByRange(F.col("k")).withColumn("__r", F.spark_partition_id()))
    ahead = ranged.groupBy("__r").agg(F.count(F.lit(1)).alias("n")).select("__r", F.coalesce(F.sum("n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__r").orderBy("k")) + F.col("__before")
    named = stored(ranged.join(ahead, "__r").crossJoin(F.broadcast(largest)).withColumn("id", F.col("__top") + rank))
    more = named.where("of IS NOT NULL").select(*([F.col("id").alias("src"), F.col("of").alias("dst")] if reverse else [F.col("of").alias("src"), F.col("id").alias("dst")]))
    return nodes.select("id", "t", *PLACE).unionByName(named.select("id", "t", *PLACE)), edges.select("src", "dst").unionByName(more)


def removed(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without the nodes of gone (id) and all edges at them."""
    gone = gone.select("id").distinct()
    left = edges.select("src", "dst").join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select("src", "dst")


def merged(nodes: DataFrame, edges: DataFrame, into: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges after fusing: into (id, new) names the node that each becomes (itself if it isn't there). A fused
    node stands at the mean place, in the frame of the node whose id it has; edges follow, once each, and edges inside a
    fused node go."""
    to = lambda c: into.select(F.col("id").alias(c), F.col("new").alias(f"__{c}"))
    moved = edges.select("src", "dst").join(to("src"), "src", "left").join(to("dst"), "dst", "left").select(F.coalesce("__src", "src").alias("src"), F.coalesce("__dst", "dst").alias("dst"))
    named = nodes.join(to("id"), "id", "left").withColumn("new", F.coalesce("__id", "id"))
    frame = F.max(F.when(F.col("id") == F.col("new"), F.col("t")))
    fused = named.groupBy("new").agg(F.coalesce(frame, F.min("t")).alias("t"), *[F.avg(c).alias(c) for c in PLACE], F.count(F.lit(1)).alias("n"))
    return fused.withColumnRenamed("new", "id"), moved.where("src <> dst").distinct()


def close_pairs(near: DataFrame, density: DataFrame, share: float = 0.5) -> DataFrame:
    """id, new: of nodes that are each other's nearest (near: a, b, d) at less than `share` times the density (id, density)
    of either, the one of larger id becomes the other. Every node is in one pair at most, so fusing needs no rounds."""
    limit = density.select(F.col("id").alias("a"), (F.col("density") * share).alias("most"))
    tight = near.join(limit, "a").where("d < most").select("a", "b")
    return tight.join(tight.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).where("a < b").select(F.col("b").alias("id"), F.col("a").alias("new"))


def at_frame(nodes: DataFrame, edges: DataFrame, frame: int) -> DataFrame:
    """id, t, ref: the node of `frame` that a node's line leads to: up the mothers from later frames, down the first
    daughters (of least id) from earlier ones; none if the line ends before. Lines double: as many rounds as the logarithm
    of the frames."""
    t = nodes.select("id", "t")
    first = edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("to"))
    above = edges.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("to"))
    step = t.where(F.col("t") < frame).join(first, "id", "left").unionByName(t.where(F.col("t") > frame).join(above, "id", "left"))
    step = step.unionByName(t.where(F.col("t") == frame).withColumn("to", F.col("id")))
    side = nodes.select(F.col("id").alias("to"), F.signum((F.lit(frame) - F.col("t")).cast("double")).alias("side"))
    # A step that passes the frame leads nowhere.
    own = step.join(side, "to", "left").withColumn("to", F.when((F.col("side") == 0) | (F.col("side") == F.signum((F.lit(frame) - F.col("t")).cast("double"))), F.col("to"))).select("id", "t", "to")
    now = stored(own)
    while True:
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("next"))
        new = stored(now.join(ahead, "to", "left").select("id", "t", F.col("next").alias("to"), F.coalesce(F.col("next") != F.col("to"), F.col("to").isNotNull()).alias("moved")))
        now = new.select("id", "t", "to")
        if new.where("moved").isEmpty():
            return now.where("to IS NOT NULL").select("id", "t", F.col("to").alias("ref"))


def stabilised(nodes: DataFrame, edges: DataFrame, density: DataFrame) -> DataFrame:
    """id, t, x, y, z: each frame moved by the mean way of its nodes to their lines' nodes in the median frame, weighted by
    density (id, density). The median of frames' numbers must be a frame's; frames without lines stay."""
    frames = nodes.select("t").distinct()
    middle = frames.agg(F.percentile(F.col("t").cast("double"), F.lit(0.5)).alias("m")).collect()[0]["m"]
    if middle is None or middle != int(middle) or frames.where(F.col("t") == int(middle)).isEmpty():
        return nodes.select("id", "t", *PLACE)
    ref = at_frame(nodes, edges, int(middle)).where(F.col("t") != int(middle))
    at = lambda key, p: nodes.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}{c}") for c in PLACE])
    way = ref.join(at("id", "o"), "id").join(at("ref", "r"), "ref").join(density.select("id", "density"), "id")
    mean = way.groupBy("t").agg(*[(F.sum(F.col("density") * (F.col(f"r{c}") - F.col(f"o{c}"))) / F.sum("density")).alias(f"d{c}") for c in PLACE])
    return nodes.join(mean, "t", "left").select("id", "t", *[(F.col(c) + F.coalesce(f"d{c}", F.lit(0.0))).alias(c) for c in PLACE])


def carried_labels(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, label: nodes that exactly one label reaches. seeds: id, label (a node may have several); a label goes from a seed
    to all its descendants and to all its ancestors, but not from these down again. Each round labels go over ways of twice
    as many edges as before, so rounds grow with the logarithm of the lines' length; a round's ways are as many as the pairs
    of nodes that lie so many edges apart: in a forest one a node at most."""
    seeds = seeds.select("id", "label").distinct()
    found = seeds
    for own, other in (("src", "dst"), ("dst", "src")):
        way = stored(edges.select(F.col(own).alias("id"), F.col(other).alias("to")).distinct())
        seen = stored(seeds)
        while True:
            new = stored(seen.join(way, "id").select(F.col("to").alias("id"), "label").distinct().join(seen, ["id", "label"], "left_anti"))
            if new.isEmpty():
                break
            seen = stored(seen.unionByName(new))
            way = stored(way.join(way.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")).distinct())
        found = found.unionByName(seen)
    return found.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("label")).where("n = 1").select("id", "label")
