"""Lineage forests and tracks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronovox.operators.checkpoints import stored

def along() -> WindowSpec:
    return Window.partitionBy("track").orderBy("t")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def with_mother(nodes: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """nodes with mother_id and the mother's columns (suffix _m); -1 where there is none."""
    mothers = nodes.select(F.col("id").alias("mother_id"), *[F.col(c).alias(f"{c}_m") for c in columns])
    out = nodes.join(edges.select(F.col("dst").alias("id"), F.col("src").alias("mother_id")), "id", "left").join(mothers, "mother_id", "left")
    return out.select("id", *columns, *[F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in ["mother_id", *[f"{c}_m" for c in columns]]])


def to_root(edges: DataFrame) -> DataFrame:
    """id, root, depth for every end of an edge (src, dst; one src a dst), by pointer doubling: log2(depth) joins. A
    cycle has no root and raises an error."""
    up = edges.select(F.col("dst").alias("id"), F.col("src").alias("up"), F.lit(1).cast("long").alias("depth"))
    tops = edges.select(F.col("src").alias("id")).distinct().join(up.select("id"), "id", "left_anti")
    up = stored(up.unionByName(tops.select("id", F.col("id").alias("up"), F.lit(0).cast("long").alias("depth"))))
    for _ in range(up.count().bit_length() + 1):  # ways double each round: only those round a cycle are longer
        above = up.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        new = stored(up.join(above, "up").select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        up = new.drop("moved")
        if new.where("moved").isEmpty():
            return up.select("id", F.col("up").alias("root"), "depth")
    raise ValueError("the edges hold a cycle")


def ancestor_steps(tracks: DataFrame, steps: int) -> DataFrame:
    """track, t, id, line: the ids of the 0- to steps-step ancestors, clamped at the root."""
    first = F.first("id").over(along().rowsBetween(Window.unboundedPreceding, 0))
    return tracks.select("track", "t", "id", F.array(*[F.coalesce(F.lag("id", k).over(along()), first) if k else F.col("id") for k in range(steps + 1)]).alias("line"))


def displacement(tracks: DataFrame) -> DataFrame:
    return tracks.select("track", "t", "id", (F.col("v") - F.lag("v").over(along())).alias("dv"))


def closing(tracks: DataFrame, flag: Column, radius: int = 5) -> DataFrame:
    """tracks with kept: a one-dimensional closing of the flag along each track, clamped at its ends."""
    w = along().rowsBetween(-radius, radius)
    grown = tracks.withColumn("grown", F.max(flag.cast("int")).over(w))
    return grown.withColumn("kept", F.min("grown").over(w)).drop("grown")


def smoothed(tracks: DataFrame, sigma: float = 5.0, radius: int = 20) -> DataFrame:
    """track, t, smooth: a Gaussian over the track's detections in order of t, mirrored at its ends (the end itself counts
    twice). What mirrors point at lies within `radius` rows, so one window of that width holds all that a row needs."""
    near = F.collect_list(F.struct("v")).over(along().rowsBetween(-radius, radius))
    rows = tracks.select("track", "t", near.alias("near"), (F.row_number().over(along()) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("track")).cast("int").alias("n"))
    folded = lambda o: F.pmod(F.col("k") + o, 2 * F.col("n"))
    place = lambda o: F.when(folded(o) < F.col("n"), folded(o)).otherwise(2 * F.col("n") - 1 - folded(o)) - F.greatest(F.col("k") - radius, F.lit(0))
    weights = {o: math.exp(-0.5 * o * o / sigma**2) for o in range(-radius, radius + 1)}
    parts = F.array(*[F.get("near", place(o))["v"] * w for o, w in weights.items()])
    return rows.select("track", "t", (F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / sum(weights.values())).alias("smooth"))


def filled(tracks: DataFrame) -> DataFrame:
    """track, t, v with the frames between two detections filled by linear interpolation."""
    nxt = tracks.select("track", "t", "v", F.lead("t").over(along()).alias("t2"), F.lead("v").over(along()).alias("v2"))
    steps = nxt.withColumn("s", F.explode(F.expr("IF(t2 IS NULL, array(t), sequence(t, t2 - 1))")))
    return steps.select("track", F.col("s").alias("t"), F.when(F.col("t2").isNull(), F.col("v")).otherwise(
        F.col("v") + (F.col("v2") - F.col("v")) * (F.col("s") - F.col("t")) / (F.col("t2") - F.col("t"))).alias("v"))


def nearest_in_time(left: DataFrame, right: DataFrame) -> DataFrame:
    """track, t, near: the t of right nearest to each t of left in its track; the earlier of equals. Two window scans over
    the union of both sides: no row meets more than its neighbours."""
    both = left.select("track", "t", F.lit(None).cast("long").alias("k")).unionByName(right.select("track", "t", F.col("t").alias("k")))
    order = Window.partitionBy("track").orderBy("t")
    before = F.last("k", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.last("k", ignorenulls=True).over(Window.partitionBy("track").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0))
    near = both.withColumns({"b": before, "a": after}).where("k IS NULL")
    return near.select("track", "t", F.when(F.col("b").isNull() | (F.col("a") - F.col("t") < F.col("t") - F.col("b")), F.col("a")).otherwise(F.col("b")).alias("near"))


def fused(nodes: DataFrame, into: Column) -> DataFrame:
    """Nodes fused to their mean position: id, x, y, z, n."""
    return nodes.groupBy(into.alias("id")).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n"))
