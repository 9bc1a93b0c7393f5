"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r in [0, most], the expected number of its copies. Among all rates whose words come to each
source's target, the ones of least relative entropy are r = min(most, exp(lambda * size / mean)) with one multiplier a
source; the multipliers maximise a concave dual, which Newton's method solves for all sources at once. The sums that an
iteration needs come from one aggregation over cells (source, size), so a hot source is pre-aggregated to its sizes.
Everything here is DataFrame code; the driver sees one number an iteration: whether all sources have converged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronovox.llm.common import in_order, stored

#: The multiplier stands for "every copy allowed" where the target is all that the source can give.
_FULL = 1e6


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size -> target. Sources by code point, null last, take the weights in turn.

    A target is share * all sizes * weight / all weights, but at most `most` times the source's size; what exceeds that
    is dealt anew by weight among the rest. That filling has a closed form: with sources ordered by size / weight, the
    capped ones are the first k, for the least k at which the (k+1)th isn't above its cap. Ranks and sums run over
    ranges of sources, so there may be any number of them."""
    named = [F.col("source").isNull(), F.col("source")]
    ranked = in_order(sources, named, {"__rank": F.lit(1)}, {"__all": F.col("source_size")})
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("__w", weight).withColumns({"__room": most * F.col("source_size") / F.col("__w"), "__cap": (most * F.col("source_size")).cast("double")})
    filled = stored(in_order(ranked, [F.col("__room"), *named], {"__before": F.col("__cap"), "__wider": F.col("__w")}, {"__weights": F.col("__w")})
        .withColumn("__level", (share * F.col("__all") - F.col("__before")) / (F.col("__weights") - F.col("__wider"))))
    level = filled.agg(F.max(F.when(F.col("__level") <= F.col("__room"), F.col("__level"))).alias("__top"))
    return filled.crossJoin(F.broadcast(level)).select(
        "source", "source_size",
        F.coalesce(F.least(F.col("__cap"), F.col("__w") * F.col("__top")), F.col("__cap")).cast("double").alias("target"),
    )


def _rate(multiplier: Column, size: Column, mean: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), multiplier * size / mean)))


def balanced(cells: DataFrame, goal: DataFrame, most: float, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """The dual's solution: source -> multiplier, mean.

    cells: source, size, n. goal: source, source_size, target. Newton's steps stay inside a bracket around the root,
    which a step that leaves it halves; so the loop converges from anywhere, and a bracket too narrow for doubles counts as
    converged. Should `rounds` not do, that is an error, never a silent approximation."""
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    start = F.when(F.col("target") >= most * F.col("source_size"), _FULL).otherwise(
        F.log(F.greatest(F.col("target") / F.col("source_size"), F.lit(1e-9))))
    state = stored(
        goal.where("source_size > 0").join(mean, goal.source.eqNullSafe(mean.source)).drop(mean.source)
        .select("source", "source_size", "target", "mean", start.alias("multiplier"), F.lit(-60.0).alias("low"), (F.lit(float(most)) * F.col("mean")).alias("high"), F.lit(False).alias("done"))
    )
    for _ in range(rounds):
        other = state.withColumnRenamed("source", "__source")
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean"), most)
        sums = (
            cells.join(other, F.col("source").eqNullSafe(F.col("__source")))
            .groupBy("__source")
            .agg(
                F.sum(rate * F.col("size") * F.col("n")).alias("__words"),
                F.sum(F.when(rate < most, rate * F.col("size") * F.col("size") * F.col("n") / F.col("mean")).otherwise(0.0)).alias("__slope"),
            )
        )
        gap = F.col("__words") - F.col("target")
        narrow = F.col("high") - F.col("low") <= 1e-13 * F.greatest(F.lit(1.0), F.abs("multiplier"))
        done = (F.abs(gap) <= tolerance * F.col("target") + 1e-6) | (F.col("multiplier") >= _FULL) | narrow
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - gap / F.nullif(F.col("__slope"), F.lit(0.0))
        state = stored(
            state.join(sums, F.col("source").eqNullSafe(F.col("__source")))
            .withColumns({"low": low, "high": high, "__newton": newton, "__done": done})
            .select(
                "source", "source_size", "target", "mean",
                F.when(F.col("__done"), F.col("multiplier"))
                .when((F.col("__newton") > F.col("low")) & (F.col("__newton") < F.col("high")), F.col("__newton"))
                .otherwise((F.col("low") + F.col("high")) / 2).alias("multiplier"),
                "low", "high", F.col("__done").alias("done"),
            )
        )
        if state.where("not done").isEmpty():
            # The last digits depend on the order of sums; without them, reruns round alike.
            return state.withColumn("multiplier", F.round("multiplier", 7))
    raise RuntimeError(f"no balance after {rounds} rounds")


def _rounded(cells: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """source, size, n -> copies, the copies that all documents of a cell get together, at most `most` each.

    Rates are rounded systematically in order of size, so that the error of a source telescopes to less than its
    largest document; then, step by step, a source whose words still miss its target gets (or gives) copies of the
    largest size that fits what is missing, until none fits. All sources step together; each step brings a source nearer
    by a word at least, so the steps end."""
    by_size = Window.partitionBy("source").orderBy(F.col("size").desc())
    other = state.select(F.col("source").alias("__source"), "target", "multiplier", "mean")
    joined = cells.where("size > 0").join(other, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean"), most)
    summed = joined.withColumn("__cum", F.sum(rate * F.col("n")).over(by_size))
    copies = F.floor(F.col("__cum") + 0.5) - F.coalesce(F.floor(F.lag("__cum").over(by_size) + 0.5), F.lit(0))
    now = stored(summed.withColumn("copies", F.least(F.greatest(copies, F.lit(0)), F.col("n") * most)).select("source", "size", "n", "target", "copies"))
    while True:
        missing = now.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("__taken")).select(
            F.col("source").alias("__source"), (F.col("target") - F.col("__taken")).alias("__missing"))
        fits = now.join(missing, F.col("source").eqNullSafe(F.col("__source"))).withColumn(
            "__room", F.when(F.col("__missing") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies")))
        fits = fits.where((F.col("__room") > 0) & (F.col("size") <= F.abs("__missing")))
        best = stored(
            fits.groupBy("__source").agg(F.max_by(F.struct("size", "__room", "__missing"), "size").alias("b"))
            .select(F.col("__source"), F.col("b.size").alias("__size"),
                    (F.signum("b.__missing") * F.least(F.col("b.__room"), F.floor(F.abs("b.__missing") / F.col("b.size")))).cast("long").alias("__more"))
        )
        if best.isEmpty():
            return now
        now = stored(
            now.join(best, F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")), "left")
            .withColumn("copies", F.col("copies") + F.coalesce("__more", F.lit(0)))
            .select("source", "size", "n", "target", "copies")
        )


#: Rows of a cell meet what their cell gets in blocks of so many row numbers.
_BLOCK = 1 << 16


def mixed(docs: DataFrame, weights: list[float], share: float = 1.5, most: int = 2) -> DataFrame:
    """docs (doc_id, source, size) -> doc_id, size, source_size, target, rate, copies, taken.

    size must be null-free and not negative. Documents without words have rate 1 and take nothing; a source without
    words has target 0. Within a cell (source, size) copies go evenly, the odd ones to the rows of least hash of the
    id; rows that repeat an id are told apart by an arbitrary number, which changes no sum. A null source is a source
    of its own. An empty table gives an empty one.

    Rows are numbered in order of their cells over ranges, and meet their cell's results by blocks of row numbers: a
    source, a size or an id that holds a third of all rows is spread over tasks like any others."""
    docs = stored(docs.select("doc_id", "source", F.col("size").cast("long").alias("size")))
    cells = stored(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goal = stored(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    state = balanced(cells, goal, most)
    rounded = _rounded(cells, state, most).select(F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies"))
    solved = goal.join(state.select(F.col("source").alias("__s"), "multiplier", "mean"), F.col("source").eqNullSafe(F.col("__s")), "left").select(
        F.col("source").alias("__goal"), "source_size", "target", "multiplier", "mean")
    cell = [F.col("source").isNull(), F.col("source"), F.col("size")]
    own = in_order(cells, cell, {"__start": F.col("n")}, {}).withColumnsRenamed({"source": "__cs", "size": "__cz", "n": "__n"})
    own = own.join(solved, F.col("__cs").eqNullSafe(F.col("__goal"))).join(
        rounded, F.col("__cs").eqNullSafe(F.col("__source")) & (F.col("__cz") == F.col("__size")), "left")
    own = own.withColumn("__block", F.explode(F.expr(f"sequence(__start div {_BLOCK}, (__start + __n - 1) div {_BLOCK})")))
    rows = in_order(docs.withColumn("__tie", F.monotonically_increasing_id()), [*cell, F.xxhash64("doc_id", F.lit(6)), F.col("doc_id"), F.col("__tie")], {"__at": F.lit(1)}, {})
    full = rows.join(own, F.col("source").eqNullSafe(F.col("__cs")) & (F.col("size") == F.col("__cz")) & (F.expr(f"__at div {_BLOCK}") == F.col("__block")))
    copies = F.when(F.col("__copies").isNull(), 1).otherwise(
        F.expr("__copies div __n") + F.when(F.col("__at") - F.col("__start") < F.col("__copies") % F.col("__n"), 1).otherwise(0)).cast("int")
    return (
        full.withColumn("copies", copies)
        .select(
            "doc_id", "size", "source_size", "target",
            F.when(F.col("size") > 0, _rate(F.col("multiplier"), F.col("size"), F.col("mean"), most)).otherwise(1.0).alias("rate"),
            "copies", (F.col("copies") * F.col("size")).alias("taken"),
        )
    )
