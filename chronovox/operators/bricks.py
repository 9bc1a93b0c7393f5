"""Images cut into bricks with halos. A rule that looks one voxel far can be applied as often as a halo is wide before
bricks have to meet again, and gives what it would give on the whole image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_bricks(image: DataFrame, width: int, halo: int) -> DataFrame:
    """image with bx, by, bz: each voxel once for every brick whose core, `width` voxels wide, is at most `halo` away."""
    out = image
    for c in "xyz":
        near = F.sequence(F.floor((F.col(c) - halo) / width).cast("long"), F.floor((F.col(c) + halo) / width).cast("long"))
        out = out.withColumn(f"b{c}", F.explode(near))
    return out
