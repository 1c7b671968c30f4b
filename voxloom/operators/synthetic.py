"""Synthetic volumes: turned superellipsoids drawn into a grid, as a relation of voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.series import running_total, same_keys
from voxloom.operators.spatial import AXES
from voxloom.scratch import Scratch

#: Edge of the blocks that a body's box is cut into.
BLOCK = 16


def _turned(offset: list[Column]) -> list[Column]:
    """An offset (z, y, x) in a body's own axes: by the angle ``turn`` round z, then ``tilt`` round the new x."""
    z, y, x = offset
    c, s, ct, st = F.cos("turn"), F.sin("turn"), F.cos("tilt"), F.sin("tilt")
    own_y, own_x = y * c - x * s, y * s + x * c
    return [z * ct - own_y * st, z * st + own_y * ct, own_x]


def drawn_bodies(bodies: DataFrame, shape: tuple[int, int, int], power: float = 2.5) -> DataFrame:
    """(scan, z, y, x, label): the voxels of a grid of ``shape`` that lie in a body, with the least of the bodies that hold them: where two overlap the first keeps the voxel.

    ``bodies`` has (scan, id, cz, cy, cx, rz, ry, rx, turn, tilt): centre, half axes and angles. A body is where the offsets over the half axes, to the ``power``, add up
    to 1 at most. Bodies are cut into blocks that are drawn apart, so a large body isn't one task's work; a body without extent holds nothing.
    """
    reach = F.greatest("rz", "ry", "rx") * 3**0.5
    blocks = bodies.withColumn("reach", reach)
    for a, n in zip(AXES, shape, strict=True):
        low, high = F.greatest(F.ceil(F.col(f"c{a}") - F.col("reach")), F.lit(0)), F.least(F.floor(F.col(f"c{a}") + F.col("reach")), F.lit(n - 1))
        blocks = blocks.where(low <= high).withColumn(f"b{a}", F.explode(F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK))))
    cells = blocks.repartition("scan", "id", *[f"b{a}" for a in AXES])
    for a, n in zip(AXES, shape, strict=True):
        first = F.col(f"b{a}") * BLOCK
        cells = cells.withColumn(a, F.explode(F.sequence(first.cast("int"), (F.least(first + BLOCK, F.lit(n)) - 1).cast("int"))))
    own = _turned([F.col(a) - F.col(f"c{a}") for a in AXES])
    parts = [F.pow(F.abs(x) / F.col(f"r{a}"), F.lit(power)) for x, a in zip(own, AXES, strict=True)]
    inside = (F.least("rz", "ry", "rx") > 0) & (parts[0] + parts[1] + parts[2] <= 1)
    return cells.where(inside).groupBy("scan", *AXES).agg(F.min("id").alias("label"))


def filled_to(bodies: DataFrame, shape: tuple[int, int, int], share: float, power: float = 2.5) -> DataFrame:
    """``drawn_bodies`` of the first bodies of each scan, by id, that fill at least ``share`` of the grid, or of all where they don't.

    A voxel's first body doesn't depend on later ones, so all are drawn at once, and what each adds is summed in the order of ids.
    """
    scratch = Scratch(bodies.sparkSession, "synthetic")
    drawn = scratch.put(drawn_bodies(bodies, shape, power), "drawn")
    added = drawn.groupBy("scan", "label").agg(F.count("*").alias("added"))
    run = running_total(scratch.put(added, "added"), "label", "label", F.col("added"), "filled", ["scan"])
    enough = share * shape[0] * shape[1] * shape[2]
    last = run.where(F.col("filled") >= enough).groupBy("scan").agg(F.min("label").alias("last"))
    return same_keys(drawn, last, ["scan"], "left").where(F.col("last").isNull() | (F.col("label") <= F.col("last"))).drop("last")


def grey_values(vox: DataFrame, inside: float, outside: float, noise: float, seed: int) -> DataFrame:
    """``vox`` (scan, z, y, x, label) with grey: one level for bodies, one for what has no label, and even noise of a hash of the place, the same in every run."""
    h = F.pmod(F.xxhash64(F.lit(seed), "scan", *AXES), F.lit(1 << 20)) / float(1 << 20)
    level = F.when(F.coalesce("label", F.lit(0)) > 0, F.lit(inside)).otherwise(F.lit(outside))
    return vox.withColumn("grey", level + (h - 0.5) * 2 * noise)
