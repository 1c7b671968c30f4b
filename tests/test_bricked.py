"""Operators that were joins and aggregations over shifted voxels, as brick kernels: whole results, and plans that no scan or map goes through whole."""

import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import bricks, grid, spatial
from voxloom.sources import volumes

DDL = "scan int, z int, y int, x int, label int, v double"


def cloud(spark, seed, shape=(9, 11, 10), low=0):
    """Voxels with gaps, places below zero, and missing values."""
    draw = np.random.default_rng(seed)
    at = np.argwhere(draw.random(shape) < 0.8) + low
    rows = [(int(s), *map(int, p), int(draw.integers(0, 4)), None if draw.random() < 0.2 else float(draw.integers(0, 9))) for s in (0, 1) for p in at]
    return spark.createDataFrame(rows, DDL), rows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cube_extremes_by_bricks(spark):
    vox, rows = cloud(spark, 3, low=-4)
    got = grid.cube_extremes(vox, "v", 1, {"hi": F.max, "lo": F.min}, edge=4)
    assert "Aggregate" not in plan(got) and got.schema["hi"].dataType == got.schema["v"].dataType
    held = {r[:4]: r[5] for r in rows}
    for r in got.collect():
        near = [held.get((r.scan, r.z + a, r.y + b, r.x + c)) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
        near = [n for n in near if n is not None]
        assert (r.v, r.hi, r.lo) == (held[r.scan, r.z, r.y, r.x], max(near, default=None), min(near, default=None))
    assert got.count() == len(rows)


def test_border_core_reads_each_voxel_once(spark):
    assert plan(grid.border_core(cloud(spark, 4)[0], "label", 1)).count("FlatMapGroups") == 1
    assert "Join" not in plan(grid.local_maxima(cloud(spark, 4)[0], "v"))


def test_territory_by_bricks(spark):
    vox, rows = cloud(spark, 5, low=-3)
    got = grid.territory(vox, "label", 2, edge=4)
    assert "Aggregate" not in plan(got)
    cube = [(a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3)]
    body, want = {r[:4]: r[4] for r in rows if r[4] > 0}, {}
    for s, z, y, x, k, _ in rows:
        near = [(a * a + b * b + c * c, body[s, z + a, y + b, x + c]) for a, b, c in cube if (s, z + a, y + b, x + c) in body]
        if k == 0 and near:
            want[s, z, y, x] = min(near)[1]
    assert {tuple(r)[:4]: r.label for r in got.collect()} == want


def test_zones_are_rows_of_bricks(spark):
    """The result is the same for every cut, and no voxel is sent on for each label that reaches it."""
    vox, _ = cloud(spark, 6)
    pairs = grid.contact_pairs(vox, "label", F.lit(True), 1)
    made = [grid.contact_zones(vox, "label", pairs, F.col("v") < 3, F.col("v") >= 5, 2, edge) for edge in (3, 64)]
    a, b = (sorted(map(tuple, m.collect())) for m in made)
    assert a == b and len(a) == 6 and all(r[3] > r[4] > 0 and r[6] > 0 for r in a)
    assert plan(made[0]).count("Distinct") + plan(made[0]).count("Deduplicate") == 0


def test_no_join_by_scan_alone(spark):
    """A scan isn't a key of a join of its voxels."""
    vox, _ = cloud(spark, 7)
    for df in (bricks.distance_transform(vox.withColumn("m", F.col("label") > 0), "m"), grid.cubes(vox, F.col("label") == 1, (11, 10), 4)):
        for line in plan(df).splitlines():
            if "Join" in line and "(scan#" in line:
                sides = line.count("=")
                assert sides > 1 or "FlatMapGroups" not in line
    assert "z#" in next(line for line in plan(bricks.distance_transform(vox.withColumn("m", F.col("label") > 0), "m")).splitlines() if "Join" in line)
    assert "__bz#" in plan(grid.cubes(vox, F.col("label") == 1, (11, 10), 4))


def test_nearest_first(spark):
    """Points at one place: no pairs within the tolerance are made."""
    rows = [(k, 0.0, 0.0, 0.001 * (k % 3)) for k in range(300)]
    a = spark.createDataFrame(rows, "id long, z double, y double, x double")
    got = spatial.nearest_match(a, a.where("id >= 3"), 0.5)
    assert {r.a: (r.b, round(r.d, 9)) for r in got.collect()} == {k: (3 + k % 3, 0.0) for k in range(300)}
    assert "Window" not in plan(got)
    assert spatial.nearest_match(a.where("id = 1"), a.where("id = 3"), 0.001, closed=True).count() == 1 and spatial.nearest_match(a.where("id = 1"), a.where("id = 3"), 0.001).count() == 0


def test_models_see_doubles(spark):
    """Values that are one number as a float are on both sides of their brick's mean."""
    rows = [(0, z, y, x, 70_000.0 + 0.001 * ((z + y + x) % 2)) for z in range(2) for y in range(2) for x in range(2)]
    vox = spark.createDataFrame(rows, "scan int, z int, y int, x int, grey double")
    model = lambda v: np.stack([v <= 0, v > 0]).astype(float)
    (got,) = bricks.predict_bricks(volumes.bricked(vox, "grey", 2, 0, "double"), model, 0).collect()
    assert got.classes == [r[4] > 70_000.0 for r in rows]


def test_boxes_share_the_voxels_of_their_brick(spark):
    """Boxes of several sizes that lie upon each other: a voxel is sent once to each brick and size, and every pair has its own box."""
    vox = spark.createDataFrame([(0, z, y, x, 100 * z + 10 * y + x) for z in range(9) for y in range(9) for x in range(9)], "scan int, z int, y int, x int, v long")
    made = [(0, k, k + 1, -1 + k % 3, 3 + k % 6, 0, 2 + k % 7, 1, 12 - k) for k in range(10)]
    pairs = spark.createDataFrame(made, "scan int, bead_a long, bead_b long, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    pairs = pairs.select("*", *[F.lit(1.0).alias(f"r_{s}") for s in "ab"], *[F.lit(2.0).alias(f"c{s}_{a}") for s in "ab" for a in "zyx"])
    measure = lambda v, pair, radii, centres: {"n": v.size, "total": int(v.sum()), "z": float(centres[0][0])}
    got = bricks._per_pair(vox, pairs, ("v",), measure, "n long, total long, z double", home=4)
    assert "CoGroup" in plan(got)
    want = {}
    for _, a, b, z0, z1, y0, y1, x0, x1 in made:
        box = [(z, y, x) for z in range(max(z0, 0), min(z1, 8) + 1) for y in range(y0, min(y1, 8) + 1) for x in range(x0, min(x1, 8) + 1)]
        want[a] = (len(box), sum(100 * z + 10 * y + x for z, y, x in box), 2.0 - max(z0, 0))
    assert {r.bead_a: (r.n, r.total, r.z) for r in got.collect()} == want
