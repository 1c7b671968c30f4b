"""Operators over a grid that grows with the table: every row is a voxel, and results don't stop at the faces of bricks."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import bricks, grid
from voxloom.plans import grids
from voxloom.plans.standins import voxels

LARGE = "/root/testdata/sf0.1"


def test_every_row_is_a_voxel(spark, sf_dir):
    rows = duckdb.sql(f"SELECT count(*) FROM '{sf_dir}/lineitem.parquet'").fetchall()[0][0]
    vox, edge = voxels(spark, sf_dir)
    assert rows > 5120 and vox.count() == rows == vox.select("scan", "z", "y", "x").distinct().count()
    assert 2 * (edge - 1) ** 3 < rows <= 2 * edge**3


def test_components_cross_bricks(spark):
    got = grids.voxel_components(spark, LARGE).where("scan = 0").toPandas()
    at = tuple(got[list("zyx")].to_numpy().T)
    assert got.z.max() >= grid.BRICK
    mask = np.zeros(got[list("zyx")].max().to_numpy() + 1, bool)
    mask[at] = True
    own = bricks.label(mask, 6)[at]
    assert len(set(zip(own, got.comp, strict=True))) == len(set(own)) == got.comp.nunique()
    assert (got["size"] == got.groupby("comp").comp.transform("size")).all()
    low = got[got.z < grid.BRICK].comp
    assert low.isin(got[got.z >= grid.BRICK].comp).any()


def test_distances_of_the_whole_grid(spark, sf_dir):
    vox = voxels(spark, sf_dir)[0].where("scan = 1").toPandas()
    air = vox[vox.phase == 1][list("zyx")].to_numpy()
    got = grids.distance_map(spark, sf_dir).where("scan = 1").toPandas()
    assert len(got) == (vox.phase != 1).sum()
    for r in got.itertuples():
        assert abs(r.d - np.sqrt(((air - (r.z, r.y, r.x)) ** 2).sum(1).min())) < 1e-5


def test_zones_between_all_pairs(spark):
    """All touching pairs, grown by the reach, without the two bodies, with the voxels in contact: as the arrays of the reference give them."""
    draw = np.random.default_rng(11)
    labels = np.zeros((14, 12, 12), int)
    labels[1:5, 2:6, 2:6], labels[5:9, 3:8, 2:7], labels[1:6, 6:10, 3:8], labels[10:13, 1:4, 8:11], labels[11:13, 4:7, 8:11] = 1, 2, 3, 4, 5
    phase = np.where(labels > 0, 3, draw.integers(1, 3, labels.shape))
    z, y, x = np.indices(labels.shape).reshape(3, -1)
    vox = spark.createDataFrame([(0, *map(int, r)) for r in zip(z, y, x, labels.ravel(), phase.ravel(), strict=True)], "scan int, z int, y int, x int, label int, phase int")
    cross = np.zeros((3, 3, 3), bool)
    cross[1, 1], cross[1, :, 1], cross[:, 1, 1] = True, True, True

    def wide(m, times):
        for _ in range(times):
            m = bricks.morph(m, cross, True)
        return m

    pairs = grid.contact_pairs(vox, "label", F.lit(True), 1)
    for reach in (1, 5):
        want = {}
        for lo in range(1, 6):
            for hi in range(lo + 1, 6):
                a, b = labels == lo, labels == hi
                contact = int((a & wide(b, 1)).sum())
                if contact:
                    zone = wide(a, reach) & wide(b, reach) & ~a & ~b
                    want[lo, hi] = (int(zone.sum()), int((zone & (phase == 1)).sum()), int((zone & (phase == 2)).sum()), contact)
        got = grid.contact_zones(vox, "label", pairs, F.col("phase") == 1, F.col("phase") == 2, reach).collect()
        assert {(r["lo"], r["hi"]): (r["zone"], r["air"], r["ice"], r["contact"]) for r in got} == want and len(want) >= 4


def test_cubes_follow_the_specimen(spark):
    """Heights and centre come from each scan, and a cube needs more than 98 %: held against arrays, on a specimen that lies off the middle."""
    draw = np.random.default_rng(12)
    z, y, x = np.indices((30, 26, 24))
    body = ((y - 14) ** 2 + (x - 11) ** 2 <= 81) & (z >= 4) & (z < 28)
    body[16:20, 12:16, 9:12] = False
    phase = np.where(body, draw.integers(1, 4, body.shape), 0)
    vox = spark.createDataFrame([(0, *map(int, p), int(phase[tuple(p)])) for p in np.argwhere(body)], "scan int, z int, y int, x int, phase int")
    own, c, want = phase[4:28], 10, {}
    nz = own.shape[0]
    ys, xs = np.nonzero(own[nz // 2])
    cy, cx = int(ys.mean()), int(xs.mean())
    for k, at in enumerate(np.linspace(0.28 * nz, 0.72 * nz, 3).astype(int)):
        sub = own[at - c // 2 : at + c // 2, cy - c // 2 : cy + c // 2, cx - c // 2 : cx + c // 2]
        if sub.shape == (c, c, c) and (sub > 0).mean() > 0.98:
            want[k] = (at + 4, int((sub > 0).sum()), (sub == 2).sum() / (sub > 0).sum())
    got = {r["k"]: (r["z"], r["n"], r["phi"]) for r in grid.cubes(vox, F.col("phase") == 2, (26, 24), c).where("accepted").collect()}
    assert grid.cubes(vox, F.col("phase") == 2, (26, 24), c).count() == 3
    assert set(got) == set(want) and 0 < len(want) < 3
    for k in want:
        assert got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-9


def test_synthetic_bodies(spark):
    """Turned bodies that overlap, cell by cell; a body without extent; the first bodies that fill a share."""
    from voxloom.operators import synthetic

    rows = [(0, 3, 9.0, 9.5, 8.0, 6.0, 3.0, 2.0, 0.4, 0.9), (0, 5, 11.0, 10.0, 9.0, 4.0, 4.0, 4.0, 0.0, 0.0), (0, 1, 2.0, 2.0, 2.0, 0.0, 3.0, 3.0, 0.0, 0.0), (0, 9, 20.0, 4.0, 4.0, 5.0, 2.0, 3.0, -1.0, 0.3), (None, 9, 5.0, 5.0, 5.0, 2.0, 2.0, 2.0, 0.0, 0.0)]
    bodies = spark.createDataFrame(rows, "scan int, id long, cz double, cy double, cx double, rz double, ry double, rx double, turn double, tilt double")
    shape = (24, 19, 18)
    want = {}
    for scan, name, cz, cy, cx, rz, ry, rx, turn, tilt in sorted(rows, key=lambda r: r[1]):
        if rz > 0:
            z, y, x = (g - c for g, c in zip(np.indices(shape), (cz, cy, cx), strict=True))
            y, x = y * np.cos(turn) - x * np.sin(turn), y * np.sin(turn) + x * np.cos(turn)
            z, y = z * np.cos(tilt) - y * np.sin(tilt), z * np.sin(tilt) + y * np.cos(tilt)
            for at in np.argwhere(abs(z / rz) ** 2.5 + abs(y / ry) ** 2.5 + abs(x / rx) ** 2.5 <= 1):
                want.setdefault((scan, *at.tolist()), name)
    key = lambda df: {(r["scan"], r["z"], r["y"], r["x"]): r["label"] for r in df.collect()}
    assert key(synthetic.drawn_bodies(bodies, shape)) == want and {3, 5, 9} <= set(want.values())
    first = sum(v == 3 and k[0] == 0 for k, v in want.items())
    some = key(synthetic.filled_to(bodies, shape, (first + 1) / np.prod(shape)))
    assert some == {k: v for k, v in want.items() if v <= 5 or k[0] is None}
    grey = synthetic.grey_values(synthetic.drawn_bodies(bodies, shape), 200.0, 60.0, 8.0, 1)
    assert grey.where("abs(grey - 200) > 8").count() == 0
