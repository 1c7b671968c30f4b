"""Meshes of shared vertices: closed, of the right area and orientation, the same for every cut into bricks; reduced ones and their files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import bricks, mesh
from voxloom.sources import sinks
from tests.test_settle import voxels


def ball(radius=5.3):
    z, y, x = np.ogrid[:15, :15, :15]
    return radius - np.sqrt((z - 7.0) ** 2 + (y - 7.0) ** 2 + (x - 7.0) ** 2)


def triangles(df):
    rows = df.collect()
    names = np.array([[r["a"], r["b"], r["c"]] for r in rows])
    return names, np.array([[[r[f"{a}{k}"] for a in "zyx"] for k in range(3)] for r in rows])


def closed(df):
    return df.count() > 0 and mesh.mesh_edges(df).where("there <> 1 or back <> 1").count() == 0


def volume(place):
    """Enclosed volume by the divergence theorem, positive if normals point out."""
    return float(np.einsum("ni,ni->n", place[:, 0], np.cross(place[:, 1], place[:, 2])).sum() / 6)


@pytest.mark.parametrize("edge", [4, 64])
def test_ball(spark, edge):
    v = ball()
    got = mesh.surface_mesh(voxels(spark, v), "v0", 0.0, v.shape, edge, outside=-9.0)
    names, place = triangles(got)
    assert closed(got) and len(np.unique(names)) - len(names) * 3 // 2 + len(names) == 2
    assert abs(abs(volume(place)) / (4 / 3 * np.pi * 5.3**3) - 1) < 0.03
    assert abs(mesh.mesh_area(got).first()["area"] - bricks.surface_area(np.pad(v, 1, constant_values=-9.0), 0.0)) < 1e-9
    #: One number is one place.
    at = {}
    for n, p in zip(names.ravel().tolist(), place.reshape(-1, 3).round(9).tolist(), strict=True):
        assert at.setdefault(n, p) == p


def test_normals_point_out(spark):
    v = ball()
    _, place = triangles(mesh.surface_mesh(voxels(spark, v), "v0", 0.0, v.shape, 64, outside=-9.0))
    normal = np.cross(place[:, 1] - place[:, 0], place[:, 2] - place[:, 0])
    assert (np.einsum("ni,ni->n", normal, place.mean(axis=1) - 7.0) > 0).all()


@pytest.mark.parametrize("share", [0.3, 0.6])
def test_random_solids_are_closed(spark, share):
    solid = np.random.default_rng(2).random((9, 8, 10)) < share
    on = voxels(spark, solid).where("v0").withColumn("v", F.lit(1.0))
    one, other = (mesh.surface_mesh(on, "v", 0.5, solid.shape, e) for e in (3, 64))
    assert closed(one) and sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    assert mesh.surface_mesh(on.limit(0), "v", 0.5, solid.shape).count() == 0


def test_reduced(spark, tmp_path):
    v = ball()
    whole = mesh.surface_mesh(voxels(spark, v), "v0", 0.0, v.shape, 64, outside=-9.0)
    n = mesh.mesh_vertices(whole).count()
    for most in (n // 3, 40):
        small = mesh.reduced_mesh(whole, most)
        names, place = triangles(small)
        assert 4 <= len(np.unique(names)) <= most and closed(small)
        assert abs(volume(place)) / abs(volume(triangles(whole)[1])) > 0.5
        assert all(len(set(t)) == 3 for t in names.tolist())
    kept = mesh.reduced_mesh(whole, 10**6, finest=1e-9)
    assert kept.count() == whole.count() and abs(mesh.mesh_area(kept).first()["area"] - mesh.mesh_area(whole).first()["area"]) < 1e-6
    corners = F.array(*[F.col(f"{a}{k}") for k in range(3) for a in "zyx"])
    r = sinks.write_stl(small.select("scan", corners.alias("tri")), f"file://{tmp_path}/m").first()
    raw = open(r["path"], "rb").read()
    assert struct.unpack("<I", raw[80:84])[0] == len(names) == r["triangles"] and len(raw) == 84 + 50 * len(names)
    body = np.frombuffer(raw[84:], np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]))
    assert sorted(body["v"].reshape(-1, 9).round(3).tolist()) == sorted(place.astype("<f4").reshape(-1, 9).round(3).tolist())
