"""Surface meshes with shared vertices, by bricks.

A vertex lies on the edge of the voxel lattice that the surface cuts, and is called by that edge: its lower voxel and its direction. So triangles of
neighbouring bricks share vertices without a comparison of places, and a mesh is a relation of vertex numbers.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.settle import EDGE
from voxloom.operators.spatial import AXES
from voxloom.scratch import Scratch

#: Corners of a cell of eight voxels, by the bits z, y, x, and its cut into six tetrahedra round a diagonal: along each edge of these no coordinate falls.
_CORNERS = np.array(list(itertools.product((0, 1), repeat=3)))
TETRAHEDRA = [(0, a, a | b, 7) for a, b in itertools.permutations((1, 2, 4), 2)]
_MESH = "scan int, a long, b long, c long, " + ", ".join(f"{a}{k} double" for k in range(3) for a in AXES)


def _cut(values: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower corner, direction, place) of the vertices of all triangles, each (n, 3, ...): where the trilinear data of a brick cross the level. Normals point to what
    lies below it."""
    shape = np.array(values.shape)
    cells = np.stack([values[tuple(slice(c[k], shape[k] - 1 + c[k]) for k in range(3))].ravel() for c in _CORNERS])
    mixed = np.flatnonzero((cells >= level).any(axis=0) & (cells < level).any(axis=0))
    cells, origin = cells[:, mixed] - level, np.stack(np.unravel_index(mixed, shape - 1), axis=1)
    lower, direction, place = [np.zeros((0, 3, 3), int)], [np.zeros((0, 3), int)], [np.zeros((0, 3, 3))]
    for tet in TETRAHEDRA:
        v = cells[list(tet)]
        above = sum((v[k] >= 0).astype(np.int8) << k for k in range(4))
        for size in (1, 2, 3):
            for inside in itertools.combinations(range(4), size):
                hit = np.flatnonzero(above == sum(1 << k for k in inside))
                if not len(hit):
                    continue
                rest = [k for k in range(4) if k not in inside]
                ring = [(i, o) for i in inside for o in rest]
                if size == 2:
                    ring = [ring[0], ring[1], ring[3], ring[2]]
                ends = [(min(tet[i], tet[o]), max(tet[i], tet[o])) for i, o in ring]
                low = np.stack([origin[hit] + _CORNERS[p] for p, _ in ends], axis=1)
                share = np.stack([cells[p, hit] / (cells[p, hit] - cells[q, hit]) for p, q in ends], axis=1)
                at = low + share[:, :, None] * np.stack([_CORNERS[q] - _CORNERS[p] for p, q in ends])
                out = _CORNERS[[tet[k] for k in rest]].mean(axis=0) - _CORNERS[[tet[k] for k in inside]].mean(axis=0)
                for tri in [(0, 1, 2)] if len(ring) == 3 else [(0, 1, 2), (0, 2, 3)]:
                    tri = list(tri)
                    faces = np.cross(at[:, tri[1]] - at[:, tri[0]], at[:, tri[2]] - at[:, tri[0]]) @ out < 0
                    order = np.where(faces[:, None], np.array([tri[0], tri[2], tri[1]]), np.array(tri))
                    row = np.arange(len(hit))[:, None]
                    lower.append(low[row, order])
                    direction.append(np.array([q - p for p, q in ends])[order])
                    place.append(at[row, order])
    return np.concatenate(lower), np.concatenate(direction), np.concatenate(place)


def surface_mesh(vox: DataFrame, value: str, level: float, shape: tuple[int, int, int], edge: int = EDGE, outside: float = 0.0) -> DataFrame:
    """(scan, a, b, c, z0 .. x2): triangles where the voxels' values cross the level, as vertex numbers and places; normals point to lower values.

    ``vox`` has (scan, z, y, x, value) in a grid of ``shape``; places without a voxel hold ``outside``, so a mesh is closed if that is below the level. Cells between
    eight voxels are dealt to bricks of ``edge`` cells; a group is one brick. Triangles without area, where a value is the level, are left out only if
    two of their vertices are one.
    """
    spread = vox.select("scan", *AXES, F.col(value).cast("double").alias("v"))
    for a in AXES:
        spread = spread.withColumn(f"b{a}", F.explode(F.array_distinct(F.array(F.floor((F.col(a) - 1) / edge), F.floor(F.col(a) / edge)))))
    wide = [n + 2 for n in shape]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        base = np.array([int(part[f"b{a}"].iloc[0]) * edge for a in AXES])
        v = np.full((edge + 1,) * 3, float(outside))
        v[tuple((part[list(AXES)].to_numpy() - base).T)] = part.v
        scan = int(part.scan.iloc[0])
        low, direction, at = _cut(v, level)
        low = low + base + 1
        number = (((scan * wide[0] + low[..., 0]) * wide[1] + low[..., 1]) * wide[2] + low[..., 2]) * 8 + direction
        columns = {"scan": np.full(len(number), scan), **dict(zip("abc", number.T, strict=True))}
        return pd.DataFrame(columns | {f"{a}{k}": at[:, k, i] + base[i] for k in range(3) for i, a in enumerate(AXES)})

    return spread.groupBy("scan", *[f"b{a}" for a in AXES]).applyInPandas(one, _MESH)


def _counted(low: np.ndarray, direction: np.ndarray, at: np.ndarray, edge: int) -> tuple[list, np.ndarray, np.ndarray]:
    """What a brick's triangles of ``_cut`` come to: [triangles, area, vertices, edges, edges that are closed], of vertices and edges those alone that no
    other brick can have; the others' vertices (n, 4) as lower corner and direction, and edges (m, 10) as two such and how often they are gone along either way."""
    n = edge + 1
    name = (((low[..., 0] * n + low[..., 1]) * n + low[..., 2]) * 8 + direction).astype(np.int64)
    #: Of each face of the brick whether a vertex lies in it: its lattice edge does.
    flat = [(direction & bit) == 0 for bit in (4, 2, 1)]
    faces = sum(((flat[k] & (low[..., k] == end)).astype(np.int64) << (2 * k + i)) for k in range(3) for i, end in enumerate((0, edge)))
    place = lambda v: np.stack([*np.unravel_index(v >> 3, (n,) * 3), v & 7], axis=1)
    seen = np.zeros(8 * n**3, np.int8)
    seen[name.ravel()] = np.where(faces.ravel() > 0, 2, 1)
    #: The names of an edge's ends and its direction as one number, so that equal ones are together when in order.
    p, q = name, np.roll(name, -1, axis=1)
    both = faces & np.roll(faces, -1, axis=1)
    wide = 8 * n**3
    key = ((np.minimum(p, q) * wide + np.maximum(p, q)) * 2 + (both == 0)) * 2 + (p < q)
    key = np.sort(key.ravel())
    first = np.flatnonzero(np.diff(key >> 1, prepend=-1))
    ups = np.add.reduceat(key & 1, first) if len(first) else np.zeros(0, np.int64)
    many, kind = np.diff(first, append=len(key)), key[first] >> 1
    inner = kind & 1 == 1
    area = np.linalg.norm(np.cross(at[:, 1] - at[:, 0], at[:, 2] - at[:, 0]), axis=1).sum() / 2
    total = [len(low), float(area), int((seen == 1).sum()), int(inner.sum()), int((inner & (ups == 1) & (many == 2)).sum())]
    a, b = np.divmod(kind[~inner] >> 1, wide)
    there = ups[~inner]
    return total, place(np.flatnonzero(seen == 2)), np.concatenate([place(a), place(b), there[:, None], (many[~inner] - there)[:, None]], axis=1)


def mesh_summary(vox: DataFrame, value: str, level: float, shape: tuple[int, int, int], edge: int = 32, outside: float = 0.0) -> DataFrame:
    """(scan, triangles, area, vertices, edges, closed) of ``surface_mesh``: closed are the edges that are gone along once in each direction.

    A brick counts its own triangles, and the vertices and edges that no other brick can have. Only those in its faces are put together
    with the neighbours', so what is shuffled after the cut is a few hundredths of the mesh.
    """
    spread = vox.select("scan", *AXES, F.col(value).cast("double").alias("v"))
    for a in AXES:
        spread = spread.withColumn(f"b{a}", F.explode(F.array_distinct(F.array(F.floor((F.col(a) - 1) / edge), F.floor(F.col(a) / edge)))))
    wide = [n + 2 for n in shape]
    ddl = "scan int, a long, b long, there long, back long, triangles long, area double, vertices long, edges long, closed long"

    def one(rows: pa.Table) -> pa.Table:
        base = np.array([rows[f"b{a}"][0].as_py() * edge for a in AXES])
        scan, v = rows["scan"][0].as_py(), np.full((edge + 1,) * 3, float(outside))
        v[tuple(rows[a].to_numpy() - k for a, k in zip(AXES, base, strict=True))] = rows["v"].to_numpy()
        total, points, sides = _counted(*_cut(v, level), edge)

        def number(p: np.ndarray) -> np.ndarray:
            z, y, x = (p[:, :3] + base + 1).T
            return (((scan * wide[0] + z) * wide[1] + y) * wide[2] + x) * 8 + p[:, 3]

        k, m = len(points), len(sides)
        none, zero = [None], np.zeros(k + m, np.int64)
        own = lambda first, rest, kind: pa.concat_arrays([pa.array([first], kind), pa.array(rest, kind)])
        a = np.concatenate([number(points), number(sides[:, :4])])
        b = pa.concat_arrays([pa.nulls(1 + k, pa.int64()), pa.array(number(sides[:, 4:8]), pa.int64())])
        ways = [own(0, np.concatenate([np.zeros(k, np.int64), sides[:, c]]), pa.int64()) for c in (8, 9)]
        sums = [own(t, zero.astype(float) if isinstance(t, float) else zero, pa.float64() if isinstance(t, float) else pa.int64()) for t in total]
        columns = [pa.array(np.full(1 + k + m, scan, np.int32)), own(*none, a, pa.int64()), b, *ways, *sums]
        return pa.table(dict(zip(("scan", "a", "b", "there", "back", "triangles", "area", "vertices", "edges", "closed"), columns, strict=True)))

    parts = spread.groupBy("scan", *[f"b{a}" for a in AXES]).applyInArrow(one, ddl)
    counts = ("triangles", "area", "vertices", "edges", "closed")
    each = parts.groupBy("scan", "a", "b").agg(*[F.sum(c).alias(c) for c in ("there", "back", *counts)])
    point, side = F.col("a").isNotNull() & F.col("b").isNull(), F.col("b").isNotNull()
    more = {"vertices": point, "edges": side, "closed": side & (F.col("there") == 1) & (F.col("back") == 1)}
    return each.groupBy("scan").agg(*[(F.sum(c) + F.count_if(more[c]) if c in more else F.sum(c)).alias(c) for c in counts]).where("triangles > 0")


def mesh_vertices(mesh: DataFrame) -> DataFrame:
    """(scan, v, z, y, x): each vertex once."""
    corner = lambda k, n: F.struct(F.col(n).alias("v"), *[F.col(f"{a}{k}").alias(a) for a in AXES])
    every = mesh.select("scan", F.explode(F.array(*[corner(k, n) for k, n in enumerate("abc")])).alias("p")).select("scan", "p.*")
    return every.groupBy("scan", "v").agg(*[F.first(a).alias(a) for a in AXES])


def mesh_edges(mesh: DataFrame) -> DataFrame:
    """(scan, a, b, there, back): each edge once, and how many triangles go along it from a to b and from b to a. Where both are 1 everywhere, the mesh is closed."""
    way = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), (F.col(p) < F.col(q)).alias("up"))
    every = mesh.select("scan", F.explode(F.array(way("a", "b"), way("b", "c"), way("c", "a"))).alias("e")).select("scan", "e.*")
    return every.groupBy("scan", "a", "b").agg(F.count_if("up").alias("there"), F.count_if(~F.col("up")).alias("back"))


def mesh_area(mesh: DataFrame) -> DataFrame:
    """(scan, triangles, area)."""
    u, v = ([F.col(f"{a}{k}") - F.col(f"{a}0") for a in AXES] for k in (1, 2))
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return mesh.groupBy("scan").agg(F.count("*").alias("triangles"), F.sum(F.sqrt(sum((c * c for c in cross[1:]), cross[0] * cross[0])) / 2).alias("area"))


def reduced_mesh(mesh: DataFrame, most: int, finest: float = 1.0, levels: int = 12) -> DataFrame:
    """``mesh`` with at most ``most`` vertices a scan where ``levels`` doublings of the cell get there: vertices of one cell become one, in their mean.

    The cell's edge is ``finest`` or the first doubling of it that is coarse enough, for each scan. Triangles that lose a corner go, and so do those of which
    the same corners are left more than once in both directions, which lie upon each other. Vertices keep the least number of their cell.
    """
    scratch = Scratch(mesh.sparkSession, "mesh")
    vertices = scratch.put(mesh_vertices(mesh), "vertices")
    place = lambda size: [F.floor(F.col(a) / size).alias(f"c{a}") for a in AXES]
    tried = vertices.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("size", F.lit(finest) * F.pow(F.lit(2.0), F.col("k")))
    counts = tried.select("scan", "k", *place(F.col("size"))).distinct().groupBy("scan", "k").agg(F.count("*").alias("n"))
    chosen = counts.groupBy("scan").agg(F.coalesce(F.min(F.when(F.col("n") <= most, F.col("k"))), F.lit(levels)).alias("k"))
    own = vertices.join(chosen, "scan").withColumn("size", F.lit(finest) * F.pow(F.lit(2.0), F.col("k")))
    cells = own.select("scan", "v", *AXES, *place(F.col("size")))
    means = cells.groupBy("scan", *[f"c{a}" for a in AXES]).agg(F.min("v").alias("to"), *[F.avg(a).alias(a) for a in AXES])
    moved = scratch.put(cells.drop(*AXES).join(means, ["scan", *[f"c{a}" for a in AXES]]).select("scan", "v", "to", *AXES), "moved")
    out = mesh.select("scan", *"abc")
    for k, n in enumerate("abc"):
        to = moved.select("scan", F.col("v").alias(n), F.col("to").alias(f"to_{n}"), *[F.col(a).alias(f"{a}{k}") for a in AXES])
        out = out.join(to, ["scan", n]).drop(n).withColumnRenamed(f"to_{n}", n)
    out = out.where("a <> b and b <> c and a <> c")
    #: The same three corners, from the least on: the one way round and the other cancel out.
    turned = F.when((F.col("a") < F.col("b")) & (F.col("a") < F.col("c")), F.array(*"abc")).when((F.col("b") < F.col("a")) & (F.col("b") < F.col("c")), F.array(*"bca")).otherwise(F.array(*"cab"))
    out = out.withColumn("r", turned).withColumn("up", F.get("r", F.lit(1)) < F.get("r", F.lit(2)))
    first = [F.struct(F.col(n).alias("v"), *[F.col(f"{a}{k}").alias(a) for a in AXES]) for k, n in enumerate("abc")]
    merged = out.groupBy("scan", F.sort_array("r").alias("s")).agg(F.sum(F.when(F.col("up"), 1).otherwise(-1)).alias("net"), F.first(F.sort_array(F.array(*first))).alias("p"))
    p = [F.get("p", F.lit(k)) for k in range(3)]
    order = lambda k: p[k] if not k else F.when(F.col("net") > 0, p[k]).otherwise(p[3 - k])
    kept = merged.where("net <> 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.abs("net")))).select("scan", *[order(k).alias(f"p{k}") for k in range(3)])
    return kept.select("scan", *[F.col(f"p{k}.v").alias(n) for k, n in enumerate("abc")], *[F.col(f"p{k}.{a}").alias(f"{a}{k}") for k in range(3) for a in AXES])
