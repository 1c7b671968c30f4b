"""Bricks that exchange faces give what the whole array gives: distances along paths, reconstruction, skeletons, watersheds."""

import heapq
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import bricks, forest, settle, watershed
from voxloom.scratch import Scratch

EVERY = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
SIX = [o for o in EVERY if sum(map(abs, o)) == 1]


def voxels(spark, *arrays, scan=0):
    rows = [(scan, *map(int, at), *[a[tuple(at)].item() for a in arrays]) for at in np.ndindex(arrays[0].shape)]
    kinds = {"b": "boolean", "f": "double", "i": "long"}
    return spark.createDataFrame(rows, "scan int, z int, y int, x int, " + ", ".join(f"v{i} {kinds[a.dtype.kind]}" for i, a in enumerate(arrays)))


def beside(at, shape, moves):
    for o in moves:
        to = tuple(i + d for i, d in zip(at, o, strict=True))
        if all(0 <= i < n for i, n in zip(to, shape, strict=True)):
            yield o, to


def by_heap(open_, cost, moves, start):
    """Dijkstra, cell by cell."""
    dist = np.where(start & open_, 0.0, np.inf)
    heap = [(0.0, at) for at in zip(*np.nonzero(start & open_), strict=True)]
    while heap:
        d, at = heapq.heappop(heap)
        for o, to in beside(at, open_.shape, moves) if d <= dist[at] else ():
            w = sum(map(abs, o)) ** 0.5 * (cost[at] + cost[to]) / 2
            if open_[to] and d + w < dist[to]:
                dist[to] = d + w
                heapq.heappush(heap, (d + w, to))
    return dist


@pytest.mark.parametrize("edge", [3, 4, 64])
@pytest.mark.parametrize("moves", [26, 6])
def test_geodesics(spark, edge, moves):
    draw = np.random.default_rng(7)
    open_, cost = draw.random((9, 6, 10)) < (0.4 if moves == 26 else 0.7), draw.uniform(1, 3, (9, 6, 10))
    start = np.zeros(open_.shape, bool)
    start[0] = True
    vox = voxels(spark, open_, cost, start).withColumn("c", F.when(F.col("v0"), F.col("v1")))
    got = {(r["z"], r["y"], r["x"]): r["dist"] for r in settle.geodesic_distance(vox, "c", "v2", moves, edge).collect()}
    want = by_heap(open_, cost, EVERY if moves == 26 else SIX, start)
    assert set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(np.isfinite(want))), strict=True)) and len(got) > 50
    assert all(abs(want[at] - d) < 1e-9 for at, d in got.items())


def test_rounds_follow_bricks(spark):
    """A straight channel of 24 cells through bricks of 8: three bricks, so no more than four rounds."""
    open_ = np.ones((24, 1, 1), bool)
    start = np.arange(24)[:, None, None] == 0
    vox = voxels(spark, open_, start).withColumn("c", F.lit(1.0))
    rounds = []

    def solve(fixed, value, k):
        value = value.copy()
        for _ in range(24):
            np.minimum(value, settle._moved(value, (-1, 0, 0), np.inf) + 1, out=value)
        return np.where(np.isfinite(fixed), value, np.inf)

    bricks_ = settle.laid_out(vox.select("scan", "z", "y", "x", F.col("c").alias("f"), F.when(F.col("v1"), 0.0).otherwise(float("inf")).alias("v")), "f", "v", (np.inf, np.inf), 8, 1)
    scratch = Scratch(spark, "rounds")
    put = scratch.put
    scratch.put = lambda df, name: rounds.append(name) or put(df, name)
    done = settle.settled(scratch, bricks_, solve, 8, 1)
    assert len(rounds) <= 4 and {r["z"]: r["d"] for r in settle.cells(done, "d", 8, 1, lambda f, v: np.isfinite(v)).collect()} == {z: float(z) for z in range(24)}
    with pytest.raises(RuntimeError, match="still change"):
        settle.settled(Scratch(spark, "rounds"), bricks_, solve, 8, 1, max_rounds=1)


def reconstruct(height, mask, drop):
    level = np.where(mask, height - drop, -np.inf)
    while True:
        before = level.copy()
        for at in zip(*np.nonzero(mask), strict=True):
            level[at] = max([level[at], *[min(height[at], level[to]) for _, to in beside(at, mask.shape, SIX)]])
        if (level == before).all():
            return level


@pytest.mark.parametrize("edge", [4, 64])
def test_reconstruction(spark, edge):
    draw = np.random.default_rng(9)
    height, mask = draw.integers(0, 9, (8, 7, 9)).astype(float), draw.random((8, 7, 9)) < 0.8
    got = {(r["z"], r["y"], r["x"]): r["level"] for r in settle.reconstructed(voxels(spark, mask, height).where("v0"), "v1", 2.0, edge).collect()}
    want = reconstruct(height, mask, 2.0)
    assert got == {at: want[at] for at in zip(*map(np.ndarray.tolist, np.nonzero(mask)), strict=True)}


def parts(mask, moves):
    seen, n = np.zeros(mask.shape, int), 0
    for at in zip(*np.nonzero(mask), strict=True):
        if not seen[at]:
            n += 1
            seen[at], todo = n, [at]
            while todo:
                for _, to in beside(todo.pop(), mask.shape, moves):
                    if mask[to] and not seen[to]:
                        seen[to] = n
                        todo.append(to)
    return n


@pytest.mark.parametrize("share", [0.35, 0.75])
def test_skeleton(spark, share):
    draw = np.random.default_rng(6)
    mask = draw.random((17, 10, 9)) < share
    mask[2:8, 2:8, 1:8] = True
    whole = settle.thinned(mask)
    assert not (whole & ~mask).any() and parts(whole, EVERY) == parts(mask, EVERY)
    outer = lambda m: np.pad(~m, 1, constant_values=True)
    assert parts(outer(whole), SIX) == parts(outer(mask), SIX)
    on = voxels(spark, mask).where("v0")
    for edge, rim in ((8, 8), (8, 4), (64, 16)):
        got = {(r["z"], r["y"], r["x"]) for r in settle.skeleton(on, edge, rim).collect()}
        assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(whole)), strict=True)), (edge, rim)


def test_rods_become_lines():
    rod = np.zeros((12, 7, 7), bool)
    rod[1:11, 2:5, 2:5] = True
    thin = settle.thinned(rod)
    assert 0 < thin.sum() <= 14 and bricks.label(thin, 26).max() == 1


def flooded(height, markers, mask, shape):
    """The forest by Prim's rule over the whole array: the least edge by (height to climb to, ids) that leads out of what has a label."""
    out, heap = np.where(mask, markers, -1), []
    index = lambda at: int(np.ravel_multi_index(at, shape))

    def reach(at):
        for _, to in beside(at, shape, SIX):
            if mask[to] and out[to] < 0:
                a, b = index(at), index(to)
                heapq.heappush(heap, (max(height[at], height[to]), min(a, b), max(a, b), at, to))

    for at in zip(*map(np.ndarray.tolist, np.nonzero(mask & (markers >= 0))), strict=True):
        reach(at)
    while heap:
        *_, at, to = heapq.heappop(heap)
        if out[to] < 0:
            out[to] = out[at]
            reach(to)
    return out


@pytest.mark.parametrize("edge,one_task", [(4, 10_000), (5, 0), (64, 0)])
@pytest.mark.parametrize("kind", ["noise", "balls", "column"])
def test_watershed(spark, edge, one_task, kind):
    draw = np.random.default_rng(8)
    shape = (14, 9, 8)
    z, y, x = np.ogrid[:14, :9, :8]
    mask = draw.random(shape) < 0.75
    if kind == "balls":
        mask = sum((((z - a) ** 2 + (y - b) ** 2 + (x - c) ** 2) <= 10 for a, b, c in ((3, 3, 3), (8, 4, 4), (11, 5, 3))), np.zeros(shape, bool))
    elif kind == "column":
        mask = (np.abs(y - 4) <= 2) & (np.abs(x - 4) <= 2) & (z >= 0)
    h = 0.4
    got = watershed.instances(voxels(spark, mask).where("v0"), shape, h, edge, one_task).collect()
    places = [(r["z"], r["y"], r["x"]) for r in got]
    assert len(set(places)) == len(places) == mask.sum()
    dist = bricks.edt(np.pad(mask, 1))[1:-1, 1:-1, 1:-1]
    assert all(abs(dist[p] - r["d"]) < 1e-9 for p, r in zip(places, got, strict=True))
    top = bricks.label(mask & (dist - reconstruct(dist, mask, h) >= h - 1e-9), 26)
    names = np.full(top.max() + 1, -1)
    for k in range(1, len(names)):
        names[k] = np.flatnonzero(top.ravel() == k).min()
    want = flooded(-dist, names[top], mask, shape)
    assert {p: r["label"] for p, r in zip(places, got, strict=True)} == {p: want[p] for p in places}
    assert len(set(want[mask].tolist())) == {"balls": 3}.get(kind, len(set(want[mask].tolist())))


def test_forest_without_roots_and_edges(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.1), (3, 4, 0.9), (8, 9, 0.1)], "a long, b long, w double")
    for one_task in (0, 100):
        found = forest.rooted_forest(Scratch(spark, "forest"), edges, spark.createDataFrame([(1,), (4,)], "node long"), ["w"], one_task)
        assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (8, None), (9, None)]
    assert forest.rooted_forest(Scratch(spark, "forest"), edges.limit(0), spark.range(1).toDF("node"), ["w"]).count() == 0
