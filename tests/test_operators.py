"""Properties that the operators have to keep, and brute force on small inputs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import classify as c
from voxloom.functions import geometry as g
from voxloom.operators import bricks, components, field, graph, grid, inference, neighbours, series, spatial, stats
from voxloom.schema import ingest


def points(spark, n, seed, **more):
    draw = np.random.default_rng(seed)
    p = draw.random((n, 3))
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(p)], "id long, z double, y double, x double"), p


def test_radius_and_knn_match_brute_force(spark):
    df, p = points(spark, 150, 0)
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    got = {(r["a"], r["b"]) for r in spatial.radius_pairs(df, 0.2).collect()}
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= 0.2}
    near = neighbours.knn_join(df, df, 7, skip_self=True).collect()
    for i in range(150):
        assert [r["b"] for r in sorted((r for r in near if r["a"] == i), key=lambda r: r["rank"])] == [j for j in np.argsort(d[i], kind="stable") if j != i][:7]


@pytest.mark.parametrize("cell_points", [2, 7, 32])
def test_knn_of_keys_and_densities(spark, cell_points):
    """A dense clump, a sparse cloud, repeats, a line and outliers; keys, missing ones too; another side than its own."""
    draw = np.random.default_rng(5)
    p = np.concatenate([draw.normal(scale=1e-3, size=(90, 3)), draw.uniform(-5, 5, (60, 3)), np.repeat(draw.uniform(-1, 1, (1, 3)), 20, axis=0), np.outer(np.linspace(0, 3, 30), [1, 0, 0]), [[1e5, 0, 0], [0, -3e6, 0]]])
    keys = [None, "a", "b"]
    rows = [(i, keys[i % 3], *map(float, q)) for i, q in enumerate(p)] + [(900, "a", None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, k string, z double, y double, x double")
    other = df.where("id % 2 = 0")
    for left, right, self_out in ((df, df, True), (other, df, False)):
        got = {}
        for r in neighbours.knn_join(left, right, 4, ["k"], skip_self=self_out, cell_points=cell_points).collect():
            got.setdefault((r["k"], r["a"]), []).append((r["rank"], r["b"], r["d"]))
        for i, q in enumerate(p):
            if self_out or i % 2 == 0:
                want = sorted((float(np.sqrt(((q - p[j]) ** 2).sum())), j) for j in range(len(p)) if j % 3 == i % 3 and not (self_out and j == i))[:4]
                found = sorted(got[keys[i % 3], i])
                assert [b for _, b, _ in found] == [j for _, j in want] and np.allclose([d for *_, d in found], [d for d, _ in want])
        assert not any(a == 900 for _, a in got)
    assert neighbours.knn_join(df.limit(0), df, 2).count() == 0 and neighbours.knn_join(df, df.limit(0), 2).count() == 0


def test_knn_with_few_points(spark):
    df, _ = points(spark, 3, 1)
    assert neighbours.knn_join(df, df, 5, skip_self=True).count() == 6


def test_missing_coordinates_pair_with_nothing(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0), (2, 0.0, 0.0, 0.0)], "id long, z double, y double, x double")
    assert [(r["a"], r["b"]) for r in spatial.radius_pairs(df, 1.0).collect()] == [(0, 2)]


def test_injective_equals_greedy(spark):
    draw = np.random.default_rng(4)
    edges = [(int(a), int(b), float(round(w, 2))) for a, b, w in zip(draw.integers(0, 30, 150), draw.integers(100, 130, 150), draw.random(150), strict=True)]
    edges = list({(a, b): (a, b, w) for a, b, w in edges}.values())
    used, want = set(), set()
    for a, b, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    got = {(r["a"], r["b"]) for r in spatial.injective_match(spark.createDataFrame(edges, "a long, b long, d double")).collect()}
    assert got == want


def test_components_and_dbscan(spark, monkeypatch):
    df, p = points(spark, 120, 2)
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    for eps, least in ((0.12, 4), (0.2, 5)):
        core = [i for i in range(120) if (d[i] <= eps).sum() >= least]
        top = {i: i for i in core}
        for _ in core:
            for i, j in itertools.combinations(core, 2):
                if d[i, j] <= eps:
                    top[i] = top[j] = min(top[i], top[j])
        want = {i: top[i] if i in top else min((top[j] for j in core if d[i, j] <= eps), default=-1) for i in range(120)}
        got = {r["id"]: (r["core"], r["cluster"]) for r in graph.dbscan(df, eps, least).collect()}
        assert {i: v[1] for i, v in got.items()} == want and {i for i, v in got.items() if v[0]} == set(core)
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    for most in (0, 50, 10_000):
        monkeypatch.setattr(components, "ONE_TASK", most)
        got = graph.labelled_components(spark.range(203), chain).collect()
        assert {r["id"]: r["comp"] for r in got} == {k: 0 if k <= 200 else k for k in range(203)}


def test_uniform_gradient_is_recovered(spark):
    df, p = points(spark, 200, 3)
    h = np.array([[0.01, 0.002, 0.0], [-0.003, 0.02, 0.004], [0.001, 0.0, -0.01]])
    moved = df.select("*", *[sum((float(h[k, j]) * F.col(a) for j, a in enumerate("zyx")), F.lit(0.5)).alias(f"u{b}") for k, b in enumerate("zyx")])
    got = field.gradient(moved, neighbours.knn_join(df, df, 12, skip_self=True)).collect()
    assert len(got) == 200
    for r in got:
        assert np.allclose([r[f"h{k}"] for k in range(9)], h.ravel(), atol=1e-9)


def test_rotation_has_no_green_lagrange_strain(spark):
    a = math.radians(8)
    f = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]]) - np.eye(3)
    df = spark.createDataFrame([(1, *map(float, f.ravel()))], "id long, " + ", ".join(f"h{k} double" for k in range(9)))
    e = g.green_lagrange([F.col(f"h{k}") for k in range(9)])
    lin = g.green_lagrange([F.col(f"h{k}") for k in range(9)], linear=True)
    r = df.select(g.equivalent_strain(e).alias("e"), g.equivalent_strain(lin).alias("l")).first()
    assert r["e"] < 1e-12 and r["l"] > 1e-3
    t = field.rotations(df).first()
    assert abs(t["angle"] - 8) < 1e-9 and abs(t["vol"]) < 1e-12


def test_rigid_motion_is_removed(spark):
    df, p = points(spark, 100, 5)
    w = np.array([0.01, -0.02, 0.03])
    u = np.cross(w, p - p.mean(0)) + 0.7
    moved = spark.createDataFrame([(k, *map(float, (*a, *b))) for k, (a, b) in enumerate(zip(p, u, strict=True))], "id long, z double, y double, x double, uz double, uy double, ux double")
    assert max(abs(r[c]) for r in field.rigid_removed(moved).collect() for c in ("uz", "uy", "ux")) < 1e-12


def test_plane_fit(spark):
    draw = np.random.default_rng(6)
    n = np.array([0.6, 0.8, 0.0])
    u, v = np.array([0.0, 0, 1]), np.array([0.8, -0.6, 0])
    p = draw.normal(size=(300, 1)) * u + draw.normal(size=(300, 1)) * v * 2 + draw.normal(size=(300, 1)) * n * 0.01
    df = spark.createDataFrame([(1, *map(float, r)) for r in p], "k int, z double, y double, x double")
    r = stats.plane_fit(df, ["k"]).first()
    w = np.linalg.eigvalsh(np.cov(p.T, bias=True))
    assert np.allclose([r["l3"], r["l2"], r["l1"]], w, atol=1e-10) and abs(np.dot([r["nz"], r["ny"], r["nx"]], n)) > 0.999


def test_interpolation_and_running_total(spark):
    draw = np.random.default_rng(7)
    xs, ys = np.unique(draw.integers(0, 100, 30)), draw.random(30)
    knots = spark.createDataFrame([(float(a), float(b)) for a, b in zip(xs, ys, strict=False)], "x double, y double")
    ask = spark.createDataFrame([(float(k),) for k in range(-5, 106, 3)], "x double")
    got = {r["x"]: r["y"] for r in series.interpolate(ask, knots, "x", "y").collect()}
    assert all(abs(v - np.interp(k, xs, ys[: len(xs)])) < 1e-12 for k, v in got.items()) and len(got) == 37
    v = draw.random(500)
    df = spark.createDataFrame([(k, float(round(a, 2))) for k, a in enumerate(v)], "id long, v double")
    run = series.running_total(df, "v", "id", F.lit(1), "n", buckets=8).orderBy("v", "id").collect()
    assert [r["n"] for r in run] == list(range(1, 501))


def test_runs_peaks_and_bh(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([0, 1, 1, 0, 1, 1, 0, 0, 5, 0, 3, 3, 0])], "key int, pos long, v int")
    assert series.longest_run(df, "pos", F.col("v") >= 1, ["key"]).first().asDict() == {"key": 1, "start": 1, "end": 2, "n": 2}
    found = series.find_peaks(df, "pos", "v", ["key"], 2, 3, 1.0).collect()
    assert [(r["pos"], r["prominence"]) for r in found] == [(8, 5.0)]
    assert [r["pos"] for r in series.find_peaks(df, "pos", "v", ["key"], 2, 1, 1.0).collect()] == [8, 10]
    p = spark.createDataFrame([(k, v) for k, v in enumerate([0.01, 0.04, None, 0.03, 0.5])], "id int, p double")
    got = {r["id"]: r["p_bh"] for r in series.benjamini_hochberg(p, "p", "id").collect()}
    assert got[2] is None and np.allclose([got[0], got[1], got[3], got[4]], [0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.25,), (0.51,), (None,)], "q double")
    n = {r["bin"]: r["n"] for r in stats.histogram(df, F.col("q"), 0.0, 0.5, 25).collect()}
    assert len(n) == 25 and n[24] == 1 and n[0] == 1 and sum(n.values()) == 3


def test_classes_have_a_rule_for_null(spark):
    df = spark.createDataFrame([(None, 0.9, None, True, 300.0), (0.9, 0.1, 0.1, False, 300.0), (0.9, 0.9, None, True, 10.0), (0.1, 0.1, 0.3, True, 200.0)], "a double, b double, q double, c boolean, k double")
    got = df.select(c.face_class(F.col("a"), F.col("b")).alias("f"), c.q_class(F.col("k"), F.col("q")).alias("q"), c.q_class(F.col("k"), F.col("q"), F.col("c")).alias("o")).collect()
    assert [r["f"] for r in got] == ["unmeasured", "adhesive", "cohesive", "stripped"]
    assert [r["q"] for r in got] == ["mixed", "adhesive", "intact", "cohesive"] and [r["o"] for r in got] == ["mixed", "detached", None, "cohesive"]
    nan = spark.createDataFrame([(1.0, "a"), (float("nan"), "")], "v double, s string")
    assert [tuple(r) for r in ingest(nan).collect()] == [(1.0, "a"), (None, None)]


def volume(spark, mask):
    z, y, x = np.indices(mask.shape).reshape(3, -1)
    return spark.createDataFrame([(0, int(a), int(b), int(e), bool(m)) for a, b, e, m in zip(z, y, x, mask.ravel(), strict=True)], "scan int, z int, y int, x int, m boolean")


def test_grid_against_arrays(spark):
    draw = np.random.default_rng(8)
    mask = draw.random((6, 7, 8)) < 0.55
    vox = volume(spark, mask)
    on = vox.where("m")
    where = lambda df: {(r["z"], r["y"], r["x"]) for r in df.collect()}
    cross = np.zeros((3, 3, 3), bool)
    cross[1, 1], cross[1, :, 1], cross[:, 1, 1] = True, True, True
    assert where(grid.eroded(on)) == set(zip(*map(np.ndarray.tolist, np.nonzero(bricks.morph(mask, cross, False))), strict=True))
    wide = bricks.morph(np.pad(mask, 1), cross, True)
    assert where(grid.dilated(on)) == {(a - 1, b - 1, e - 1) for a, b, e in zip(*map(np.ndarray.tolist, np.nonzero(wide)), strict=True)}
    for k, brick in ((6, 64), (26, 64), (6, 3), (26, 3)):
        comp = {(r["z"], r["y"], r["x"]): r["comp"] for r in grid.labelled(on, mask.shape, k, brick=brick).collect()}
        lab = bricks.label(mask, k)
        pairs = {(comp[a], lab[a]) for a in comp}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == lab.max()
    assert where(grid.filled(on, vox, mask.shape)) == set(zip(*map(np.ndarray.tolist, np.nonzero(bricks.fill_holes(mask))), strict=True))
    got = {(r["z"], r["y"], r["x"]): r["d"] for r in bricks.distance_transform(vox, "m").collect()}
    off = np.argwhere(~mask)
    for at in np.argwhere(mask).tolist():
        assert abs(got[tuple(at)] - np.sqrt(((off - at) ** 2).sum(1).min())) < 1e-9


def test_diagonal_connectivity(spark):
    mask = np.zeros((3, 3, 3), bool)
    mask[0, 0, 0] = mask[1, 1, 1] = mask[2, 2, 2] = True
    on = volume(spark, mask).where("m")
    assert grid.labelled(on, mask.shape, 6).select("comp").distinct().count() == 3
    comps = grid.labelled(on, mask.shape, 26)
    assert comps.select("comp").distinct().count() == 1 and grid.percolation(comps, 3).first()["percolates"]


def test_kernels():
    z, y, x = np.ogrid[:22, :14, :14]
    ball = np.sqrt((z - 11.0) ** 2 + (y - 7.0) ** 2 + (x - 7.0) ** 2)
    assert abs(bricks.surface_area(5.0 - ball, 0.0) / (4 * np.pi * 25) - 1) < 0.03
    assert np.allclose(bricks.diffusion_tortuosity(np.ones((6, 4, 4), bool))[:2], (1.0, 1.0), atol=1e-5)
    half = np.zeros((6, 4, 4), bool)
    half[:, :2] = True
    assert np.allclose(bricks.diffusion_tortuosity(half)[:2], (0.5, 1.0), atol=1e-5)
    layers = np.ones((4, 4, 4), int)
    layers[2:] = 2
    one, _ = bricks.homogenised(np.ones((4, 4, 4), int), {1: (1.0, 2.0)})
    assert np.allclose(one[0, 0], 5.0) and np.allclose(one[3, 3], 2.0) and np.allclose(one[0, 1], 1.0)
    mixed, _ = bricks.homogenised(layers, {1: (1.0, 1.0), 2: (2.0, 2.0)}, 1e-6, 400)
    assert abs(mixed[0, 0] - 2 / (1 / 3 + 1 / 6)) < 1e-2 and abs(mixed[5, 5] - 2 / (1 + 1 / 2)) < 0.6
    z, y, x = np.ogrid[:48, :23, :23]
    left, right = (z - 11) ** 2 + (y - 11) ** 2 + (x - 11) ** 2 <= 100, (z - 36) ** 2 + (y - 11) ** 2 + (x - 11) ** 2 <= 100
    labels = np.where(left, 1, np.where(right, 2, 0))
    of = {"pair": (1, 2), "radii": (10.0, 10.0)}
    centres = (np.array([11.0, 11, 11]), np.array([36.0, 11, 11]))
    filled = np.where(labels > 0, 3, 2)
    none = np.zeros(labels.shape, bool)
    t = bricks.throat(labels, filled, none, centres=centres, **of)
    assert t["connected"] and t["dsum_min"] == 5 and t["gap_vox"] == 4 and t["crack_vox"] == 0 and t["binder_frac"] == 1 and abs(t["axis_dip_deg"]) < 1e-6 and t["neck_severed"] == 0 and 0.2 <= t["q_binder"] <= 0.5
    empty = np.where(labels > 0, 3, 1)
    t = bricks.throat(labels, empty, empty == 1, centres=centres, **of)
    assert not t["connected"] and t["crack_frac"] == 1 and t["pore_vox"] == 0 and t["neck_severed"] == 1
    assert bricks.throat(np.where(left, 1, 0), filled, none, centres=centres, **of) is None
    grey = np.where(labels > 0, 200.0, 50.0)
    half_filled = np.where((filled == 2) & (z < 24), 2, empty)
    cover = [bricks.face_cover(grey, labels, p, none, half=125.0, **of) for p in (filled, empty, half_filled)]
    assert cover[0]["cover_a"] == cover[0]["cover_b"] == 1.0 and cover[1]["cover_a"] == cover[1]["cover_b"] == 0.0
    assert cover[2]["cover_a"] > 0.5 > cover[2]["cover_b"]
    assert np.allclose(bricks.finer(np.array([[0.0, 3.0]]), 3), [[0, 1, 2, 3]]) and bricks.finer(np.array([[0, 3]]), 3, True).tolist() == [[0, 0, 3, 3]]
    hole = np.ones((9, 9), bool)
    hole[4, 4] = False
    assert bricks.closed_slice(hole, 2, 0).all()


def test_segments_and_paths(spark):
    vox = spark.createDataFrame([(k, k in (0, 4, 9), float(k)) for k in range(10)], "id long, is_node boolean, d double")
    links = spark.createDataFrame([(k, k + 1) for k in range(9)], "a long, b long")
    got = sorted((r["node_a"], r["node_b"], r["length"], r["thick"]) for r in graph.segments(vox, links).collect())
    assert got == [(0, 4, 4, 2.0), (4, 9, 5, 6.5)]
    some = spark.createDataFrame([(1, True, 1.0), (2, True, 2.0), (3, False, 9.0), (4, True, 4.0), (20, False, 1.0), (21, False, 1.0), (22, False, 1.0)], vox.schema)
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (20, 21), (21, 22), (20, 22)], "a long, b long")
    got = sorted((tuple(r) for r in graph.segments(some, ring).collect()), key=str)
    assert got == sorted([(None, 1, 2, 1, 1.5), (3, 2, 4, 2, 3.0), (20, None, None, 4, None)], key=str)
    dist = {r["id"]: r["dist"] for r in graph.shortest_paths(vox, links.withColumn("w", F.lit(2.0)), spark.range(1)).collect()}
    assert dist == {k: 2.0 * k for k in range(10)}


def test_frames_are_checked(spark):
    good = spark.createDataFrame([(1, "raw", 3, 3, 3), (2, "raw", 3, 3, 3)], "scan int, frame string, nz int, ny int, nx int")
    assert grid.checked_frames(good).count() == 2
    with pytest.raises(Exception, match="frames or shapes"):
        grid.checked_frames(good.withColumn("frame", F.when(F.col("scan") == 1, "raw").otherwise("aligned"))).collect()


def test_samples_are_exact_and_repeat(spark):
    df = spark.range(1000)
    a = {r["id"] for r in stats.exact_sample(df, 50, "id", 3).collect()}
    assert len(a) == 50 and a == {r["id"] for r in stats.exact_sample(df, 50, "id", 3).collect()}
    n = stats.resampled(df, 20, 5, "id", 1).groupBy("replica").count().collect()
    assert [r["count"] for r in n] == [20] * 5


def test_model_over_bricks(spark):
    from voxloom.sources.volumes import bricked

    mask = np.zeros((8, 8, 8), bool)
    mask[:4] = True
    b = bricked(volume(spark, mask), "m", 4, 1)
    got = bricks.predict_bricks(b, lambda v: np.stack([-v, v]), 1).collect()
    assert len(got) == 8 and {r["bz"]: set(r["classes"]) for r in got} == {0: {1}, 1: {0}}


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_exact_percentiles(spark, n):
    draw = np.random.default_rng(n)
    v = np.concatenate([np.round(draw.normal(size=n), 2), np.full(n // 3, 0.5)])
    df = spark.createDataFrame([(k % 2 if n > 2 else 0, float(x)) for k, x in enumerate(v)] + [(0, None)], "k int, v double")
    at = [0.0, 0.05, 0.5, 0.98, 1.0]
    got = {(r["k"], r["p"]): r["v"] for r in stats.exact_percentiles(df, "v", at, ["k"]).collect()}
    for k in {a for a, _ in got}:
        own = [x for j, x in enumerate(v) if (j % 2 if n > 2 else 0) == k]
        assert np.allclose([got[k, p] for p in at], np.quantile(own, at), atol=1e-12)
    whole = {r["p"]: r["v"] for r in stats.exact_percentiles(df, "v", at).collect()}
    assert np.allclose([whole[p] for p in at], np.quantile(v, at), atol=1e-12)


def test_delaunay(spark):
    draw = np.random.default_rng(9)
    p = draw.random((60, 3))
    t = field.delaunay(p)
    vol = np.abs(np.linalg.det(p[t[:, 1:]] - p[t[:, :1]])) / 6
    for cell in t:
        m = p[cell[1:]] - p[cell[0]]
        c = np.linalg.solve(2 * m, (m * m).sum(axis=1))
        others = np.delete(np.arange(60), cell)
        assert (((p[others] - p[cell[0]] - c) ** 2).sum(axis=1) >= (c * c).sum() - 1e-6).all()
    cube = np.array(list(itertools.product((0.0, 1.0), repeat=3)))
    t8 = field.delaunay(np.vstack([cube, p]))
    assert abs((np.abs(np.linalg.det(np.vstack([cube, p])[t8[:, 1:]] - np.vstack([cube, p])[t8[:, :1]])) / 6).sum() - 1) < 1e-6 and vol.sum() < 1
    h = np.array([[0.01, 0.002, 0.0], [-0.003, 0.02, 0.004], [0.001, 0.0, -0.01]])
    df = spark.createDataFrame([(0, k, *map(float, a), *map(float, h @ a)) for k, a in enumerate(p)], "label int, id long, z double, y double, x double, uz double, uy double, ux double")
    got = field.tetra_gradients(df, "label").collect()
    assert len(got) > 100 and all(np.allclose([r[f"h{k}"] for k in range(9)], h.ravel(), atol=1e-6) for r in got)


def test_clustering_sweep(spark):
    """Broken points that lie in a plane stand out against draws from a cloud; points broken at random don't."""
    draw = np.random.default_rng(10)
    cloud = draw.random((200, 3)) * 10
    sheet = np.column_stack([np.full(30, 5.0) + draw.normal(0, 0.02, 30), draw.random(30) * 3, draw.random(30) * 3])
    p = np.vstack([cloud, sheet])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(p)], "id long, z double, y double, x double")
    r = inference.clustering_sweep(df, df.where("id >= 200"), 0.5, (1.0,), 40, 3).first()
    assert r["biggest"] >= 20 and r["p_biggest"] == 0 and r["rms_r"] < 0.1 and r["frac_in"] > 0.6
    r = inference.clustering_sweep(df, df.where("id < 30"), 0.5, (1.0,), 40, 3).first()
    assert r["p_biggest"] > 0.05
    assert r["clusters"] == 0 or r["rms_r"] > 0


def test_outline_seed_recovers_pairs(spark):
    """A leaning column that is stretched, shifted and widened by more than the tolerance: without a seed hardly a pair is right, with it all are."""
    draw = np.random.default_rng(12)
    n = 600
    z, r, t = draw.uniform(0, 10, n), np.sqrt(draw.random(n)), draw.uniform(0, 2 * np.pi, n)
    a = np.stack([z, 3 + 0.1 * z + r * np.cos(t), 2 - 0.05 * z + r * np.sin(t)], axis=1)
    mid = np.stack([3 + 0.1 * z, 2 - 0.05 * z], axis=1)
    wide = 1.3 + 0.05 * z
    b = np.column_stack([5 + 1.2 * z, mid + [2.0, -1.0] + (a[:, 1:] - mid) * wide[:, None]]) + draw.normal(scale=0.003, size=(n, 3))
    frame = lambda p: spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, z double, y double, x double")
    source, target = frame(a), frame(b)
    seed = field.outline_seed(source, target, 6, 30)
    follow = lambda start: spatial.follow(source, target, 0.25, 8, 4, 10, start)
    right = lambda found: sum(r["a"] == r["b"] for r in found.collect())
    assert right(follow(seed)) > 0.9 * n > 10 * right(follow(None))
    few = field.outline_seed(source.limit(3), target, 6, 30).collect()
    assert len(few) == 3 and all(r["sy"] == 0 and r["sx"] == 0 for r in few)


def test_edges_are_kept_by_scan(spark):
    edges = spark.createDataFrame([(1, 5.0, 5.0), (1, 5.0, None), (1, 6.0, 6.0), (2, 9.0, 9.0), (None, 7.0, 7.0), (None, 8.0, 8.0)], "scan int, length double, thick double")
    got = sorted(((r["scan"], r["length"]) for r in graph.kept_edges(edges, 5.0, 5.0, 2).collect()), key=str)
    assert got == sorted([(1, 5.0), (1, 6.0), (None, 7.0), (None, 8.0)], key=str)
