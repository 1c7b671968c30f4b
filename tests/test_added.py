"""Operators by ranges, principal axes, kernels and stores against plain NumPy and Python on random inputs."""

import itertools
import json
import math
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.operators import bricks, graph, grid, series, settle, stats
from voxloom.sources import sinks, tables, volumes
from voxloom.sources.volume_source import open_volumes


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_running_total_within_keys(spark):
    draw = np.random.default_rng(1)
    data = [(int(k == 9), int(i), float(v) if v < 8 else None, float(w)) for i, (k, v, w) in enumerate(zip(draw.integers(0, 10, 400), draw.integers(0, 9, 400), draw.integers(1, 5, 400), strict=True))]
    got = series.running_total(frame(spark, data, "k int, id long, v double, w double"), "v", "id", F.col("w"), "run", ["k"], 7).collect()
    want = {}
    for key in (0, 1):
        run = 0.0
        for _, i, _, w in sorted((r for r in data if r[0] == key), key=lambda r: (r[2] is not None, r[2] or 0.0, r[1])):
            run += w
            want[i] = run
    assert {r["id"]: r["run"] for r in got} == want


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_adjustment_by_ranges(spark, keys):
    draw = np.random.default_rng(2)
    data = [(int(i % 3), int(i), None if i % 11 == 0 else float(round(p, 2))) for i, p in enumerate(draw.random(300))]
    got = {r["id"]: r["p_bh"] for r in series.benjamini_hochberg(frame(spark, data, "k int, id long, p double"), "p", "id", keys, buckets=9).collect()}
    for group in [[r for r in data if r[0] == k] for k in range(3)] if keys else [data]:
        have = sorted((r for r in group if r[2] is not None), key=lambda r: (r[2], r[1]))
        least = 1.0
        for rank in range(len(have), 0, -1):
            least = min(least, have[rank - 1][2] * len(have) / rank)
            assert abs(got[have[rank - 1][1]] - least) < 1e-12
    assert all(got[i] is None for _, i, p in data if p is None) and len(got) == len(data)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_interpolation_by_ranges(spark, keys):
    draw = np.random.default_rng(3)
    knots = [(k, float(x), float(y)) for k in (0, 1) for x, y in zip(draw.integers(0, 500, 90), draw.random(90), strict=True)]
    asked = [(k, float(x)) for k in (0, 1) for x in draw.uniform(-20, 520, 120)] + [(0, 250.0), (1, 250.0)]
    got = series.interpolate(frame(spark, asked, "k int, x double"), frame(spark, knots, "k int, x double, y double"), "x", "y", keys, 11).collect()
    assert len(got) == len(asked)
    for r in got:
        of = {}
        for k, x, y in knots:
            if not keys or k == r["k"]:
                of[x] = max(y, of.get(x, -1.0))
        xs = sorted(of)
        assert abs(r["y"] - np.interp(r["x"], xs, [of[x] for x in xs])) < 1e-9


def test_draws_are_those_of_the_least_hashes(spark):
    points = spark.range(500).select("id", (F.col("id") % 4).alias("band"), F.lit(0.0).alias("y"))
    h = points.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("h", F.md5(F.concat_ws(":", F.lit("9"), F.col("replica").cast("string"), F.col("id").cast("string")).cast("binary"))).toPandas()
    for size in (3, 60, 490, 900):
        got = stats.resampled(points, size, 6, "id", 9).toPandas()
        for k in range(6):
            want = h[h.replica == k].sort_values("h").id[:size]
            assert set(got[got.replica == k].id) == set(want) and len(got[got.replica == k]) == len(want)
    want = frame(spark, [(0, 5), (1, 200), (3, 1)], "band long, want long")
    got = stats.stratified(points, want, "band", 6, "id", 9).toPandas()
    for k, (band, n) in itertools.product(range(6), ((0, 5), (1, 200), (2, 0), (3, 1))):
        own = h[(h.replica == k) & (h.band == band)].sort_values("h").id[:n]
        assert set(got[(got.replica == k) & (got.band == band)].id) == set(own)


def test_spine_along_the_principal_axis(spark):
    draw = np.random.default_rng(4)
    data, want = [], {}
    for comp, n in ((1, 70), (2, 9), (3, 5), (4, 4)):
        x = draw.normal(size=(n, 3)) * draw.permutation([4.0, 1.0, 0.4]) + draw.normal(size=3)
        data += [(comp, *map(float, p)) for p in x]
        if n < 5:
            continue
        mid = x - x.mean(axis=0)
        axis = np.linalg.svd(mid, full_matrices=False)[2][0]
        axis = axis * np.sign(axis[0])
        t = mid @ axis
        bins = min(16, max(2, n // 4))
        edges = np.linspace(t.min(), t.max(), bins + 1)
        inside = [(t >= a - 1e-12) & (t <= b + 1e-12) for a, b in zip(edges, edges[1:], strict=False)]
        want[comp] = (t.max() - t.min(), {k: x[s].mean(axis=0) for k, s in enumerate(inside) if s.any()})
    got = graph.crack_paths(frame(spark, data, "comp int, z double, y double, x double")).toPandas()
    assert set(got.comp) == set(want)
    for comp, own in got.groupby("comp"):
        length, spine = want[comp]
        assert np.allclose(own.length, length) and set(own.bin) == set(spine)
        for r in own.itertuples():
            assert np.allclose([r.z, r.y, r.x], spine[r.bin])


def test_joint_p_and_flags(spark):
    null = frame(spark, [("a", float(i), float(10 - i)) for i in range(10)] + [("b", 1.0, 1.0)], "t string, n double, p double")
    seen = frame(spark, [("a", 6.0, 2.0), ("b", 5.0, 5.0), ("c", 1.0, 1.0)], "t string, n double, p double")
    got = {r["t"]: r["p"] for r in stats.joint_tail_p(null, seen, ["n", "p"], ["t"]).collect()}
    assert got == {"a": 0.3, "b": 0.5, "c": 1.0}
    flags = stats.flags_against_chance(frame(spark, [(0.01,), (0.5,), (None,)], "p double"), F.col("p") <= 0.05, 0.05).first()
    assert (flags["tests"], flags["hits"], round(flags["expected"], 6)) == (3, 1, 0.15)


def test_contrast(spark):
    draw = np.random.default_rng(5)
    data = pd.DataFrame({"phase": draw.integers(1, 4, 300), "v": draw.normal(100, 20, 300)})
    r = stats.contrast(spark.createDataFrame(data), "v", "phase", 2, 3).first()
    a, b = data[data.phase == 2].v, data[data.phase == 3].v
    assert abs(r["snr"] - b.mean() / b.std(ddof=0)) < 1e-9 and abs(r["cnr"] - abs(b.mean() - a.mean()) / math.sqrt((a.var(ddof=0) + b.var(ddof=0)) / 2)) < 1e-9


def flood(mask, moves):
    """Components by a flood from each cell in turn."""
    out, k = np.zeros(mask.shape, int), 0
    for at in zip(*np.nonzero(mask), strict=True):
        if out[at]:
            continue
        k += 1
        stack = [at]
        out[at] = k
        while stack:
            c = stack.pop()
            for o in moves:
                to = tuple(i + d for i, d in zip(c, o, strict=True))
                if all(0 <= i < n for i, n in zip(to, mask.shape, strict=True)) and mask[to] and not out[to]:
                    out[to] = k
                    stack.append(to)
    return out


@pytest.mark.parametrize("connectivity", [6, 26])
def test_components_across_bricks(spark, connectivity):
    """Random masks, bricks of 4, against a flood."""
    draw = np.random.default_rng(connectivity)
    moves = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o) and (connectivity == 26 or sum(map(abs, o)) == 1)]
    mask = draw.random((11, 9, 10)) < (0.3 if connectivity == 6 else 0.12)
    vox = frame(spark, [(0, *map(int, p)) for p in np.argwhere(mask)], "scan int, z int, y int, x int")
    got = grid.labelled(vox, mask.shape, connectivity, brick=4).toPandas()
    want = flood(mask, moves)[tuple(got[list("zyx")].to_numpy().T)]
    assert len(set(zip(want, got.comp, strict=True))) == len(set(want)) == got.comp.nunique() and len(got) == mask.sum()
    assert (got["size"] == got.groupby("comp").comp.transform("size")).all()


def test_simple_points_and_thinning():
    """A voxel is simple if neither the object's nor the background's components change in its cube; thinning keeps all of them."""
    draw = np.random.default_rng(6)
    every = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
    six, eighteen = [o for o in every if sum(map(abs, o)) == 1], [o for o in every if sum(map(abs, o)) <= 2]
    for p in (0.1, 0.3, 0.5, 0.8):
        for _ in range(80):
            cube = draw.random((3, 3, 3)) < p
            cube[1, 1, 1] = False
            bits = sum(1 << i for i, o in enumerate(every) if cube[o[0] + 1, o[1] + 1, o[2] + 1])
            shell = np.zeros((3, 3, 3), bool)
            for o in eighteen:
                shell[o[0] + 1, o[1] + 1, o[2] + 1] = not cube[o[0] + 1, o[1] + 1, o[2] + 1]
            back = flood(shell, six)
            faces = {back[o[0] + 1, o[1] + 1, o[2] + 1] for o in six} - {0}
            assert bricks.simple_point(bits) == (flood(cube, every).max() == 1 and len(faces) == 1)
    for _ in range(4):
        mask = draw.random((9, 10, 8)) < 0.4
        thin = settle.thinned(mask)
        count = lambda m, moves: flood(m, moves).max()
        assert not (thin & ~mask).any() and count(thin, every) == count(mask, every)
        assert count(np.pad(~thin, 1, constant_values=True), six) == count(np.pad(~mask, 1, constant_values=True), six)


def test_distances_stop_early():
    draw = np.random.default_rng(9)
    for share in (0.02, 0.3, 0.9):
        mask = draw.random((9, 11, 7)) >= share
        mask[0, 0, 0] = False
        want = np.sqrt(((np.argwhere(mask)[:, None] - np.argwhere(~mask)[None]) ** 2).sum(axis=2).min(axis=1))
        assert np.allclose(bricks.edt(mask)[mask], want)


def test_surface_over_bricks(spark):
    draw = np.random.default_rng(10)
    mask = draw.random((10, 9, 8)) < 0.5
    vox = frame(spark, [(3, *map(int, p)) for p in np.argwhere(mask)], "scan int, z int, y int, x int")
    want = bricks.surface_area(np.pad(mask.astype(float), 1), 0.5)
    for edge in (3, 4, 64):
        assert abs(bricks.surface_areas(vox, edge).first()["area"] - want) < 1e-6


def test_envelopes_and_masks(spark):
    """Closing by distance and specimen masks of random slices, by definition."""
    draw = np.random.default_rng(11)
    y, x = np.indices((14, 13))
    far = lambda m: np.sqrt(np.min([(y - a) ** 2 + (x - b) ** 2 for a, b in np.argwhere(m)], axis=0)) if m.any() else np.full(m.shape, np.inf)

    def closed(mask, radius, skin):
        wide = np.pad(mask, 6)
        yy, xx = np.indices(wide.shape)
        d = lambda m: np.sqrt(np.min([(yy - a) ** 2 + (xx - b) ** 2 for a, b in np.argwhere(m)], axis=0)) if m.any() else np.full(m.shape, np.inf)
        shut = d(~(d(wide) <= radius)) > radius
        back = flood(~shut, [(0, 1), (0, -1), (1, 0), (-1, 0)])
        shut = shut | ((back > 0) & (back != back[0, 0]))
        return (d(shut) <= skin)[6:-6, 6:-6]

    for p in (0.05, 0.2, 0.5):
        mask = draw.random((14, 13)) < p
        assert (bricks.closed_slice(mask, 2.0, 1.0) == closed(mask, 2.0, 1.0)).all()
    assert np.isinf(far(np.zeros((14, 13), bool))).all()


def test_solvers_say_when_they_dont_converge():
    draw = np.random.default_rng(12)
    phase = draw.random((6, 5, 5)) < 0.8
    d_eff, tau, residual = bricks.diffusion_tortuosity(phase, rounds=2)
    assert math.isnan(d_eff) and math.isnan(tau) and residual > 1e-6
    assert bricks.diffusion_tortuosity(phase)[2] <= 1e-6
    cell = draw.integers(1, 3, (4, 4, 4))
    c, worst = bricks.homogenised(cell, {1: (1.0, 1.0), 2: (9.0, 9.0)}, 1e-6, 2)
    assert np.isnan(c).all() and worst > 1e-6
    c, worst = bricks.homogenised(cell, {1: (1.0, 1.0), 2: (9.0, 9.0)}, 1e-6)
    assert np.isfinite(c).all() and worst < 1e-6 and np.allclose(c, c.T, atol=1e-3)


def test_workbook_cells(spark, tmp_path):
    rows = [(1, 'a & <b> "c"', 0.5, True), (None, None, None, None), (2, " spaced\nline ", -1e-7, False)]
    path = f"file://{tmp_path}/w.xlsx"
    sinks.write_workbook({"one": frame(spark, rows, "id long, s string, v double, b boolean"), "t&w": frame(spark, [(7,)], "id long")}, path)
    got = tables.read_workbook(spark, path, "one", "v double, id long, s string, b boolean, gone string").collect()
    assert [(r["id"], r["s"], r["v"], r["b"], r["gone"]) for r in got] == [(*r, None) for r in rows]
    assert tables.read_workbook(spark, path, "t&w", "id long").collect()[0]["id"] == 7
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(f"{tmp_path}/w.xlsx") as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>sp</t></r><r><t>lit</t></r></si></sst>'.encode()
    parts["xl/worksheets/sheet2.xml"] = f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c><c r="AA1" t="s"><v>1</v></c></row><row r="2"><c r="AA2"><v>2.5</v></c></row></sheetData></worksheet>'.encode()
    with zipfile.ZipFile(f"{tmp_path}/x.xlsx", "w") as z:
        for n, raw in parts.items():
            z.writestr(n, raw)
    assert tuple(tables.read_workbook(spark, f"file://{tmp_path}/x.xlsx", "t&w", "id long, split double").first()) == (None, 2.5)
    with pytest.raises(KeyError, match="no sheet"):
        tables.workbook_rows((tmp_path / "w.xlsx").read_bytes(), "other")


@pytest.mark.parametrize("packer", [None, "zlib", "gzip"])
def test_array_store(spark, tmp_path, packer):
    v = np.arange(5 * 7 * 4, dtype="<i4").reshape(5, 7, 4)
    (tmp_path / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [5, 7, 4], "chunks": [2, 3, 4], "dtype": "<i4", "compressor": packer and {"id": packer}, "fill_value": -1, "order": "F", "filters": None, "dimension_separator": "-"}))
    for a, b in itertools.product(range(3), range(3)):
        if (a, b) == (1, 1):
            continue  # a chunk that doesn't exist
        part = np.zeros((2, 3, 4), "<i4")
        own = v[2 * a : 2 * a + 2, 3 * b : 3 * b + 3]
        part[tuple(slice(0, n) for n in own.shape)] = own
        raw = part.tobytes(order="F")
        engine = zlib.compressobj(wbits=31 if packer == "gzip" else 15)
        (tmp_path / f"{a}-{b}-0").write_bytes(raw if packer is None else engine.compress(raw) + engine.flush())
    got = {(r["z"], r["y"], r["x"]): r["value"] for r in open_volumes(spark, f"file://{tmp_path}", "zarr").collect()}
    want = v.astype(float)
    want[2:4, 3:6] = -1
    assert got == {at: want[at] for at in np.ndindex(v.shape)}


def test_morphology_with_an_element():
    """Opening and closing of a random mask by discs, by definition."""
    draw = np.random.default_rng(13)
    mask, disc = draw.random((12, 11)) < 0.5, bricks.disc(2)
    spots = [tuple(o) for o in np.argwhere(disc) - 2]
    inside = lambda m, a, b: 0 <= a < 12 and 0 <= b < 11 and m[a, b]
    grow = lambda m: np.array([[any(inside(m, a + o[0], b + o[1]) for o in spots) for b in range(11)] for a in range(12)])
    shrink = lambda m: np.array([[all(inside(m, a + o[0], b + o[1]) for o in spots) for b in range(11)] for a in range(12)])
    assert (bricks.morph(bricks.morph(mask, disc, True), disc, False) == shrink(grow(mask))).all()
    assert (bricks.morph(bricks.morph(mask, disc, False), disc, True) == grow(shrink(mask))).all()
