"""Findings of round 4: whole jobs that took too long, or more memory than a task has."""

import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import bricks, settle


def cover_by_hand(grey, labels, phase, crack, pair, radii, half, least, least_shell):
    """``bricks.face_cover`` from distances over the whole fine grid."""
    lab, ph, broken = (bricks.finer(v, 3, True) for v in (labels, phase, crack))
    solid = bricks.finer(grey, 3) >= half
    a, b, beads = solid & (lab == pair[0]), solid & (lab == pair[1]), solid & (lab > 0)
    free = (ph > 0) & ~beads
    if not a.any() or not b.any() or not free.any():
        return None
    m = bricks._lens(a, b, beads & ~a & ~b, free, radii, 3)
    if m["lens"].sum() < least:
        return None
    out = {"gap_sub_vox": m["gap"]}
    for name, d in (("a", m["da"]), ("b", m["db"])):
        shell = m["lens"] & (d >= bricks.SHELL[0]) & (d <= bricks.SHELL[1])
        enough = shell.sum() >= least_shell
        out |= {f"cover_{name}": (ph[shell] == 2).mean() if enough else np.nan, f"crack_at_{name}": broken[shell].mean() if enough else np.nan}
    return out


def test_face_covers_look_near_the_lens_only(monkeypatch):
    """Bodies that touch, lie apart or miss, in flat and long boxes: what the whole grid tells, without distances over the whole grid."""
    cases = []
    for seed in range(24):
        draw = np.random.default_rng(seed)
        shape = tuple(draw.integers(3, 16, 3)) if seed % 3 else (20, 12, 12)
        grey = draw.uniform(900, 105_000, shape) if seed % 4 == 0 else np.where(draw.random(shape) < (0.3, 0.05, 0.01)[seed % 4 - 1], 90_000.0, draw.uniform(900, 30_000, shape))
        phase = np.where(grey < 25_000, 1, np.where(grey < 45_000, 2, 3))
        labels = np.where(phase == 3, np.tensordot([1, 3, 9], np.indices(shape) // 6, 1) + 1, 0)
        for pair, radii in (((1, 2), (3.7, 3.9)), ((2, 10), (0.5, 30.0)), ((1, 4), (0.2, 0.3))):
            of = (grey, labels, phase, phase == 1, pair, radii, 25_000.0)
            cases.append((of, cover_by_hand(*of, 20, 10)))
    assert 20 < sum(want is not None for _, want in cases) < len(cases)
    monkeypatch.setattr(bricks, "edt", None)
    for of, want in cases:
        got = bricks.face_cover(*of, least=20, least_shell=10)
        assert (got is None) == (want is None)
        assert got is None or got.keys() == want.keys() and all(np.array_equal(got[k], want[k], equal_nan=True) for k in want)


def test_bricks_are_held_compressed(spark):
    """A brick of few kinds of cells takes a small part of its arrays' bytes, and no batch of several bricks is made of it."""
    vox = spark.range(64**3).select(F.lit(0).alias("scan"), *[(F.floor(F.col("id") / 64**k) % 64).cast("int").alias(a) for k, a in enumerate("xyz")], F.lit(1.0).alias("f"), F.when(F.col("id") < 4096, 0.0).otherwise(float("inf")).alias("v"))
    made = settle.laid_out(vox, "f", "v", (np.inf, np.inf), 64, 1)
    (row,) = made.collect()
    assert len(row.fixed) + len(row.value) < 2 * 66**3 * 8 / 50
    back = settle._unpacked(row.value, np.float64, (66,) * 3)
    assert (back[1, 1:-1, 1:-1] == 0).all() and np.isinf(back[2:]).all() and np.isinf(back[0]).all()
    got = settle.cells(made, "d", 64, 1, lambda f, v: np.isfinite(v))
    assert got.count() == 4096 and "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_moduli_keep_fields_in_files(monkeypatch):
    """Fields in files, a slice or a row of columns at a time: what one transform over whole arrays in memory gives, for odd and even edges."""
    lame = {1: (0.1, 0.1), 2: (1.0, 0.7), 3: (2.0, 1.5)}
    for shape in ((5, 7, 3), (6, 4, 5)):
        cell = np.random.default_rng(3).integers(1, 4, shape)
        want = bricks.homogenised_column(cell, lame, 1, 1e-6)[0]
        with monkeypatch.context() as m:
            m.setattr(bricks, "IN_MEMORY", 0)
            m.setattr(bricks, "IN_CACHE", 1)
            kinds, field = [], bricks._field
            m.setattr(bricks, "_field", lambda *of, **more: kinds.append(type(made := field(*of, **more))) or made)
            got = bricks.homogenised_column(cell, lame, 1, 1e-6)[0]
        assert kinds == [np.memmap] * 12 and np.allclose(got, want, atol=1e-9)


def test_scans_are_sent_by_slices(spark):
    """A scan's array with gaps, in its own type or in bytes where they hold it, from a row a slice."""
    rows = [(s, z, y, x, 7 * z + y - x + 300 * s) for s in (0, 1) for z in (2, 4) for y in range(3, 6) for x in range(-1, 3) if (y + x) % 3]
    vox = spark.createDataFrame(rows, "scan int, z int, y int, x int, v int")
    kernel = lambda v, case: {"total": int(v.sum()), "n": v.size, "wide": v.itemsize, "off": int((v == -9).sum()), "k": case}
    got = bricks.per_scan(vox, kernel, "v", {"total": "long", "n": "long", "wide": "long", "off": "long", "k": "long"}, outside=-9, cases=2)
    want = set()
    for s in (0, 1):
        own = [r for r in rows if r[0] == s]
        n = 3 * 3 * (max(r[3] for r in own) - min(r[3] for r in own) + 1)
        want |= {(s, k, sum(r[4] for r in own) - 9 * (n - len(own)), n, 4 if s else 1, n - len(own), k) for k in (0, 1)}
    assert {tuple(r) for r in got.collect()} == want
    assert "held#" in got._jdf.queryExecution().optimizedPlan().toString()


def test_diffusion_keeps_fields_in_files(monkeypatch):
    """The same flow with its fields in files, whose pages are let go on the way."""
    phase = np.random.default_rng(7).random((11, 9, 8)) < 0.8
    want = bricks.diffusion_tortuosity(phase)
    monkeypatch.setattr(bricks, "FLOW_IN_MEMORY", 0)
    monkeypatch.setattr(bricks, "IN_CACHE", 150)
    monkeypatch.setattr(bricks, "LET_GO", 2)
    gone, let_go = [], bricks._let_go
    monkeypatch.setattr(bricks, "_let_go", lambda *fields: gone.extend(map(type, fields)) or let_go(*fields))
    assert np.allclose(bricks.diffusion_tortuosity(phase), want, rtol=1e-6) and set(gone) == {np.memmap}
