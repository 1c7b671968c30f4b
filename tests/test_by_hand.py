"""Whole results of queries without SQL against plain Python over the same rows."""

import itertools
from collections import defaultdict

import numpy as np

from voxloom.operators import settle
from voxloom.plans import catalog, grids, standins

EVERY = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]


def near(value, other, tolerance=2e-5):
    return (value is None) == (other is None) and (value is None or abs(value - other) <= tolerance * max(1.0, abs(other)))


def scans(spark, sf_dir):
    """{scan: {column: array}} with NaN where there is no voxel."""
    vox, edge = standins.voxels(spark, sf_dir)
    out = defaultdict(dict)
    rows = vox.collect()
    for scan in {r["scan"] for r in rows}:
        for c in ("phase", "label", "grey"):
            out[scan][c] = np.full((edge,) * 3, np.nan)
    for r in rows:
        for c, a in out[r["scan"]].items():
            a[r["z"], r["y"], r["x"]] = r[c]
    return out, edge


def distance(of):
    """Distance of every cell to the nearest cell of a mask, all against all."""
    spots, cells = np.argwhere(of), np.indices(of.shape).reshape(3, -1).T
    best = np.full(len(cells), np.inf)
    for at in range(0, len(spots), 200):
        best = np.minimum(best, ((cells[:, None] - spots[None, at : at + 200]) ** 2).sum(axis=2).min(axis=1))
    return np.sqrt(best).reshape(of.shape)


def test_skeleton_segments(spark, sf_dir):
    data, edge = scans(spark, sf_dir)
    want = []
    for scan, v in data.items():
        ice = v["phase"] == 2
        thick = distance(np.pad(~ice, 1, constant_values=True))[1:-1, 1:-1, 1:-1]
        name = lambda at, scan=scan: ((scan * edge + at[0]) * edge + at[1]) * edge + at[2]
        left = {tuple(map(int, at)) for at in np.argwhere(settle.thinned(ice))}
        beside = {p: [q for o in EVERY if (q := tuple(a + b for a, b in zip(p, o, strict=True))) in left] for p in left}
        nodes = {p for p in left if len(beside[p]) != 2}
        for p in nodes:
            want += [(None, name(p), name(q), 1, round((thick[p] + thick[q]) / 2, 6)) for q in beside[p] if q in nodes and name(p) < name(q)]
        seen = set()
        for p in left - nodes:
            if p in seen:
                continue
            run, todo = {p}, [p]
            while todo:
                for q in beside[todo.pop()]:
                    if q not in nodes and q not in run:
                        run.add(q)
                        todo.append(q)
            seen |= run
            ends = sorted((q for r in run for q in beside[r] if q in nodes), key=name)
            both = (name(ends[0]), name(ends[-1]), len(run) + 1, round((thick[ends[0]] + thick[ends[-1]]) / 2, 6)) if ends else (None, None, len(run) + 1, None)
            want.append((min(map(name, run)), *both))
    got = [tuple(r) for r in catalog.QUERIES["skeleton_segments"](spark, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 100


def test_tetra_strain(spark, sf_dir):
    """Of all sets of four points those whose sphere holds no other."""
    points = defaultdict(list)
    for r in standins.grains(spark, sf_dir).collect():
        points[r["label"]].append([r[c] for c in ("z", "y", "x", "uz", "uy", "ux")])
    got = {r["label"]: r for r in catalog.QUERIES["tetra_strain"](spark, sf_dir).collect()}
    assert set(got) == set(points)
    for label, rows in points.items():
        p, u = np.array(rows)[:, :3], np.array(rows)[:, 3:]
        sets = np.array(list(itertools.combinations(range(len(p)), 4)))
        empty = []
        for at in range(0, len(sets), 100_000):
            t = sets[at : at + 100_000]
            m = p[t[:, 1:]] - p[t[:, :1]]
            c = np.linalg.solve(2 * m, (m * m).sum(axis=2)[..., None])[..., 0]
            inside = ((p[None] - (p[t[:, 0]] + c)[:, None]) ** 2).sum(axis=2) < ((c * c).sum(axis=1) * (1 - 1e-9))[:, None]
            empty.append(t[~inside.any(axis=1)])
        t = np.concatenate(empty)
        m = p[t[:, 1:]] - p[t[:, :1]]
        volume = abs(np.linalg.det(m)) / 6
        t, m, volume = (x[volume > 1e-9 * np.ptp(p, axis=0).max() ** 3] for x in (t, m, volume))
        h = np.linalg.solve(m, u[t[:, 1:]] - u[t[:, :1]]).swapaxes(1, 2)
        e = 0.5 * (h + h.swapaxes(1, 2) + h.swapaxes(1, 2) @ h)
        trace = np.einsum("nii->n", e)
        dev = e - trace[:, None, None] / 3 * np.eye(3)
        eq = np.sqrt(2 / 3 * (dev * dev).sum(axis=(1, 2)))
        mean = lambda x, w=volume: float((x * w).sum() / w.sum())
        assert got[label]["n"] == len(t) and near(got[label]["vol"], mean(trace), 1e-4) and near(got[label]["eq"], mean(eq), 1e-4)


def test_throat_measures(spark, sf_dir):
    data, _ = scans(spark, sf_dir)
    got = {(r["scan"], r["bead_a"], r["bead_b"]): r for r in catalog.QUERIES["throat_measures"](spark, sf_dir).collect()}
    want, checked = set(), 0
    for scan, v in data.items():
        whole = np.nan_to_num(v["label"]).astype(int)
        faces = defaultdict(int)
        for axis in range(3):
            a, b = (whole.take(range(s, whole.shape[axis] - 1 + s), axis) for s in (0, 1))
            for x, y in zip(a.ravel().tolist(), b.ravel().tolist(), strict=True):
                if x > 0 and y > 0 and x != y:
                    faces[min(x, y), max(x, y)] += 1
        for (lo, hi), n in faces.items():
            if n < 4:
                continue
            spots = np.argwhere((whole == lo) | (whole == hi))
            low, high = np.maximum(spots.min(axis=0) - 6, 0), np.minimum(spots.max(axis=0) + 6, np.array(whole.shape) - 1)
            box = tuple(slice(a, b + 1) for a, b in zip(low, high, strict=True))
            some = np.argwhere(~np.isnan(v["phase"][box]))
            box = tuple(slice(a + s, a + e + 1) for a, s, e in zip(low, some.min(axis=0), some.max(axis=0), strict=True))
            labels, phase = whole[box], np.nan_to_num(v["phase"][box]).astype(int)
            a, b, free = labels == lo, labels == hi, (phase > 0) & (labels <= 0)
            if not free.any():
                continue
            da, db = distance(a), distance(b)
            rest = distance((labels > 0) & ~a & ~b) if ((labels > 0) & ~a & ~b).any() else np.inf
            total, gap = da + db, (da + db)[free].min()
            radius = sum(((whole == k).sum() * 6 / np.pi) ** (1 / 3) / 2 for k in (lo, hi)) / 2
            lens = free & (np.minimum(da, db) <= rest) & (total <= gap + (0.4 * radius) ** 2 / (radius + 0.5 * gap))
            if lens.sum() < 50:
                continue
            want.add((scan, lo, hi))
            r, binder, crack = got[scan, lo, hi], lens & (phase == 2), lens & (phase == 1)
            q = np.minimum(da, db) / np.maximum(total, 1e-6)
            axis = np.argwhere(whole == hi).mean(axis=0) - np.argwhere(whole == lo).mean(axis=0)
            assert (r["lens_vox"], r["binder_vox"], r["crack_vox"], r["pore_vox"]) == (lens.sum(), binder.sum(), crack.sum(), 0)
            assert near(r["dsum_min"], gap) and near(r["gap_vox"], max(gap - 1, 0)) and near(r["binder_frac"], binder.sum() / lens.sum()) and near(r["crack_frac"], crack.sum() / lens.sum())
            assert near(r["axis_dip_deg"], np.degrees(np.arccos(min(1.0, abs(axis[0]) / np.linalg.norm(axis)))), 1e-4)
            for name, part in (("q_binder", binder), ("q_crack", crack)):
                assert (part.any() and near(r[name], float(np.median(q[part])))) or (not part.any() and np.isnan(r[name]))
            checked += 1
    assert set(got) == want
    assert checked or not got


def test_followed_points(spark, sf_dir):
    points = {r["id"]: (r["scan"], np.array([r[a] for a in "zyx"])) for r in standins.grains(spark, sf_dir).collect()}
    a, b = ({i: p for i, (s, p) in points.items() if s == k} for k in (0, 1))
    ia, ib = sorted(a), sorted(b)
    pa, pb = np.array([a[i] for i in ia]), np.array([b[i] for i in ib])
    shift, best, count = np.zeros_like(pa), None, -1
    for _ in range(3):
        d = np.linalg.norm((pa + shift)[:, None] - pb[None], axis=2)
        edges = []
        for i in range(len(ia)):
            edges += [(d[i, j], ia[i], ib[j]) for j in sorted(np.flatnonzero(d[i] <= 0.1), key=lambda j, i=i: (d[i, j], ib[j]))[:6]]
        found, used_a, used_b = [], set(), set()
        for w, x, y in sorted(edges):
            if x not in used_a and y not in used_b:
                found.append((x, y, w))
                used_a.add(x)
                used_b.add(y)
        n = len(found)
        if best is None or n > count:
            best = found
        if n < 20 or n <= count:
            break
        count = n
        at = np.array([a[x] for x, _, _ in found])
        moves = np.array([b[y] - a[x] for x, y, _ in found])
        names = [x for x, _, _ in found]
        for i in range(len(ia)):
            order = sorted(range(n), key=lambda k, i=i: (np.linalg.norm(pa[i] - at[k]), names[k]))[:8]
            shift[i] = np.median(moves[order], axis=0)
    got = sorted((r["a"], r["b"], r["d"]) for r in catalog.QUERIES["followed_points"](spark, sf_dir).collect())
    assert [g[:2] for g in got] == sorted((x, y) for x, y, _ in best)
    assert all(near(g[2], w) for g, (*_, w) in zip(got, sorted(best), strict=True)) and len(got) > 10


def test_split_instances(spark, sf_dir):
    """Sizes and places of bodies from the voxels of the operator, which other tests hold against a flood of the whole array."""
    rows = grids._bodies(spark, sf_dir).collect()
    sums = defaultdict(lambda: [0, 0.0, 0, 0, 0])
    for r in rows:
        s = sums[r["scan"], r["label"]]
        s[0], s[1], s[2], s[3], s[4] = s[0] + 1, max(s[1], r["d"]), s[2] + r["z"], s[3] + r["y"], s[4] + r["x"]
    got = {(r["scan"], r["label"]): r for r in catalog.QUERIES["split_instances"](spark, sf_dir).collect()}
    assert got.keys() == sums.keys()
    for key, s in sums.items():
        r = got[key]
        assert (r["n"], r["sum_z"], r["sum_y"], r["sum_x"]) == (s[0], *s[2:]) and near(r["d"], s[1])
