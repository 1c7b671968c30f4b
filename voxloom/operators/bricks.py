"""Array kernels on bricks and slices, for what joins can't express: distances, closing, simple points, throats, solvers.

Groups are slices, planes or halo bricks, so their size is that of the layout and not of the data. Arrays come from the
sparse view by coordinates and go back to it.
"""

from __future__ import annotations

import itertools
import mmap
import os
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.spatial import AXES
from voxloom.scratch import Scratch

_SIX = [o for o in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, o)) == 1]
_ALL = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]


def envelope_1d(f: np.ndarray) -> np.ndarray:
    """min over j of f[j] + (i - j)^2 along the first axis, for all lines at once; ends when no larger shift can lower a value."""
    n = len(f)
    out, low = f.copy(), float(f.min(initial=np.inf))
    for shift in range(1, n):
        step = float(shift * shift)
        if low + step >= out.max():
            break
        np.minimum(out[shift:], f[:-shift] + step, out=out[shift:])
        np.minimum(out[:-shift], f[shift:] + step, out=out[:-shift])
    return out


def edt(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of the mask's cells to the nearest cell outside of it; infinite if there is none."""
    f = np.where(mask, np.inf, 0.0)
    for axis in range(mask.ndim):
        f = np.moveaxis(envelope_1d(np.moveaxis(f, axis, 0)), 0, axis)
    return np.sqrt(f)


def distance_transform(vox: DataFrame, mask: str) -> DataFrame:
    """(scan, z, y, x, d): exact distance of masked voxels to the nearest other voxel of the data; without one they are left out.

    Separable: slices are done along y and x together, then planes of equal y along z. Each group is one plane of the
    scan's extent, so gaps in the data carry distances on.
    """
    extent = vox.groupBy("scan").agg(*[f(a).alias(f"{a}{k}") for a in ("y", "x") for k, f in ((0, F.min), (1, F.max))])

    def slices(part: pd.DataFrame) -> pd.DataFrame:
        y0, y1, x0, x1 = (int(part[c].iloc[0]) for c in ("y0", "y1", "x0", "x1"))
        f, want = np.full((y1 - y0 + 1, x1 - x0 + 1), np.inf), np.zeros((y1 - y0 + 1, x1 - x0 + 1), bool)
        m = part[mask].to_numpy(bool)
        f[part.y - y0, part.x - x0] = np.where(m, np.inf, 0.0)
        want[part.y - y0, part.x - x0] = m
        f = envelope_1d(envelope_1d(f).T).T
        y, x = np.nonzero(np.isfinite(f) | want)
        return pd.DataFrame({"scan": part.scan.iloc[0], "z": part.z.iloc[0], "y": y + y0, "x": x + x0, "f": f[y, x], "want": want[y, x]})

    def planes(part: pd.DataFrame) -> pd.DataFrame:
        z0, x0 = part.z.min(), part.x.min()
        f = np.full((part.z.max() - z0 + 1, part.x.max() - x0 + 1), np.inf)
        f[part.z - z0, part.x - x0] = part.f
        f = envelope_1d(f)
        out = part[part.want]
        return out[["scan", *AXES]].assign(d=np.sqrt(f[out.z - z0, out.x - x0]))

    #: By slice: a join by scan alone would sort a whole scan in one task.
    per_slice = vox.select("scan", "z").distinct().join(extent, "scan")
    flat = vox.select("scan", *AXES, mask).join(per_slice, ["scan", "z"]).groupBy("scan", "z").applyInPandas(slices, "scan int, z int, y int, x int, f double, want boolean")
    return flat.groupBy("scan", "y").applyInPandas(planes, "scan int, z int, y int, x int, d double").where("d < double('inf')")


def _apart(vox: DataFrame, inside: str, radius: float) -> DataFrame:
    """(scan, z, y, x): voxels of ``vox`` with ``inside`` that lie further than ``radius`` from all others of the data; where there are no others, all of them."""
    own = vox.where(inside).select("scan", *AXES)
    near = distance_transform(vox, inside).where(F.col("d") <= radius)
    return own.join(near.select("scan", *AXES), ["scan", *AXES], "left_anti")


def _widened(vox: DataFrame, inside: str, radius: float) -> DataFrame:
    """``vox`` with the boolean column ``wide``: whether ``inside`` holds at most ``radius`` away."""
    far = _apart(vox.withColumn("__out", ~F.col(inside)), "__out", radius).withColumn("__far", F.lit(True))
    return vox.join(far, ["scan", *AXES], "left").withColumn("wide", F.col("__far").isNull()).drop("__far")


def closed(vox: DataFrame, inside: str, radius: float) -> DataFrame:
    """(scan, z, y, x): closing of the voxels where the boolean column ``inside`` holds, by a ball, from exact distances. What lies outside of the data counts
    neither as inside nor as outside."""
    return _apart(_widened(vox.select("scan", *AXES, inside), inside, radius), "wide", radius)


def opened(vox: DataFrame, inside: str, radius: float) -> DataFrame:
    """(scan, z, y, x): opening by a ball, as ``closed``."""
    own = vox.select("scan", *AXES, inside)
    kept = _apart(own, inside, radius).withColumn("__kept", F.lit(True))
    thin = own.join(kept, ["scan", *AXES], "left").withColumn("__kept", F.coalesce("__kept", F.lit(False)))
    return _widened(thin, "__kept", radius).where("wide").select("scan", *AXES)


def label(mask: np.ndarray, connectivity: int = 6) -> np.ndarray:
    """Components numbered from 1 in raster order."""
    moves = [o for o in (_SIX if connectivity == 6 else _ALL) if o > (0,) * 3] if mask.ndim == 3 else [o for o in itertools.product((-1, 0, 1), repeat=2) if o > (0, 0) and (connectivity != 6 or sum(map(abs, o)) == 1)]
    flat = np.flatnonzero(mask)
    at = np.full(mask.size, -1)
    at[flat] = np.arange(len(flat))
    at = at.reshape(mask.shape)
    top = np.arange(len(flat))
    pairs = []
    for o in moves:
        a = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(o, mask.shape, strict=True))
        b = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(o, mask.shape, strict=True))
        both = mask[a] & mask[b]
        pairs.append(np.stack([at[a][both], at[b][both]]))
    edges = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), int)
    #: Roots are hooked to smaller ones, and only edges between different roots are looked at again.
    while edges.shape[1]:
        np.minimum.at(top, edges.max(axis=0), edges.min(axis=0))
        while (top != top[top]).any():
            top = top[top]
        edges = top[edges]
        edges = edges[:, edges[0] != edges[1]]
    out = np.zeros(mask.size, np.int64)
    out[flat] = np.unique(top, return_inverse=True)[1] + 1 if len(flat) else 0
    return out.reshape(mask.shape)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with background that doesn't reach the border."""
    back = label(~mask)
    edge = np.unique(np.concatenate([back.take(i, axis=a).ravel() for a in range(mask.ndim) for i in (0, -1)]))
    return mask | ((back > 0) & ~np.isin(back, edge))


def closed_slice(mask: np.ndarray, radius: float, skin: float) -> np.ndarray:
    """Closing by distance: within ``radius`` of the mask, then back by it, holes filled, then out by ``skin``."""
    wide = np.pad(mask, int(radius + skin) + 2)
    grown = edt(~wide) <= radius
    shut = fill_holes(edt(grown) > radius)
    return (edt(~shut) <= skin if skin > 0 else shut)[tuple(slice(int(radius + skin) + 2, -int(radius + skin) - 2) for _ in range(mask.ndim))]


def envelope(vox: DataFrame, mask: str, radius: float, skin: float) -> DataFrame:
    """(scan, z, y, x): per-slice closing of the mask inside the data's extent; a group is one slice."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = part.y.min(), part.x.min()
        m = np.zeros((part.y.max() - y0 + 1, part.x.max() - x0 + 1), bool)
        m[part.y - y0, part.x - x0] = part[mask]
        y, x = np.nonzero(closed_slice(m, radius, skin))
        return pd.DataFrame({"scan": part.scan.iloc[0], "z": part.z.iloc[0], "y": y + y0, "x": x + x0})

    return vox.select("scan", *AXES, mask).groupBy("scan", "z").applyInPandas(one, "scan int, z int, y int, x int")


def disc(radius: int) -> np.ndarray:
    y, x = np.ogrid[-radius : radius + 1, -radius : radius + 1]
    return y * y + x * x <= radius * radius


def morph(mask: np.ndarray, element: np.ndarray, grow: bool) -> np.ndarray:
    """Dilation or erosion by an element; outside of the array counts as background."""
    half = [n // 2 for n in element.shape]
    wide = np.pad(mask, [(h, h) for h in half])
    out = np.zeros_like(mask) if grow else np.ones_like(mask)
    for at in zip(*np.nonzero(element), strict=True):
        part = wide[tuple(slice(i, i + n) for i, n in zip(at, mask.shape, strict=True))]
        out = out | part if grow else out & part
    return out


def specimen_slice(grey: np.ndarray, threshold: float, radius: int, margin: int) -> np.ndarray:
    """Threshold, close, take the largest component, fill it, erode by the margin."""
    mask = grey >= threshold
    mask = morph(morph(np.pad(mask, radius), disc(radius), True), disc(radius), False)[radius:-radius or None, radius:-radius or None] if radius else mask
    parts = label(mask)
    if not parts.any():
        return np.zeros_like(mask)
    best = np.bincount(parts.ravel())[1:].argmax() + 1
    solid = fill_holes(parts == best)
    return morph(solid, disc(margin), False) if margin else solid


def specimen_mask(vox: DataFrame, grey: str, threshold: float, radius: int = 2, margin: int = 1) -> DataFrame:
    """(scan, z, y, x) inside the specimen, slice by slice."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = part.y.min(), part.x.min()
        g = np.full((part.y.max() - y0 + 1, part.x.max() - x0 + 1), -np.inf)
        g[part.y - y0, part.x - x0] = part[grey]
        y, x = np.nonzero(specimen_slice(g, threshold, radius, margin))
        return pd.DataFrame({"scan": part.scan.iloc[0], "z": part.z.iloc[0], "y": y + y0, "x": x + x0})

    return vox.select("scan", *AXES, grey).groupBy("scan", "z").applyInPandas(one, "scan int, z int, y int, x int")


def _beside(cells: list[tuple[int, int, int]], most: int) -> dict[int, int]:
    """For each cell's bit, the bits of the cells at most ``most`` face steps and one step along each axis away."""
    return {1 << i: sum(1 << j for j, b in enumerate(cells) if i != j and max(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 and sum(abs(x - y) for x, y in zip(a, b, strict=True)) <= most) for i, a in enumerate(cells)}


_NEAR, _FACES = _beside(_ALL, 3), _beside(_ALL, 1)
_SHELL18 = sum(1 << i for i, o in enumerate(_ALL) if sum(map(abs, o)) <= 2)
_SHELL6 = sum(1 << i for i, o in enumerate(_ALL) if sum(map(abs, o)) == 1)


def _grown(start: int, inside: int, near: dict[int, int]) -> int:
    """The bits of ``inside`` that are connected to ``start``."""
    got, front = start, start
    while front:
        bit = front & -front
        front ^= bit
        new = near[bit] & inside & ~got
        got |= new
        front |= new
    return got


def simple_point(bits: int) -> bool:
    """Whether a voxel with these 26 neighbours (bits in raster order) can go without changing the topology: they are one
    component, and of the background's 18 neighbours exactly one component touches the voxel's faces."""
    if not bits or _grown(bits & -bits, bits, _NEAR) != bits:
        return False
    back = _SHELL18 & ~bits
    faces = back & _SHELL6
    return bool(faces) and not faces & ~_grown(faces & -faces, back, _FACES)


def _tables(near: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For the lower and the upper 13 of 26 bits, what lies beside any of the cells that are set."""
    some, out = np.arange(1 << 13), []
    for half in (0, 13):
        t = np.zeros(1 << 13, np.int32)
        for i in range(13):
            t[(some >> i) & 1 == 1] |= near[1 << (half + i)]
        out.append(t)
    return out[0], out[1]


_NEAR_TABLES, _FACE_TABLES = _tables(_NEAR), _tables(_FACES)


def simple_points(bits: np.ndarray) -> np.ndarray:
    """``simple_point`` of many voxels at once."""
    bits = bits.astype(np.int32)

    def grown(start: np.ndarray, inside: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out, left, got, of = start.copy(), np.arange(len(start)), start, inside
        while len(left):
            new = got | ((tables[0][got & 8191] | tables[1][got >> 13]) & of)
            more = new != got
            out[left] = new
            left, got, of = left[more], new[more], of[more]
        return out

    one = grown(bits & -bits, bits, _NEAR_TABLES) == bits
    back = _SHELL18 & ~bits
    faces = back & _SHELL6
    return (bits != 0) & one & (faces != 0) & (faces & ~grown(faces & -faces, back, _FACE_TABLES) == 0)


def surface_area(values: np.ndarray, level: float) -> float:
    """Area of the level surface of trilinear data by marching tetrahedra."""
    corner = np.array(list(itertools.product((0, 1), repeat=3)))
    tets = [(0, a, b, 7) for a, b in ((1, 3), (3, 2), (2, 6), (6, 4), (4, 5), (5, 1))]
    cells = np.stack([values[c[0] : values.shape[0] - 1 + c[0], c[1] : values.shape[1] - 1 + c[1], c[2] : values.shape[2] - 1 + c[2]].ravel() for c in corner])
    total = 0.0
    for tet in tets:
        v, p = cells[list(tet)] - level, corner[list(tet)].astype(float)
        above = v >= 0
        for size in (1, 2, 3):
            for inside in itertools.combinations(range(4), size):
                hit = np.flatnonzero((above.sum(axis=0) == size) & above[list(inside)].all(axis=0))
                if not len(hit):
                    continue
                out = [k for k in range(4) if k not in inside]
                cut = lambda i, o: p[i] + (v[i, hit] / (v[i, hit] - v[o, hit]))[:, None] * (p[o] - p[i])  # noqa: B023, E731
                pts = [cut(i, o) for i in inside for o in out]
                if size == 2:
                    pts = [pts[0], pts[1], pts[3], pts[2]]
                tri = [(0, 1, 2)] if len(pts) == 3 else [(0, 1, 2), (0, 2, 3)]
                total += sum(float(np.linalg.norm(np.cross(pts[b] - pts[a], pts[c] - pts[a]), axis=1).sum()) / 2 for a, b, c in tri)
    return total


def surface_areas(solid: DataFrame, edge: int = 64) -> DataFrame:
    """(scan, area): surface of the voxels (scan, z, y, x), half way to what isn't one of them.

    Cells between eight voxel centres are dealt to bricks of ``edge`` cells with one more layer of voxels; a group is one brick,
    and areas add up. Bricks without voxels have no surface.
    """
    spread = solid.select("scan", *AXES)
    for a in AXES:
        first, last = F.floor((F.col(a) - 1) / edge).cast("int"), F.floor(F.col(a) / edge).cast("int")
        spread = spread.withColumn(f"b{a}", F.explode(F.array_distinct(F.array(first, last))))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((edge + 1,) * 3)
        first = part.iloc[0]
        v[tuple((part[a] - first[f"b{a}"] * edge).to_numpy() for a in AXES)] = 1.0
        return pd.DataFrame([(int(first.scan), surface_area(v, 0.5))], columns=["scan", "area"])

    return spread.groupBy("scan", *[f"b{a}" for a in AXES]).applyInPandas(one, "scan int, area double").groupBy("scan").agg(F.sum("area").alias("area"))


#: Footprint of a throat in bead radii, and voxels that a lens, a fine lens and a shell need: fixed values.
FOOT, LEAST_LENS, LEAST_FINE, LEAST_SHELL = 0.40, 50, 200, 50
SHELL = (1.0, 3.0)


def _lens(a: np.ndarray, b: np.ndarray, others: np.ndarray, free: np.ndarray, radii: tuple[float, float], scale: float = 1.0) -> dict:
    """Distances to both bodies, the gap, the territory that no other body is nearer to, and the lens between them with its place q."""
    da, db = edt(~a) / scale, edt(~b) / scale
    total = da + db
    own = np.minimum(da, db) <= (edt(~others) / scale if others.any() else np.inf)
    gap = float(total[free].min())
    mean = 0.5 * (radii[0] + radii[1])
    lens = free & own & (total <= gap + (FOOT * mean) ** 2 / (mean + 0.5 * gap))
    return {"da": da, "db": db, "total": total, "own": own, "gap": gap, "mean": mean, "lens": lens, "q": np.minimum(da, db) / np.maximum(total, 1e-6)}


def _within(mask: np.ndarray, reach: int) -> tuple[slice, ...]:
    """The cells of the mask's array at most ``reach`` along each axis from the box round the mask."""
    out = []
    for axis, n in enumerate(mask.shape):
        some = np.flatnonzero(mask.any(axis=tuple(k for k in range(mask.ndim) if k != axis)))
        out.append(slice(max(0, int(some[0]) - reach), min(n, int(some[-1]) + reach + 1)))
    return tuple(out)


def _distances(mask: np.ndarray, box: tuple[slice, ...], reach: int) -> np.ndarray:
    """``edt(~mask)`` in a box where the nearest cell of the mask is at most ``reach`` away along each axis; infinite elsewhere."""
    wide = tuple(slice(max(0, s.start - reach), min(n, s.stop + reach)) for s, n in zip(box, mask.shape, strict=True))
    #: Squares in the narrowest type that holds them and the step beyond.
    kind, far = (np.uint8, 200) if reach <= 4 else (np.int16, 24_400) if reach <= 90 else (np.float64, np.inf)
    f = np.where(mask[wide], kind(0), kind(far))
    for axis, (s, w) in enumerate(zip(box, wide, strict=True)):
        f = np.moveaxis(f, axis, 0)
        low, high = s.start - w.start, s.stop - w.start
        out = f[low:high].copy()
        for shift in range(1, reach + 1):
            up, down = f[max(0, low - shift) : max(0, high - shift)], f[low + shift : high + shift]
            if len(up):
                np.minimum(out[len(out) - len(up) :], up + kind(shift * shift), out=out[len(out) - len(up) :])
            if len(down):
                np.minimum(out[: len(down)], down + kind(shift * shift), out=out[: len(down)])
        f = np.moveaxis(out, 0, axis)
    return np.sqrt(np.where(f < far, f, np.inf))


def _near_lens(a: np.ndarray, b: np.ndarray, others: np.ndarray, free: np.ndarray, radii: tuple[float, float], scale: float, reach: int = 4) -> tuple[tuple[slice, ...], dict]:
    """What ``_lens`` tells of the lens and the gap, and the box it lies in: a lens's cells are no further from a body than its greatest sum of distances, so
    only cells within a reach of both bodies are looked at, and the reach is doubled until it holds that sum. The values are those of ``_lens``."""
    mean = 0.5 * (radii[0] + radii[1])
    while True:
        at_a, at_b = _within(a, reach), _within(b, reach)
        box = tuple(slice(max(p.start, q.start), min(p.stop, q.stop)) for p, q in zip(at_a, at_b, strict=True))
        whole = reach >= max(a.shape)
        if whole or all(s.start < s.stop for s in box):
            #: The nearest cell of a body may lie outside of the box, within the reach.
            da, db = _distances(a, box, reach) / scale, _distances(b, box, reach) / scale
            total = da + db
            gap = float(total[free[box]].min(initial=np.inf))
            top = gap + (FOOT * mean) ** 2 / (mean + 0.5 * gap)
            if whole or top * scale <= reach:
                own = np.minimum(da, db) <= _distances(others, box, reach) / scale
                return box, {"da": da, "db": db, "gap": gap, "lens": free[box] & own & (total <= top)}
        reach *= 2


def _median(values: np.ndarray) -> float:
    return float(np.median(values)) if len(values) else float("nan")


def throat(labels: np.ndarray, phase: np.ndarray, crack: np.ndarray, pair: tuple[int, int], radii: tuple[float, float], centres: tuple[np.ndarray, np.ndarray], least: int = LEAST_LENS) -> dict[str, float] | None:
    """Measures of the gap between two bodies in one box; None without both of them or with a lens that is too small.

    The lens is where the distances to both add up to little more than their least sum, and its footprint is a share of the
    radius. What fills it is binder, crack, or pore that isn't crack. The bodies are connected if one component of
    bodies and binder holds both. The neck is the layer through the narrowest free voxel, across the line of centres.
    """
    a, b = labels == pair[0], labels == pair[1]
    free = (phase > 0) & (labels <= 0)
    if not a.any() or not b.any() or not free.any():
        return None
    m = _lens(a, b, (labels > 0) & ~a & ~b, free, radii)
    lens, q, n = m["lens"], m["q"], int(m["lens"].sum())
    if n < least:
        return None
    broken, binder = lens & crack, lens & (phase == 2)
    pore = lens & (phase == 1) & ~broken
    parts = label(a | b | binder, 26)
    most = lambda body: int(np.bincount(parts[body]).argmax())
    line = np.asarray(centres[1], float) - np.asarray(centres[0], float)
    line = line / max(float(np.linalg.norm(line)), 1e-9)
    spots = np.argwhere(free)
    narrow = spots[int(np.argmin(m["total"][free]))]
    off = sum((g - c) * u for g, c, u in zip(np.ogrid[tuple(slice(0, k) for k in labels.shape)], narrow, line, strict=True))
    layer = (np.abs(off) <= 0.5) & m["own"] & free
    neck, cut = layer & (phase == 2), layer & crack
    area = float("nan")
    if neck.any():
        patches, at = label(neck, 26), np.argwhere(neck)
        nearest = at[int(((at - narrow) ** 2).sum(axis=1).argmin())]
        area = float((patches == patches[tuple(nearest)]).sum())
    radius = float(np.sqrt(area / np.pi))
    n_neck, n_cut = int(neck.sum()), int(cut.sum())
    return {
        "gap_vox": max(m["gap"] - 1.0, 0.0), "dsum_min": m["gap"], "axis_dip_deg": float(np.degrees(np.arccos(min(1.0, abs(line[0]))))), "lens_vox": n,
        "binder_vox": int(binder.sum()), "pore_vox": int(pore.sum()), "crack_vox": int(broken.sum()), "binder_frac": binder.sum() / n, "pore_frac": pore.sum() / n, "crack_frac": broken.sum() / n,
        "connected": most(a) == most(b), "bond_area_vox": area, "r_bond_vox": radius, "r_bond_over_r": radius / m["mean"], "neck_binder_vox": n_neck, "neck_crack_vox": n_cut, "neck_severed": n_cut / (n_neck + n_cut) if n_neck + n_cut else float("nan"),
        "q_crack": _median(q[broken]), "q_binder": _median(q[binder]), "q_pore": _median(q[pore]), "dq_paired": _median(q[broken]) - _median(q[binder]),
    }


def finer(v: np.ndarray, times: int, nearest: bool = False) -> np.ndarray:
    """``v`` on a grid ``times`` as fine between its first and last cells, trilinear or by the nearest cell."""
    for axis, n in enumerate(v.shape):
        at = np.arange((n - 1) * times + 1) / times
        if nearest:
            v = v.take(np.rint(at).astype(int), axis)
            continue
        v = np.moveaxis(v, axis, 0)
        out = np.empty((len(at), *v.shape[1:]), np.result_type(v, float))
        out[::times] = v
        for k in range(1, times if n > 1 else 1):
            t = (at[k::times] - np.arange(n - 1)).reshape(-1, *[1] * (v.ndim - 1))
            out[k::times] = v[:-1] * (1 - t) + v[1:] * t
        v = np.moveaxis(out, 0, axis)
    return v


def face_cover(grey: np.ndarray, labels: np.ndarray, phase: np.ndarray, crack: np.ndarray, pair: tuple[int, int], radii: tuple[float, float], half: float, fine: int = 3, least: int = LEAST_FINE, least_shell: int = LEAST_SHELL) -> dict[str, float] | None:
    """How much of both bodies' faces in the lens is still covered by binder, and by crack, on a finer grid.

    Bodies are where the interpolated grey is above half and the nearest label is theirs; a face is the lens's shell within
    ``SHELL`` voxels of a body. None without both bodies or with a lens that is too small; NaN for faces that are.
    """
    #: A byte a cell tells whether it is a bead's, a's, b's, free, binder and crack.
    told = np.zeros(labels.shape, np.uint8)
    for bit, which in enumerate((labels > 0, labels == pair[0], labels == pair[1], phase > 0, phase == 2, crack)):
        told |= which.astype(np.uint8) << bit
    told, solid = finer(told, fine, True), finer(grey.astype(float), fine) >= half
    beads, a, b = (solid & (told & (1 << bit) > 0) for bit in range(3))
    free = (told & 8 > 0) & ~beads
    if not a.any() or not b.any() or not free.any():
        return None
    box, m = _near_lens(a, b, beads & ~a & ~b, free, radii, fine)
    if m["lens"].sum() < least:
        return None
    out, told = {"gap_sub_vox": m["gap"]}, told[box]
    for name, d in (("a", m["da"]), ("b", m["db"])):
        shell = m["lens"] & (d >= SHELL[0]) & (d <= SHELL[1])
        enough = shell.sum() >= least_shell
        out |= {f"cover_{name}": float((told[shell] & 16 > 0).mean()) if enough else float("nan"), f"crack_at_{name}": float((told[shell] & 32 > 0).mean()) if enough else float("nan")}
    return out


#: Edge of the bricks that pairs are at home in by their box's first cell, and of the blocks by which voxels are sent there.
HOME = 32


def _per_pair(vox: DataFrame, pairs: DataFrame, columns: tuple[str, ...], measure: Callable[..., dict | None], ddl: str, home: int = HOME) -> DataFrame:
    """(scan, bead_a, bead_b, ...): a row of ``measure`` for each pair that has one, from the arrays ``columns`` of the voxels in its box.

    ``pairs`` has (scan, bead_a, bead_b), the box as z0, z1, y0, y1, x0, x1, ends included, r_a, r_b and ca_z .. cb_x. A group is the pairs whose boxes are of one class of size and begin in
    one brick: they share its voxels, which are sent there once instead of once a pair.
    """
    longest = F.greatest(*[F.col(f"{a}1") - F.col(f"{a}0") + 1 for a in AXES])
    key = ["scan", "__size", *[f"__h{a}" for a in AXES]]
    placed = Scratch(vox.sparkSession, "pairs").put(pairs, "pairs").withColumn("__size", F.greatest(F.ceil(F.log2(longest / home)), F.lit(0)).cast("int")).withColumns({f"__h{a}": F.floor(F.col(f"{a}0") / home) for a in AXES})
    homes = placed.groupBy(*key).agg(*[f(f"{a}{k}").alias(f"__{a}{k}") for a in AXES for k, f in ((0, F.min), (1, F.max))])
    for a in AXES:
        homes = homes.withColumn(f"__b{a}", F.explode(F.sequence(F.floor(F.col(f"__{a}0") / home), F.floor(F.col(f"__{a}1") / home))))
    own = vox.select("scan", *AXES, *columns, *[F.floor(F.col(a) / home).alias(f"__b{a}") for a in AXES])
    near = own.join(homes, ["scan", *[f"__b{a}" for a in AXES]])
    for a in AXES:
        near = near.where(F.col(a).between(F.col(f"__{a}0"), F.col(f"__{a}1")))
    names = ["scan", "bead_a", "bead_b", *[c.split()[0] for c in ddl.split(", ")]]

    def one(mine: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(mine) and len(part):
            at = part[list(AXES)].to_numpy()
            base = at.min(axis=0)
            place, shape = tuple((at - base).T), at.max(axis=0) - base + 1
            there = np.zeros(shape, bool)
            there[place] = True
            arrays = {c: np.zeros(shape, part[c].to_numpy().dtype) for c in columns}
            for c in columns:
                arrays[c][place] = part[c]
            for r in mine.itertuples():
                low = np.maximum([getattr(r, f"{a}0") for a in AXES] - base, 0)
                box = tuple(slice(i, max(i, getattr(r, f"{a}1") - o + 1)) for i, a, o in zip(low, AXES, base, strict=True))
                found = np.argwhere(there[box])
                if not len(found):
                    continue
                #: A box ends where its voxels do.
                first, last = low + found.min(axis=0), low + found.max(axis=0) + 1
                box = tuple(slice(i, j) for i, j in zip(first, last, strict=True))
                centres = tuple(np.array([getattr(r, f"{s}{a}") for a in AXES], float) - (base + first) for s in ("ca_", "cb_"))
                got = measure(*[arrays[c][box] for c in columns], pair=(int(r.bead_a), int(r.bead_b)), radii=(float(r.r_a), float(r.r_b)), centres=centres)
                if got is not None:
                    rows.append({"scan": r.scan, "bead_a": r.bead_a, "bead_b": r.bead_b, **got})
        return pd.DataFrame(rows, columns=names)

    near = near.select(*[F.col(c).alias(c) for c in (*key, *AXES, *columns)])
    return placed.groupBy(*key).cogroup(near.groupBy(*key)).applyInPandas(one, "scan int, bead_a long, bead_b long, " + ddl)


_THROAT = "gap_vox double, dsum_min double, axis_dip_deg double, lens_vox long, binder_vox long, pore_vox long, crack_vox long, binder_frac double, pore_frac double, crack_frac double, connected boolean, bond_area_vox double, r_bond_vox double, r_bond_over_r double, neck_binder_vox long, neck_crack_vox long, neck_severed double, q_crack double, q_binder double, q_pore double, dq_paired double"
_FACE = "gap_sub_vox double, cover_a double, crack_at_a double, cover_b double, crack_at_b double"


def throats(vox: DataFrame, pairs: DataFrame, least: int = LEAST_LENS) -> DataFrame:
    """A row of ``throat`` measures per pair of ``_per_pair``; ``vox`` has (scan, z, y, x, label, phase, crack)."""
    return _per_pair(vox, pairs, ("label", "phase", "crack"), lambda *v, **of: throat(*v, **of, least=least), _THROAT)


def faces(vox: DataFrame, pairs: DataFrame, half: float, least: int = LEAST_FINE, least_shell: int = LEAST_SHELL) -> DataFrame:
    """A row of ``face_cover`` measures per pair, as ``throats``; ``vox`` also has grey."""
    return _per_pair(vox, pairs, ("grey", "label", "phase", "crack"), lambda *v, pair, radii, centres: face_cover(*v, pair, radii, half, least=least, least_shell=least_shell), _FACE)


#: Bytes of a field beyond which a solver keeps it in a file: of the moduli, and of a flow, which goes through its fields often.
IN_MEMORY, FLOW_IN_MEMORY = 16 << 20, 160 << 20


def _field(shape: tuple[int, ...], kind: type = np.float64, most: int | None = None) -> np.ndarray:
    """Zeros; a large field is mapped from a file without a name, of which ``_let_go`` takes the pages from the process."""
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    if size <= (IN_MEMORY if most is None else most):
        return np.zeros(shape, kind)
    with tempfile.TemporaryFile() as file:
        #: A full disk is an error here, not a fault at the first write to a page.
        os.posix_fallocate(file.fileno(), 0, size)
        return np.memmap(file, kind, "r+", shape=shape)


def _let_go(*fields: np.ndarray) -> None:
    """What was read and written of mapped fields goes from memory to their files' pages."""
    for v in fields:
        if isinstance(v, np.memmap):
            v._mmap.madvise(mmap.MADV_DONTNEED)


def diffusion_tortuosity(phase: np.ndarray, tol: float = 1e-6, rounds: int = 5000) -> tuple[float, float, float]:
    """(D_eff, tau = phi / D_eff, residual) along z: steady diffusion through the phase between two faces, by conjugate gradients.

    The residual is that of the flow, as a share of its start. If it is still above ``tol`` after ``rounds``, the others are NaN.
    """
    n = phase.shape[0]
    phi = float(phase.mean())
    if not phase[0].any() or not phase[-1].any():
        return 0.0, float("inf"), 0.0
    #: Open faces of each cell, twice those at the ends. All fields are 0 outside of the phase, so a flow is that many times a cell's value less its neighbours'.
    faces = np.zeros(phase.shape, np.int8)
    for z in range(n):
        own = phase[z]
        for beside in (phase[k] for k in (z - 1, z + 1) if 0 <= k < n):
            faces[z] += own & beside
        for axis in range(2):
            a, b = (tuple(slice(*ends) if k == axis else slice(None) for k in range(2)) for ends in ((0, -1), (1, None)))
            both = own[a] & own[b]
            faces[z][a] += both
            faces[z][b] += both
    faces[0] += 2 * phase[0].astype(np.int8)
    faces[-1] += 2 * phase[-1].astype(np.int8)
    #: Slices are gone through some at a time, so that a block stays in the processor's cache.
    high = max(1, IN_CACHE // max(1, phase[0].size))
    blocks, near = [slice(z, min(z + high, n)) for z in range(0, n, high)], np.empty((high, *phase.shape[1:]))

    def flow(p: np.ndarray, out: np.ndarray) -> float:
        """``out`` becomes the flow of p between ends of 0; the product of both."""
        total = 0.0
        for k, z in enumerate(blocks, 1):
            own, t = p[z], near[: z.stop - z.start]
            t[:] = 0.0
            t[max(0, 1 - z.start) :] += p[max(0, z.start - 1) : z.stop - 1]
            t[: min(n, z.stop + 1) - z.start - 1] += p[z.start + 1 : z.stop + 1]
            t[:, 1:] += own[:, :-1]
            t[:, :-1] += own[:, 1:]
            t[:, :, 1:] += own[:, :, :-1]
            t[:, :, :-1] += own[:, :, 1:]
            t *= phase[z]
            np.multiply(own, faces[z], out=out[z])
            out[z] -= t
            total += float(np.vdot(own, out[z]))
            if k % LET_GO == 0:
                _let_go(p, out)
        _let_go(p, out)
        return total

    u, r, ap, p = (_field(phase.shape, most=FLOW_IN_MEMORY) for _ in range(4))
    r[0] = p[0] = 2.0 * phase[0]
    rr = float((r[0] * r[0]).sum())
    start = rr or 1.0
    stop = tol * tol * rr
    for _ in range(rounds):
        if rr <= stop:
            break
        alpha, new = rr / flow(p, ap), 0.0
        for k, z in enumerate(blocks, 1):
            t = near[: z.stop - z.start]
            u[z] += np.multiply(p[z], alpha, out=t)
            r[z] -= np.multiply(ap[z], alpha, out=t)
            new += float(np.vdot(r[z], r[z]))
            if k % LET_GO == 0:
                _let_go(u, r, ap, p)
        for k, z in enumerate(blocks, 1):
            p[z] *= new / rr
            p[z] += r[z]
            if k % LET_GO == 0:
                _let_go(u, r, ap, p)
        rr = new
    residual = (rr / start) ** 0.5
    if rr > stop:
        return float("nan"), float("nan"), residual
    flux = float((2 * (1.0 - u[0])[phase[0]]).sum()) / phase[0].size
    d_eff = flux * n
    return d_eff, phi / d_eff if d_eff > 1e-9 else float("inf"), residual


#: Cells of a block that stays in the cache, and blocks of a flow after which the pages of mapped fields are let go.
IN_CACHE, LET_GO = 1 << 16, 16
VOIGT = [(0, 0), (1, 1), (2, 2), (1, 2), (0, 2), (0, 1)]


def homogenised(phase: np.ndarray, lame: dict[int, tuple[float, float]], tol: float = 1e-4, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """(stiffness, residual): effective 6 x 6 stiffness of a periodic cell by the basic fixed-point scheme in Fourier space; lame maps a phase to
    (lambda, mu). The residual is the largest divergence of stress over the columns; columns that are above ``tol`` after ``rounds`` are NaN."""
    columns = [homogenised_column(phase, lame, col, tol, rounds) for col in range(6)]
    return np.stack([c for c, _ in columns], axis=1), max(0.0, *[float(r) for _, r in columns])


def homogenised_column(phase: np.ndarray, lame: dict[int, tuple[float, float]], col: int, tol: float = 1e-4, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """(column, residual) of ``homogenised``: the mean stress under one mean strain. Tensors are held by their six components."""
    codes = sorted(set().union(*[np.unique(v).tolist() for v in phase]))
    lam_of, mu_of = (np.array([lame[int(k)][i] for k in codes], float) for i in (0, 1))
    l0, m0 = (lam_of.min() + lam_of.max()) / 2, (mu_of.min() + mu_of.max()) / 2
    #: Where no axis has a frequency that is its own opposite, half of the spectrum tells the rest.
    nz, ny, nx = phase.shape
    half = all(n % 2 for n in phase.shape)
    forward = np.fft.rfft2 if half else np.fft.fft2
    back = (lambda f: np.fft.irfft2(f, (ny, nx))) if half else (lambda f: np.fft.ifft2(f).real)
    xi = [np.fft.fftfreq(n).reshape([-1 if k == i else 1 for k in range(3)]) for i, n in enumerate(phase.shape)]
    if half:
        xi[2] = xi[2][:, :, : nx // 2 + 1]
    wide = xi[2].shape[2]
    twice = np.where(np.arange(wide) > 0, 2.0, 1.0) if half else 1.0
    #: Transforms go by slices along y and x, then by columns along z, some at a time: fields stay in files, and no more than a block of each is held.
    slices, rows = ([slice(k, min(k + step, n)) for k in range(0, n, step)] for n, step in ((nz, max(1, IN_CACHE // (ny * nx))), (ny, max(1, IN_CACHE // (nz * wide)))))
    eps, spectra = [_field(phase.shape) for _ in VOIGT], [_field((nz, ny, wide), np.complex128) for _ in VOIGT]
    for k, v in enumerate(eps):
        for z in slices:
            v[z] = 0.0 if k != col else 1.0 if k < 3 else 0.5
            _let_go(v)

    def stress(z: slice) -> Iterator[np.ndarray]:
        at = np.searchsorted(codes, phase[z])
        mu, press = mu_of[at], lam_of[at] * (eps[0][z] + eps[1][z] + eps[2][z])
        for k in range(6):
            yield 2 * mu * eps[k][z] + press if k < 3 else 2 * mu * eps[k][z]

    def columns_of(y: slice) -> tuple[float, float]:
        """The spectra of stress become the steps of strain; the square of the divergence and the largest mean stress."""
        x1, x2, x3 = xi[0], xi[1][:, y], xi[2]
        x = (x1, x2, x3)
        t, most = [0.0, 0.0, 0.0], 1e-300
        for (i, j), field in zip(VOIGT, spectra, strict=True):
            s = np.fft.fft(field[:, y], axis=0)
            most = max(most, abs(s[0, 0, 0])) if y.start == 0 else most
            t[i] = t[i] + x[j] * s
            if i != j:
                t[j] = t[j] + x[i] * s
        square = float(sum((np.abs(c) ** 2 * twice).sum() for c in t))
        norm = x1 * x1 + x2 * x2 + x3 * x3
        if y.start == 0:
            norm[0, 0, 0] = 1.0
        tt = (x1 * t[0] + x2 * t[1] + x3 * t[2]) * ((l0 + m0) / (m0 * (l0 + 2 * m0))) / norm**2
        for c in t:
            c /= 2 * m0 * norm
        for (i, j), field in zip(VOIGT, spectra, strict=True):
            step = x[i] * t[j] + x[j] * t[i] - x[i] * x[j] * tt
            if y.start == 0:
                step[0, 0, 0] = 0.0
            field[:, y] = np.fft.ifft(step, axis=0)
        _let_go(*spectra)
        return square, most

    div = float("inf")
    for k in range(rounds):
        for z in slices:
            if k:
                for v, field in zip(eps, spectra, strict=True):
                    v[z] -= back(field[z])
            for field, sig in zip(spectra, stress(z), strict=True):
                field[z] = forward(sig)
            _let_go(*eps, *spectra)
        found = [columns_of(y) for y in rows]
        div = float(np.sqrt(sum(s for s, _ in found)) / max(m for _, m in found))
        if div < tol:
            break
    mean = np.zeros(6)
    for z in slices:
        mean += [float(sig.sum()) for sig in stress(z)]
        _let_go(*eps)
    return mean / phase.size if div < tol else np.full(6, np.nan), div


def per_scan(vox: DataFrame, kernel: Callable[..., dict[str, float]], value: str, columns: dict[str, str], outside: int = 0, cases: int | None = None) -> DataFrame:
    """A row of ``kernel`` over each scan's (down-sampled) array, in which places without a voxel hold ``outside``. A group is a whole scan: for maps that were
    reduced to fit a task. With ``cases`` a scan gives so many rows (scan, case, ...), a group each: the kernel gets the case's number as well."""
    keys, ddl = ["scan"] if cases is None else ["scan", "case"], "scan int, z int, y int, x int, ny int, nx int, kind string, there binary, held binary"

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(part.y.min()), int(part.x.min())
        shape = int(part.y.max()) - y0 + 1, int(part.x.max()) - x0 + 1
        own = part[value].to_numpy()
        v, there = np.zeros(shape, own.dtype), np.zeros(shape, bool)
        v[part.y - y0, part.x - x0], there[part.y - y0, part.x - x0] = own, True
        return pd.DataFrame([(part.scan.iloc[0], part.z.iloc[0], y0, x0, *shape, v.dtype.str, zlib.compress(there.tobytes(), 1), zlib.compress(v.tobytes(), 1))], columns=[c.split()[0] for c in ddl.split(", ")])

    def one(part: pd.DataFrame) -> pd.DataFrame:
        low = part[list(AXES)].min().to_numpy()
        high = np.array([part.z.max() + 1, (part.y + part.ny).max(), (part.x + part.nx).max()])
        v = np.full(high - low, outside, _narrow(part, outside))
        for r in part.itertuples():
            there = np.frombuffer(zlib.decompress(r.there), bool).reshape(r.ny, r.nx)
            place = v[r.z - low[0], r.y - low[1] : r.y - low[1] + r.ny, r.x - low[2] : r.x - low[2] + r.nx]
            place[there] = np.frombuffer(zlib.decompress(r.held), r.kind).reshape(r.ny, r.nx)[there]
        key = {k: part[k].iloc[0] for k in keys}
        return pd.DataFrame([key | kernel(v, *[int(key[k]) for k in keys[1:]])])[[*keys, *columns]]

    #: A slice is a row, its values compressed: a scan's voxels as rows take many times the array.
    own = vox.select("scan", *AXES, value).groupBy("scan", "z").applyInPandas(packed, ddl)
    if cases is not None:
        own = own.withColumn("case", F.explode(F.sequence(F.lit(0), F.lit(cases - 1))))
    return own.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} int" for k in keys) + ", " + ", ".join(f"{k} {v}" for k, v in columns.items()))


def _narrow(part: pd.DataFrame, outside: int) -> np.dtype:
    """The slices' type, or a byte where it is one of whole numbers and all that they hold fits."""
    kind = np.dtype(part.kind.iloc[0])
    if kind.kind not in "iu":
        return kind
    ends = [(int(v.min()), int(v.max())) for v in (np.frombuffer(zlib.decompress(h), kind) for h in part.held)]
    return np.dtype(np.int8) if min(outside, *[a for a, _ in ends], 0) >= -128 and max(outside, *[b for _, b in ends], 0) <= 127 else kind


def predict_bricks(bricks: DataFrame, model: Callable[[np.ndarray], np.ndarray], halo: int) -> DataFrame:
    """(scan, bz, by, bx, classes): a model over halo bricks (payload, nz, ny, nx), each brick standardised by itself, in doubles; the halo is cut off.

    ``model`` maps a brick to probabilities (class, z, y, x); the class with the largest is taken.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for r in part.itertuples():
                v = np.array(r.payload, np.float64).reshape(r.nz, r.ny, r.nx)
                v = (v - v.mean()) / max(float(v.std()), 1e-6)
                inner = tuple(slice(halo, n - halo) for n in v.shape)
                rows.append((r.scan, r.bz, r.by, r.bx, model(v).argmax(axis=0)[inner].ravel().astype(int).tolist()))
            yield pd.DataFrame(rows, columns=["scan", "bz", "by", "bx", "classes"])

    return bricks.mapInPandas(run, "scan int, bz int, by int, bx int, classes array<int>")
