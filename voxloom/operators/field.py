"""Displacement fields: gradients by least squares, strain, rotation, rigid motion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.geometry import solve3
from voxloom.operators.spatial import AXES
from voxloom.operators.stats import exact_summary


def gradient(points: DataFrame, near: DataFrame) -> DataFrame:
    """(id, n, h0 .. h8): displacement gradient of each point from its neighbours, with an intercept, in rows.

    ``points`` has (id, z, y, x, uz, uy, ux), ``near`` (a, b). Subtracting means takes the intercept out, so the normal equations
    are 3 x 3 and come from sums; a singular neighbourhood gives NULL.
    """
    own = points.select(F.col("id").alias("b"), *AXES, *[f"u{a}" for a in AXES])
    centre = points.select(F.col("id").alias("a"), *[F.col(a).alias(f"p{a}") for a in AXES], *[F.col(f"u{a}").alias(f"q{a}") for a in AXES])
    rel = near.select("a", "b").join(own, "b").join(centre, "a").select("a", *[(F.col(a) - F.col(f"p{a}")).alias(a) for a in AXES], *[(F.col(f"u{a}") - F.col(f"q{a}")).alias(f"u{a}") for a in AXES])
    sxx = [F.covar_pop(a, b).alias(f"s{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]]
    sxu = [F.covar_pop(a, f"u{b}").alias(f"t{b}{a}") for b in AXES for a in AXES]
    sums = rel.groupBy("a").agg(F.count("*").alias("n"), *sxx, *sxu)
    m = [F.col(f"s{''.join(sorted((a, b), key=AXES.index))}") for a in AXES for b in AXES]
    rows: list[Column] = []
    for b in AXES:
        rows += solve3(m, [F.col(f"t{b}{a}") for a in AXES])
    return sums.select(F.col("a").alias("id"), "n", *[h.alias(f"h{k}") for k, h in enumerate(rows)])


def rigid_removed(points: DataFrame) -> DataFrame:
    """``points`` with translation and small rotation taken out of (uz, uy, ux).

    u = t + w x r about the centroid: the rotation solves a 3 x 3 system of sums. What is broadcast is one row.
    """
    mean = points.agg(*[F.avg(c).alias(f"m{c}") for c in (*AXES, *[f"u{a}" for a in AXES])])
    rel = points.crossJoin(F.broadcast(mean)).select("*", *[(F.col(c) - F.col(f"m{c}")).alias(f"r{c}") for c in (*AXES, *[f"u{a}" for a in AXES])])
    z, y, x, uz, uy, ux = (F.col(f"r{c}") for c in (*AXES, *[f"u{a}" for a in AXES]))
    parts = rel.agg(F.sum(y * y + x * x).alias("a0"), F.sum(-z * y).alias("a1"), F.sum(-z * x).alias("a2"), F.sum(z * z + x * x).alias("a4"), F.sum(-y * x).alias("a5"), F.sum(z * z + y * y).alias("a8"), F.sum(y * ux - x * uy).alias("b0"), F.sum(x * uz - z * ux).alias("b1"), F.sum(z * uy - y * uz).alias("b2"))
    m = [F.col(c) for c in ("a0", "a1", "a2", "a1", "a4", "a5", "a2", "a5", "a8")]
    w = parts.select(*[c.alias(f"w{k}") for k, c in enumerate(solve3(m, [F.col("b0"), F.col("b1"), F.col("b2")]))])
    turn = rel.crossJoin(F.broadcast(w))
    w0, w1, w2 = (F.coalesce(f"w{k}", F.lit(0.0)) for k in range(3))
    out = {"uz": uz - (w1 * x - w2 * y), "uy": uy - (w2 * z - w0 * x), "ux": ux - (w0 * y - w1 * z)}
    return turn.select(*[(out[c] if c in out else F.col(c)).alias(c) for c in points.columns])


def rotations(gradients: DataFrame) -> DataFrame:
    """(id, angle, vol): rotation angle of the polar decomposition of I + H in degrees, and the volume change, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            f = part[[f"h{k}" for k in range(9)]].to_numpy(float).reshape(-1, 3, 3) + np.eye(3)
            ok = np.isfinite(f).all(axis=(1, 2))
            u, _, vt = np.linalg.svd(np.where(ok[:, None, None], f, np.eye(3)))
            flip = np.sign(np.linalg.det(u @ vt))
            u[:, :, 2] *= flip[:, None]
            trace = np.einsum("nii->n", u @ vt)
            angle = np.degrees(np.arccos(np.clip((trace - 1) / 2, -1, 1)))
            vol = np.linalg.det(np.where(ok[:, None, None], f, np.eye(3))) - 1
            yield pd.DataFrame({"id": part["id"], "angle": np.where(ok, angle, np.nan), "vol": np.where(ok, vol, np.nan)})

    out = gradients.select("id", *[f"h{k}" for k in range(9)]).mapInPandas(run, "id long, angle double, vol double")
    return out.select("id", F.nanvl("angle", F.lit(None).cast("double")).alias("angle"), F.nanvl("vol", F.lit(None).cast("double")).alias("vol"))


def affine_seed(before: DataFrame, after: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(stretch_z, shift_z, stretch_r): a start for matching from the quantiles of height and the rms radius of both clouds."""

    def shape(df: DataFrame, tag: str) -> DataFrame:
        mid = df.agg(F.avg("y").alias("my"), F.avg("x").alias("mx"))
        r2 = (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")) + (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx"))
        ends = exact_summary(df, {f"{tag}0": ("z", low), f"{tag}1": ("z", high)})
        return df.crossJoin(F.broadcast(mid)).agg(F.sqrt(F.avg(r2)).alias(f"{tag}r")).crossJoin(F.broadcast(ends))

    both = shape(before, "a").crossJoin(F.broadcast(shape(after, "b")))
    stretch = F.try_divide(F.col("b1") - F.col("b0"), F.col("a1") - F.col("a0"))
    return both.select(stretch.alias("stretch_z"), (F.col("b0") - stretch * F.col("a0")).alias("shift_z"), F.try_divide("br", "ar").alias("stretch_r"))


#: Bands of an outline, points that one needs, and the percentile that is the outer radius: fixed values.
BANDS, BAND_POINTS, OUTER = 40, 50, 0.98


def outline(points: DataFrame, bands: int = BANDS, least: int = BAND_POINTS, share: float = OUTER) -> DataFrame:
    """(h, cy, cx, r): axis and outer radius of a cloud (z, y, x) per band of height: medians, and the ``share`` percentile of the distance from them, at the
    band's middle. Bands are of equal height; those with fewer than ``least`` points are left out."""
    ends = points.agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    width = (F.col("z1") - F.col("z0")) / bands
    band = F.when(width > 0, F.least(F.floor((F.col("z") - F.col("z0")) / width), F.lit(bands - 1))).otherwise(F.lit(0)).cast("int")
    own = points.select("z", "y", "x").crossJoin(F.broadcast(ends)).withColumn("band", band)
    full = own.groupBy("band").agg(F.count("*").alias("n"), F.first(F.col("z0") + (F.col("band") + 0.5) * width).alias("h")).where(F.col("n") >= least)
    axis = full.join(exact_summary(own, {"cy": ("y", 0.5), "cx": ("x", 0.5)}, ["band"]), "band")
    off = own.join(axis, "band").withColumn("__d", F.sqrt((F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))))
    return axis.join(exact_summary(off, {"r": ("__d", share)}, ["band"]), "band").select("h", "cy", "cx", "r")


def _between(at: Column, knots: Column, field: str) -> Column:
    """Linear interpolation of a field of sorted knots (h, ...), clamped at the ends."""
    low = F.size(F.filter(knots, lambda k: k["h"] <= at)) - 1
    a = F.get(knots, F.greatest(low, F.lit(0)))
    b = F.get(knots, F.least(low + 1, F.size(knots) - 1))
    inside = (low >= 0) & (low + 1 < F.size(knots))
    return F.when(inside, a[field] + (b[field] - a[field]) * (at - a["h"]) / (b["h"] - a["h"])).when(low < 0, a[field]).otherwise(b[field])


def outline_seed(source: DataFrame, target: DataFrame, bands: int = BANDS, least: int = BAND_POINTS) -> DataFrame:
    """(id, z, y, x, sz, sy, sx): points of ``source`` with the shift that its outline's change to that of ``target`` predicts: heights stretch with the
    extents, the axis moves with height, and distances from it scale with the outer radius there. The outlines have a row a band; clouds of fewer points than
    a band needs have no outline, and then only the height is stretched."""
    knots = lambda df, name: outline(df, bands, least).agg(F.sort_array(F.collect_list(F.struct("h", "cy", "cx", "r"))).alias(name))
    ends = lambda df, tag: df.agg(F.min("z").alias(f"{tag}0"), F.max("z").alias(f"{tag}1"))
    both = source.select("id", *AXES)
    for small in (ends(source, "a"), ends(target, "b"), knots(source, "ka"), knots(target, "kb")):
        both = both.crossJoin(F.broadcast(small))
    rise = F.coalesce(F.try_divide(F.col("b1") - F.col("b0"), F.col("a1") - F.col("a0")), F.lit(1.0))
    both = both.withColumn("pz", F.col("b0") + (F.col("z") - F.col("a0")) * rise)
    of = lambda side, at, field: _between(F.col(at), F.col(side), field)
    both = both.withColumn("f", F.coalesce(F.try_divide(of("kb", "pz", "r"), of("ka", "z", "r")), F.lit(1.0)))
    for a in ("y", "x"):
        both = both.withColumn(f"p{a}", F.coalesce(of("kb", "pz", f"c{a}") + (F.col(a) - of("ka", "z", f"c{a}")) * F.col("f"), F.col(a)))
    return both.select("id", *AXES, *[(F.col(f"p{a}") - F.col(a)).alias(f"s{a}") for a in AXES])


def _first_cell(q: np.ndarray) -> np.ndarray:
    """Four points far from one plane: an end, the point furthest from it, from their line, and from the plane of the three."""
    a = int(q[:, 0].argmin())
    b = int(((q - q[a]) ** 2).sum(axis=1).argmax())
    line = np.cross(q - q[a], q[b] - q[a])
    c = int((line * line).sum(axis=1).argmax())
    d = int(np.abs((q - q[a]) @ line[c]).argmax())
    return np.array([a, b, c, d])


def delaunay(p: np.ndarray) -> np.ndarray:
    """Tetrahedra (n, 4) of a point set, by insertion: cells whose sphere holds the new point are opened and closed again over its faces.

    Outside of the hull each of its faces has a cell that reaches to infinity, and is opened by points beyond the face's plane, so flat tetrahedra
    at the hull aren't lost. A jitter of 1e-9 of the extent, from the points' numbers, settles points on one sphere. Fewer than four points, and
    points of one plane, give none.
    """
    n = len(p)
    if n < 4:
        return np.zeros((0, 4), int)
    extent = float(np.ptp(p, axis=0).max()) or 1.0
    q = (p - p.mean(axis=0)) / extent + np.random.default_rng(0).normal(scale=1e-9, size=p.shape)
    first = _first_cell(q)
    inner = q[first].mean(axis=0)
    if abs(np.linalg.det(q[first[1:]] - q[first[0]])) < 1e-7:
        return np.zeros((0, 4), int)

    def spheres(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = q[t[:, 1:]] - q[t[:, :1]]
        c = np.linalg.solve(2 * m, (m * m).sum(axis=2)[..., None])[..., 0]
        return q[t[:, 0]] + c, (c * c).sum(axis=1)

    def planes(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Normals of hull faces, away from the inside, and their offsets."""
        normal = np.cross(q[f[:, 1]] - q[f[:, 0]], q[f[:, 2]] - q[f[:, 0]])
        normal *= np.where(((inner - q[f[:, 0]]) * normal).sum(axis=1) > 0, -1.0, 1.0)[:, None]
        return normal, (normal * q[f[:, 0]]).sum(axis=1)

    faces_of = lambda t: t[:, [[1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2]]].reshape(-1, 3)
    cells = first[None]
    hull = faces_of(cells)
    centre, r2 = spheres(cells)
    normal, offset = planes(hull)
    for k in np.setdiff1d(np.arange(n), first).tolist():
        inside, beyond = ((centre - q[k]) ** 2).sum(axis=1) < r2, normal @ q[k] > offset
        #: The point at infinity is called n.
        open_ = np.concatenate([cells[inside], np.column_stack([hull[beyond], np.full(int(beyond.sum()), n)])])
        once, count = np.unique(np.sort(faces_of(open_), axis=1), axis=0, return_counts=True)
        once = once[count == 1]
        outer = once[:, 2] == n
        fresh = np.column_stack([once[~outer], np.full(int((~outer).sum()), k)])
        sides = np.column_stack([once[outer][:, :2], np.full(int(outer.sum()), k)])
        (c, r), (m, o) = spheres(fresh), planes(sides)
        cells, centre, r2 = np.concatenate([cells[~inside], fresh]), np.concatenate([centre[~inside], c]), np.concatenate([r2[~inside], r])
        hull, normal, offset = np.concatenate([hull[~beyond], sides]), np.concatenate([normal[~beyond], m]), np.concatenate([offset[~beyond], o])
    return cells


def tetra_gradients(points: DataFrame, key: str) -> DataFrame:
    """(key, n0 .. n3, volume, h0 .. h8): displacement gradient of each Delaunay tetrahedron, by groups of points that fit a task.

    ``points`` has (key, id, z, y, x, uz, uy, ux). Flat tetrahedra are left out.
    """
    kind = dict(points.dtypes)[key]
    names = [key, *[f"n{k}" for k in range(4)], "volume", *[f"h{k}" for k in range(9)]]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x, u = part[list(AXES)].to_numpy(float), part[[f"u{a}" for a in AXES]].to_numpy(float)
        t = delaunay(x)
        m = x[t[:, 1:]] - x[t[:, :1]]
        vol = np.abs(np.linalg.det(m)) / 6
        keep = vol > 1e-9 * float(np.ptp(x, axis=0).max() or 1.0) ** 3
        t, m, vol = t[keep], m[keep], vol[keep]
        h = np.linalg.solve(m, u[t[:, 1:]] - u[t[:, :1]]).swapaxes(1, 2).reshape(-1, 9) if len(t) else np.zeros((0, 9))
        return pd.DataFrame({key: part[key].iloc[0], **{f"n{k}": part.id.to_numpy()[t[:, k]] for k in range(4)}, "volume": vol, **{f"h{k}": h[:, k] for k in range(9)}})[names]

    ddl = f"{key} {kind}, n0 long, n1 long, n2 long, n3 long, volume double, " + ", ".join(f"h{k} double" for k in range(9))
    return points.select(key, "id", *AXES, *[f"u{a}" for a in AXES]).groupBy(key).applyInPandas(one, ddl)
