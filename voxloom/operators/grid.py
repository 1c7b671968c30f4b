"""Voxel-grid operators on the sparse view (scan, z, y, x, value): equi-joins on shifted coordinates and windows along lines."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from voxloom.operators.bricks import label as label_array
from voxloom.operators.components import components
from voxloom.operators.spatial import AXES
from voxloom.scratch import Scratch

KEY = ("scan", *AXES)


def offsets(connectivity: int, forward: bool = False) -> list[tuple[int, int, int]]:
    """Moves to the 6, 18 or 26 neighbours; forward: one of each opposite pair."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    every = [o for o in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= most]
    return [o for o in every if o > (0, 0, 0)] if forward else every


def shifted(vox: DataFrame, moves: Sequence[tuple[int, int, int]], keep: Sequence[str] = ()) -> DataFrame:
    """Each voxel once per move, at the place it is moved to, with the move's number as ``move``."""
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(d).alias(a) for d, a in zip(m, AXES, strict=True)]) for k, m in enumerate(moves)]))
    out = vox.select("scan", *AXES, *keep, table.alias("__m"))
    return out.select("scan", *[(F.col(a) + F.col(f"__m.{a}")).alias(a) for a in AXES], *keep, F.col("__m.k").alias("move"))


def adjacent(vox: DataFrame, connectivity: int, keep: Sequence[str]) -> DataFrame:
    """Each pair of neighbouring voxels once: (scan, keep of the first as a_*, of the second as b_*, move)."""
    near = shifted(vox, offsets(connectivity, forward=True), keep).withColumnsRenamed({c: f"a_{c}" for c in keep})
    return near.join(vox.select("scan", *AXES, *[F.col(c).alias(f"b_{c}") for c in keep]), [*KEY]).select("scan", *[f"a_{c}" for c in keep], *[f"b_{c}" for c in keep], "move")


def face_area(vox: DataFrame, solid: Column) -> DataFrame:
    """(scan, faces, interior): faces between air and solid voxels, and voxels. Nothing is wrapped round."""
    own = vox.withColumn("s", solid.cast("int"))
    faces = adjacent(own, 6, ["s"]).groupBy("scan").agg(F.sum((F.col("a_s") != F.col("b_s")).cast("long")).alias("faces"))
    return own.groupBy("scan").agg(F.count("*").alias("interior")).join(faces, "scan", "left").select("scan", F.coalesce("faces", F.lit(0)).alias("faces"), "interior")


def contact_pairs(vox: DataFrame, label: str, ice: Column, least: int) -> DataFrame:
    """(scan, lo, hi, faces, ice_faces) of neighbouring voxels of two labels; pairs below ``least`` faces are dropped."""
    own = vox.withColumn("ice", ice.cast("int")).withColumn("label", F.col(label)).where("label > 0")
    near = adjacent(own, 6, ["label", "ice"]).where("a_label <> b_label")
    lo, hi = F.least("a_label", "b_label").alias("lo"), F.greatest("a_label", "b_label").alias("hi")
    return near.groupBy("scan", lo, hi).agg(F.count("*").alias("faces"), F.sum(F.col("a_ice") * F.col("b_ice")).alias("ice_faces")).where(F.col("faces") >= least)


def by_bricks(vox: DataFrame, kernel: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: StructType | str, rim: int, edge: int) -> DataFrame:
    """``kernel`` over bricks of ``edge`` voxels with a rim. Voxels go to the bricks whose rim they are in, so little more than one copy of each is
    shuffled, and no map holds the places of a partition; a group is one brick.

    ``kernel`` gets the brick's rows, their places (3, n) in an array of edge + 2 rim cells along each axis, and which of them are the brick's own.
    """
    spread = vox
    for a in AXES:
        spread = spread.withColumn(f"__b{a}", F.explode(F.sequence(F.floor((F.col(a) - rim) / edge), F.floor((F.col(a) + rim) / edge))))

    def one(rows: pa.Table) -> pa.Table:
        at = np.stack([rows[a].to_numpy() - rows[f"__b{a}"][0].as_py() * edge + rim for a in AXES])
        core = ((at >= rim) & (at < edge + rim)).all(axis=0)
        return kernel(rows.drop_columns([f"__b{a}" for a in AXES]), at, core)

    return spread.groupBy("scan", *[f"__b{a}" for a in AXES]).applyInArrow(one, schema)


def _tallied(key: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
    """The keys, how often each is there, and its sums of the weights."""
    keys, of = np.unique(key, return_inverse=True)
    return [keys, np.bincount(of, minlength=len(keys)), *[np.bincount(of, w, len(keys)).astype(np.int64) for w in weights]]


def _grown(labels: np.ndarray, reach: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, place, name): the cells of ``where`` that a label reaches in ``reach`` face steps without being their own, by place, then by name."""
    flat = np.flatnonzero(labels > 0)
    flat = flat[np.argsort(labels.ravel()[flat], kind="stable")]
    names, first = np.unique(labels.ravel()[flat], return_index=True)
    index = np.arange(labels.size).reshape(labels.shape)
    place, name = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, spots in enumerate(np.split(flat, first[1:]) if len(names) else []):
        at = np.stack(np.unravel_index(spots, labels.shape))
        low, high = np.maximum(at.min(axis=1) - reach, 0), np.minimum(at.max(axis=1) + reach + 1, labels.shape)
        box = tuple(slice(i, j) for i, j in zip(low, high, strict=True))
        near = np.zeros(high - low, bool)
        near[tuple(at - low[:, None])] = True
        for _ in range(reach):
            wide = near.copy()
            for axis in range(3):
                to, of = (tuple(slice(None) if a != axis else x for a in range(3)) for x in (slice(1, None), slice(0, -1)))
                wide[to] |= near[of]
                wide[of] |= near[to]
            near = wide
        got = index[box][near & where[box] & (labels[box] != names[k])]
        place.append(got)
        name.append(np.full(len(got), k))
    place, name = np.concatenate(place), np.concatenate(name)
    order = np.argsort(place, kind="stable")
    return names, place[order], name[order]


def contact_zones(vox: DataFrame, label: str, pairs: DataFrame, air: Column, ice: Column, reach: int = 5, edge: int = 64) -> DataFrame:
    """(scan, lo, hi, zone, air, ice, contact) for every pair (scan, lo, hi): voxels outside of both bodies that both reach in ``reach`` face steps,
    how many of them are air and ice, and the voxels of lo that touch hi.

    Bodies grow as arrays inside of bricks with a rim of ``reach``; a brick gives a row per pair, and rows add up.
    """
    own = vox.select(*KEY, F.col(label).cast("long").alias("label"), F.coalesce(air.cast("int"), F.lit(0)).alias("air"), F.coalesce(ice.cast("int"), F.lit(0)).alias("ice")).where("label is not null")
    rim = max(reach, 1)
    schema = "scan int, lo long, hi long, zone long, air long, ice long, contact long"

    def kernel(rows: pa.Table, at: np.ndarray, core: np.ndarray) -> pa.Table:
        n = edge + 2 * rim
        labels, where = np.zeros((n, n, n), np.int64), np.zeros((n, n, n), bool)
        labels[tuple(at)] = rows["label"].to_numpy()
        where[tuple(at[:, core])] = True
        kinds = np.zeros((2, n, n, n), np.int8)
        for k, c in enumerate(("air", "ice")):
            kinds[k][tuple(at)] = rows[c].to_numpy()
        names, place, name = _grown(labels, reach, where)
        many = max(1, len(names))
        got = []
        for shift in itertools.count(1):
            same = np.flatnonzero(place[shift:] == place[:-shift])
            if not len(same):
                break
            key, spot = name[same] * many + name[same + shift], place[same]
            got.append([*_tallied(key, *[kinds[k].ravel()[spot] for k in (0, 1)]), None])
        touch = [np.zeros(0, np.int64)]
        mine = np.flatnonzero(where.ravel() & (labels.ravel() > 0))
        for step in (1, n, n * n):
            for to in (mine + step, mine - step):
                over = labels.ravel()[to] > labels.ravel()[mine]
                touch.append(mine[over] * many + np.searchsorted(names, labels.ravel()[to[over]]))
        both = np.unique(np.concatenate(touch))
        keys, count = _tallied(np.searchsorted(names, labels.ravel()[both // many]) * many + both % many)
        got.append([keys, *[np.zeros(len(keys), np.int64)] * 3, count])
        columns = [np.concatenate([np.zeros(len(g[0]), np.int64) if g[k] is None else g[k] for g in got]) for k in range(5)]
        pair = [names[i] if len(columns[0]) else columns[0] for i in np.divmod(columns[0], many)]
        scan = np.full(len(columns[0]), rows["scan"][0].as_py(), np.int32)
        return pa.table(dict(zip(("scan", "lo", "hi", "zone", "air", "ice", "contact"), [scan, *pair, *columns[1:]], strict=True)))

    counts = ("zone", "air", "ice", "contact")
    zones = by_bricks(own, kernel, schema, rim, edge).groupBy("scan", "lo", "hi").agg(*[F.sum(c).alias(c) for c in counts])
    return pairs.select("scan", "lo", "hi").join(zones, ["scan", "lo", "hi"], "left").na.fill(0, list(counts))


def territory(vox: DataFrame, label: str, radius: int, edge: int = 32) -> DataFrame:
    """(scan, z, y, x, label) of the free voxels (label 0) that have a body within ``radius`` voxels along each axis: the nearest, of equals the least label."""
    cube = sorted(itertools.product(range(-radius, radius + 1), repeat=3), key=lambda o: sum(k * k for k in o))
    own = vox.select(*KEY, F.col(label).alias("label")).where("label >= 0")
    kind = own.schema["label"].dataType

    def kernel(rows: pa.Table, at: np.ndarray, core: np.ndarray) -> pa.Table:
        n, own = edge + 2 * radius, rows["label"].to_numpy()
        none = np.iinfo(own.dtype).max
        v = np.full((n, n, n), none, own.dtype)
        v[tuple(at[:, own > 0])] = own[own > 0]
        free = np.flatnonzero(core & (own == 0))
        best = np.full(len(free), none, own.dtype)
        left = np.arange(len(free))
        for _, ring in itertools.groupby(cube, key=lambda o: sum(k * k for k in o)):
            spots = at[:, free[left]]
            best[left] = np.min([v[tuple(p + d for p, d in zip(spots, o, strict=True))] for o in ring], axis=0)
            left = left[best[left] == none]
        found = best != none
        return rows.select([*KEY]).take(free[found]).append_column("label", pa.array(best[found]))

    return by_bricks(own, kernel, StructType([*own.select(*KEY).schema.fields, StructField("label", kind)]), radius, edge)


def cube_extremes(vox: DataFrame, value: str, radius: int, outs: dict[str, Callable], edge: int = 32) -> DataFrame:
    """``vox`` with the largest (``F.max``) or least (``F.min``) value in the cube of edge 2 radius + 1 round each voxel, a column for each of ``outs``. Missing values and
    places without a voxel take no part."""
    kind = vox.schema[value].dataType

    def kernel(rows: pa.Table, at: np.ndarray, core: np.ndarray) -> pa.Table:
        column = rows[value].combine_chunks()
        have = column.is_valid().to_numpy(zero_copy_only=False)
        own, n = column.filter(pa.array(have)).to_numpy(zero_copy_only=False), edge + 2 * radius
        whole = np.issubdtype(own.dtype, np.integer)
        out = rows.filter(pa.array(core))

        def spread(v: np.ndarray, take: np.ufunc) -> np.ndarray:
            for axis in range(3):
                of = np.moveaxis(v, axis, 0)
                wide = of.copy()
                for shift in range(1, radius + 1):
                    take(wide[shift:], of[:-shift], out=wide[shift:])
                    take(wide[:-shift], of[shift:], out=wide[:-shift])
                v = np.moveaxis(wide, 0, axis)
            return v[tuple(at[:, core])]

        seen = np.zeros((n, n, n), bool)
        seen[tuple(at[:, have])] = True
        lost = None if have.all() else ~spread(seen, np.logical_or)
        for name, function in outs.items():
            #: NaN is above all numbers, as it is for Spark.
            take, fill = (np.fmin, np.iinfo(own.dtype).max if whole else np.nan) if function is F.min else (np.maximum, np.iinfo(own.dtype).min if whole else -np.inf)
            v = np.full((n, n, n), fill, own.dtype)
            take.at(v, tuple(at[:, have]), own)
            out = out.append_column(name, pa.array(spread(v, take), mask=lost))
        return out

    return by_bricks(vox, kernel, StructType([*vox.schema.fields, *[StructField(name, kind) for name in outs]]), radius, edge)


def max_filter(vox: DataFrame, value: str, radius: int, out: str, function=F.max) -> DataFrame:
    """``vox`` with the largest value in the cube of edge 2 radius + 1; ``F.min`` gives the least."""
    return cube_extremes(vox, value, radius, {out: function})


def dilated(mask: DataFrame, connectivity: int = 6) -> DataFrame:
    """Voxels of the mask and their neighbours."""
    return shifted(mask, [(0, 0, 0), *offsets(connectivity)]).select(*KEY).distinct()


def eroded(mask: DataFrame, times: int = 1, connectivity: int = 6) -> DataFrame:
    """Voxels of the mask all of whose neighbours are in it, repeated; what lies outside of the data isn't."""
    moves = offsets(connectivity)
    for _ in range(times):
        full = shifted(mask.select(*KEY), [(0, 0, 0), *moves]).groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") == len(moves) + 1)
        mask = full.select(*KEY)
    return mask


def voxel_id(shape: tuple[int, int, int]) -> Column:
    """Linear index within a scan, with the scan on top."""
    return ((F.col("scan").cast("long") * shape[0] + F.col("z")) * shape[1] + F.col("y")) * shape[2] + F.col("x")


#: Edge of the bricks that are labelled as arrays.
BRICK = 64


def labelled(mask: DataFrame, shape: tuple[int, int, int], connectivity: int, least: int = 1, brick: int = BRICK) -> DataFrame:
    """(scan, z, y, x, id, comp, size): components of the mask; comp is the smallest linear index, -1 where below ``least`` voxels.

    Bricks are labelled as arrays, and only what touches across their faces goes through the graph, so its size is that
    of the faces. A group is one brick.
    """
    scratch = Scratch(mask.sparkSession, "labelled")
    own = mask.select(*KEY, voxel_id(shape).alias("id"), *[F.floor(F.col(a) / brick).cast("int").alias(f"b{a}") for a in AXES])

    def one(part: pd.DataFrame) -> pd.DataFrame:
        at = part[list(AXES)].to_numpy()
        low = at.min(axis=0)
        m = np.zeros(at.max(axis=0) - low + 1, bool)
        place = tuple((at - low).T)
        m[place] = True
        part = part.assign(own=label_array(m, connectivity)[place])
        return part.assign(own=part.groupby("own")["id"].transform("min"))[[*KEY, "id", "own"]]

    local = scratch.put(own.groupBy("scan", *[f"b{a}" for a in AXES]).applyInPandas(one, "scan int, z int, y int, x int, id long, own long"), "local")
    edge = F.lit(False)
    for a in AXES:
        edge = edge | (F.col(a) % brick).isin(0, brick - 1)
    links = adjacent(local.where(edge), connectivity, ["own"]).where("a_own <> b_own").select(F.least("a_own", "b_own").alias("a"), F.greatest("a_own", "b_own").alias("b"))
    roots = components(scratch, links).toDF("own", "root")
    sizes = local.groupBy("own").agg(F.count("*").alias("n")).join(roots, "own", "left").select("own", F.coalesce("root", "own").alias("root"), "n")
    whole = sizes.groupBy("root").agg(F.min("own").alias("comp"), F.sum("n").alias("size"))
    named = sizes.join(whole, "root").select("own", F.when(F.col("size") >= least, F.col("comp")).otherwise(F.lit(-1)).alias("comp"), "size")
    return local.join(named, "own").select(*KEY, "id", "comp", "size")


def relabelled(df: DataFrame, comp: str = "comp", keys: Sequence[str] = ("scan",)) -> DataFrame:
    """Consecutive labels from 1 in the order of comp, 0 for -1."""
    ids = df.where(F.col(comp) >= 0).select(*keys, comp).distinct()
    ids = ids.withColumn("label", F.row_number().over(Window.partitionBy(*keys).orderBy(comp)))
    return df.join(ids, [*keys, comp], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def touching_ends(comps: DataFrame, depth: int) -> DataFrame:
    """(scan, comp, size, low, high): whether a component reaches the first and the last slice."""
    return comps.where("comp >= 0").groupBy("scan", "comp").agg(F.count("*").alias("size"), F.max(F.col("z") == 0).alias("low"), F.max(F.col("z") == depth - 1).alias("high"))


def percolation(comps: DataFrame, depth: int) -> DataFrame:
    """(scan, percolates, spanning, largest_share): spanning counts voxels of components that reach both ends."""
    ends = touching_ends(comps, depth)
    return ends.groupBy("scan").agg(F.max(F.col("low") & F.col("high")).alias("percolates"), F.sum(F.when(F.col("low") & F.col("high"), F.col("size")).otherwise(0)).alias("spanning"), (F.max("size") / F.sum("size")).alias("largest_share"))


def filled(mask: DataFrame, box: DataFrame, shape: tuple[int, int, int], connectivity: int = 6) -> DataFrame:
    """The mask with its holes: background that isn't connected to the box's border. ``box`` has every voxel of the domain."""
    back = labelled(box.select(*KEY).join(mask.select(*KEY), [*KEY], "left_anti"), shape, connectivity)
    edge = F.lit(False)
    for a, n in zip(AXES, shape, strict=True):
        edge = edge | (F.col(a) == 0) | (F.col(a) == n - 1)
    outside = back.where(edge).select("scan", "comp").distinct()
    return mask.select(*KEY).unionByName(back.join(outside, ["scan", "comp"], "left_anti").select(*KEY))


def mean_intercept(vox: DataFrame, phase: Column, axis: str) -> DataFrame:
    """(scan, mil): voxels of the phase to run starts along an axis."""
    others = [a for a in AXES if a != axis]
    w = Window.partitionBy("scan", *others).orderBy(axis)
    own = vox.where(phase).withColumn("before", F.lag(axis).over(w))
    start = F.sum((F.col("before").isNull() | (F.col("before") != F.col(axis) - 1)).cast("long"))
    return own.groupBy("scan").agg((F.count("*") / start).alias("mil"))


def two_point(vox: DataFrame, phase: Column, axis: str, lags: Sequence[int]) -> DataFrame:
    """(scan, lag, s2): chance that both ends of a lag along an axis are in the phase."""
    own = vox.withColumn("p", phase.cast("int"))
    moves = [tuple(r if a == axis else 0 for a in AXES) for r in lags]
    near = shifted(own, moves, ["p"]).withColumnRenamed("p", "q").join(own.select(*KEY, "p"), [*KEY])
    of = F.element_at(F.array(*[F.lit(r) for r in lags]), F.col("move") + 1)
    return near.groupBy("scan", of.alias("lag")).agg(F.avg(F.col("p") * F.col("q")).alias("s2"))


def majority(mask: DataFrame, k: int, shape: tuple[int, int, int]) -> DataFrame:
    """Blocks of k cubed voxels with more than half in the mask; the remainder at the ends is cut off."""
    inside = mask
    for a, n in zip(AXES, shape, strict=True):
        inside = inside.where(F.col(a) < n // k * k)
    return inside.groupBy("scan", *[F.floor(F.col(a) / k).cast("int").alias(a) for a in AXES]).agg(F.count("*").alias("n")).where(F.col("n") * 2 > k**3)


def mode_blocks(vox: DataFrame, code: str, k: int) -> DataFrame:
    """The most frequent code of each block, ties to the lowest."""
    at = [F.floor(F.col(a) / k).cast("int").alias(a) for a in AXES]
    counts = vox.groupBy("scan", *at, F.col(code).alias("code")).agg(F.count("*").alias("n"))
    return counts.groupBy("scan", *AXES).agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("code"))


def neighbourhood(vox: DataFrame, value: str, radius: int, how: Callable[[np.ndarray], np.ndarray], out: str, brick: int = 32) -> DataFrame:
    """``vox`` with ``how`` over the values in the cube around each voxel, fewer at the ends. Voxels go to the bricks whose rim they are in, so about one copy
    of each is shuffled; a group is one brick. ``how`` maps (cells of the cube, voxels), missing ones NaN and last, to a value a voxel."""
    spread = vox.select(*KEY, F.col(value).cast("double").alias("v"))
    for a in AXES:
        spread = spread.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(a) - radius) / brick), F.floor((F.col(a) + radius) / brick))))
    cube = list(itertools.product(range(2 * radius + 1), repeat=3))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        n = brick + 2 * radius
        at = np.stack([part[a].to_numpy() - int(part[f"b{a}"].iloc[0]) * brick + radius for a in AXES])
        v = np.full((n, n, n), np.nan)
        v[tuple(at)] = part.v
        core = ((at >= radius) & (at < brick + radius)).all(axis=0)
        place = at[:, core] - radius
        near = np.stack([v[tuple(p + d for p, d in zip(place, o, strict=True))] for o in cube])
        return part[core][[*KEY]].assign(**{out: how(np.sort(near, axis=0)) if core.any() else np.zeros(0)})

    near = spread.groupBy("scan", *[f"b{a}" for a in AXES]).applyInPandas(one, f"scan int, z int, y int, x int, {out} double")
    return vox.join(near, [*KEY])


def medians(near: np.ndarray) -> np.ndarray:
    """Medians of sorted columns whose missing cells are last."""
    n = (~np.isnan(near)).sum(axis=0)
    row = np.arange(near.shape[1])
    return (near[(n - 1) // 2, row] + near[n // 2, row]) / 2


def local_maxima(vox: DataFrame, value: str, radius: int = 1) -> DataFrame:
    """Voxels with the largest value of their cube; plateaus count whole."""
    return max_filter(vox, value, radius, "__top").where(F.col(value) == F.col("__top")).drop("__top")


def border_core(vox: DataFrame, label: str, radius: int) -> DataFrame:
    """(…, code): core (1) where the cube has one label, border (2) at other labelled voxels, else 0."""
    both = cube_extremes(vox, label, radius, {"__hi": F.max, "__lo": F.min})
    same = (F.col("__hi") == F.col("__lo")) & (F.col("__hi") == F.col(label))
    return both.withColumn("code", F.when(F.col(label) <= 0, 0).when(same, 1).otherwise(2)).drop("__hi", "__lo")


def half_sphere(n: int) -> list[tuple[float, float, float]]:
    """n nearly uniform unit directions (z, y, x) on a half sphere, along a golden spiral from the pole."""
    if n <= 1:
        return [(0.0, 0.0, 1.0)]
    turn, out = np.pi * (3.0 - np.sqrt(5.0)), []
    for k in range(n):
        up = 1.0 - k / (n - 1)
        ring = np.sqrt(max(0.0, 1.0 - up * up))
        out.append((float(np.sin(turn * k) * ring), float(up), float(np.cos(turn * k) * ring)))
    return out


def feret(vox: DataFrame, keys: Sequence[str], directions: int = 13) -> DataFrame:
    """(keys, feret_mean, feret_min): extents, plus one voxel, along directions of a half sphere, in one aggregation."""
    spans = []
    for d in half_sphere(directions):
        t = F.col("z") * d[0] + F.col("y") * d[1] + F.col("x") * d[2]
        spans.append(F.max(t) - F.min(t) + 1.0)
    got = vox.groupBy(*keys).agg(F.array(*spans).alias("spans"))
    return got.select(*keys, (F.aggregate("spans", F.lit(0.0), lambda a, x: a + x) / directions).alias("feret_mean"), F.array_min("spans").alias("feret_min"))


def crack_split(gaps: DataFrame, envelope: DataFrame, shape: tuple[int, int, int], void_below: float, min_body: int = 100, half_width: int = 5, skin: int = 20) -> DataFrame:
    """(scan, z, y, x, class) of gap voxels: bodies below ``min_body`` voxels are left out, those below ``void_below`` are void; of the rest,
    what survives ``half_width`` erosions is separation, and the crack is body inside of the envelope's skin, else surface."""
    comps = labelled(gaps, shape, 6).where(F.col("size") >= min_body)
    rest = comps.where(F.col("size") >= void_below).select(*KEY)
    deep = eroded(rest, half_width).withColumn("deep", F.lit(True))
    core = eroded(envelope.select(*KEY), skin).withColumn("core", F.lit(True))
    kind = F.when(F.col("size") < void_below, "void").when(F.col("deep"), "separation").when(F.col("core"), "body").otherwise("surface")
    return comps.join(deep, [*KEY], "left").join(core, [*KEY], "left").select(*KEY, kind.alias("class"))


def cubes(vox: DataFrame, phase: Column, shape: tuple[int, int], edge: int, many: int = 3, inside: float = 0.98) -> DataFrame:
    """(scan, k, z, edge, n, phi, accepted): cubes at ``many`` heights (two or more) from 0.28 to 0.72 of each specimen, round the centroid of its middle slice; n is how
    much of it is specimen, phi the share of the phase in that, NULL without any. A cube is accepted if it lies in the grid and more than ``inside`` of it is specimen.

    ``vox`` has the specimen's voxels alone, ``shape`` the extents in y and x. Slices with a quarter of the fullest one or less are cut off at the
    ends. Edges are even and at most the height less 2.
    """
    per = vox.groupBy("scan", "z").agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("x").alias("x"))
    full = per.join(per.groupBy("scan").agg(F.max("n").alias("most")), "scan").where("n > 0.25 * most")
    ends = full.groupBy("scan").agg(F.min("z").alias("low"), (F.max("z") - F.min("z") + 1).alias("nz"))
    mid = ends.join(per.select("scan", "z", "y", "x"), "scan").where("z = low + floor(nz / 2)")
    half = F.floor(F.least(F.lit(edge), F.col("nz") - 2) / 2).cast("int")
    top = F.col("nz") * 0.72
    rise = (top - F.col("nz") * 0.28) / (many - 1)
    k = F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("k")
    at = mid.select("scan", "low", "nz", half.alias("h"), F.floor("y").cast("int").alias("cy"), F.floor("x").cast("int").alias("cx"), k)
    at = at.withColumn("cz", F.floor(F.when(F.col("k") == many - 1, top).otherwise(F.col("nz") * 0.28 + F.col("k") * rise)).cast("int"))
    held = (F.col("cz") >= F.col("h")) & (F.col("cz") + F.col("h") <= F.col("nz")) & (F.col("h") > 0)
    for c, n in zip(("cy", "cx"), shape, strict=True):
        held = held & (F.col(c) >= F.col("h")) & (F.col(c) + F.col("h") <= n)
    at = at.withColumn("held", held).withColumn("cz", F.col("cz") + F.col("low"))
    #: Cubes are spread over the blocks that they touch, so that a scan isn't one key of the join.
    block, spread = 32, at
    for a in AXES:
        spread = spread.withColumn(f"__b{a}", F.explode(F.sequence(F.floor((F.col(f"c{a}") - F.col("h")) / block), F.floor((F.col(f"c{a}") + F.col("h")) / block))))
    both = vox.select(*KEY, phase.cast("int").alias("__p"), *[F.floor(F.col(a) / block).alias(f"__b{a}") for a in AXES]).join(spread, ["scan", *[f"__b{a}" for a in AXES]])
    for a in AXES:
        both = both.where((F.col(a) >= F.col(f"c{a}") - F.col("h")) & (F.col(a) < F.col(f"c{a}") + F.col("h")))
    got = both.groupBy("scan", "k").agg(F.count("*").alias("n"), F.avg("__p").alias("phi"))
    every = at.select("scan", "k", F.col("cz").alias("z"), (F.col("h") * 2).alias("edge"), "held").join(got, ["scan", "k"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return every.withColumn("accepted", F.col("held") & (F.col("n") > inside * F.col("edge") * F.col("edge") * F.col("edge"))).drop("held")


def framed(vox: DataFrame, shifts: DataFrame) -> DataFrame:
    """Voxels in the common frame: each scan moved by its whole offsets (scan, dz, dy, dx)."""
    return vox.join(shifts, "scan").select("scan", *[(F.col(a) + F.col(f"d{a}")).alias(a) for a in AXES], *[c for c in vox.columns if c not in KEY])


def checked_frames(shapes: DataFrame) -> DataFrame:
    """``shapes`` (scan, frame, nz, ny, nx); fails when it is read if frames or shapes within a frame differ."""
    every = Window.partitionBy()
    same = F.min("frame").over(every) == F.max("frame").over(every)
    for n in ("nz", "ny", "nx"):
        same = same & (F.min(n).over(every) == F.max(n).over(every))
    return shapes.withColumn("__ok", F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("scans of different frames or shapes")).cast("boolean"))).where("__ok").drop("__ok")


def oblique(vox: DataFrame, value: str, plane: DataFrame) -> DataFrame:
    """(scan, i, j, value): trilinear samples at the points (i, j, pz, py, px) of a plane; points with a missing corner are left out."""
    corners = list(itertools.product((0, 1), repeat=3))
    low = [F.floor(f"p{a}").cast("int").alias(a) for a in AXES]
    frac = [(F.col(f"p{a}") - F.floor(f"p{a}")).alias(f"f{a}") for a in AXES]
    at = shifted(plane.select("scan", *low, *frac, "i", "j"), corners, ["i", "j", *[f"f{a}" for a in AXES]])
    weight = F.lit(0.0)
    for k, c in enumerate(corners):
        w = F.lit(1.0)
        for bit, a in zip(c, AXES, strict=True):
            w = w * (F.col(f"f{a}") if bit else 1.0 - F.col(f"f{a}"))
        weight = F.when(F.col("move") == k, w).otherwise(weight)
    got = at.withColumn("w", weight).join(vox.select(*KEY, F.col(value).alias("v")), [*KEY])
    return got.groupBy("scan", "i", "j").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("v")).alias("value")).where("n = 8").drop("n")
