"""Resampling tests of clustering: what is observed against draws of as many points, at several neighbourhood sizes.

All draws are clustered at once, at all sizes. Points of a draw go to tiles of space with a rim of the largest size, in which ``dense`` tells cores and links without
looking at all pairs of neighbours, which may be many for a point. A first pass says from which size on a point is a core, a second one which cores are linked from
which size on; of these links a tile gives only those that join something, so they are fewer than its points. Sizes are then gone through in
order: the clusters of one are the nodes of the next, and only the links that are new there are followed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.components import components
from voxloom.operators.dense import join, linked, sparse, tiled
from voxloom.operators.spatial import AXES
from voxloom.operators.stats import plane_fit, resampled
from voxloom.scratch import Scratch

#: Points that make a core, and that make a cluster a feature; draws; neighbourhoods in grain diameters: fixed values.
MIN_POINTS, MIN_CLUSTER, DRAWS = 5, 6, 400
SWEEP = (0.6, 0.8, 1.0, 1.25, 1.5, 2.0)
#: Edge of a tile in largest sizes, draws of a group, and the bits above a point's id in the id of the point in a draw.
TILE, DRAWS_A_GROUP, DRAW_BIT = 4, 8, 1 << 40


def _tiled(points: DataFrame, reach: float, one: Callable[[np.ndarray, pd.DataFrame], pd.DataFrame], ddl: str) -> DataFrame:
    """``one`` over the places and rows of each tile: its points (draw, id, z, y, x, own, ...) with those of a rim of ``reach``. A group is some draws of one tile."""
    spread, tile = tiled(points.withColumn("block", F.floor(F.col("draw") / DRAWS_A_GROUP)), reach, TILE * reach)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return one(part[list(AXES)].to_numpy(float), part)

    return spread.groupBy("block", *tile).applyInPandas(run, ddl)


def draw_clusters(scratch: Scratch, points: DataFrame, member: DataFrame, draws: int, eps: Sequence[float], min_points: int = MIN_POINTS, least: int = MIN_CLUSTER) -> DataFrame:
    """(level, draw, id, cluster): the points of the clusters of each draw at each neighbourhood size, the index of ``eps`` in rising order.

    ``points`` has (id, z, y, x), ids from 0 to 2**40 - 1; ``member`` (id, draw) the points of each draw, 0 to draws - 1. As in ``graph.dbscan`` points with
    ``min_points`` within reach, themselves included, are cores, other points join the lowest cluster that reaches them, and clusters below
    ``least`` points are left out; a cluster is called by its least core.
    """
    if list(eps) != sorted(eps):
        raise ValueError("sizes are given in rising order")
    if min_points <= 1:
        raise ValueError("a core needs another point within reach")
    sizes, reach = len(eps), float(eps[-1])
    placed = member.where(F.col("draw").between(0, draws - 1)).join(points.select("id", *AXES), "id").dropna(subset=list(AXES))
    placed = scratch.put(placed.select("draw", "id", *AXES), "placed")

    def cores(places: np.ndarray, part: pd.DataFrame) -> pd.DataFrame:
        own, draw = part.own.to_numpy(bool), part.draw.to_numpy()
        since = np.where(own, 0, sizes)
        for k, e in enumerate(eps):
            waits = np.flatnonzero(own & (since == k))
            if len(waits):
                since[waits[~sparse(places, since == k, e, min_points, draw)[0][waits]]] = k + 1
        return part.assign(since=since)[own][["draw", "id", *AXES, "since"]]

    known = scratch.put(_tiled(placed, reach, cores, "draw int, id long, z double, y double, x double, since int"), "known")

    def links(places: np.ndarray, part: pd.DataFrame) -> pd.DataFrame:
        own, draw, since = part.own.to_numpy(bool), part.draw.to_numpy(), part.since.to_numpy()
        pid = draw.astype(np.int64) * DRAW_BIT + part.id.to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        top, squares = np.arange(len(part)), np.array([e * e for e in eps])
        for k, e in enumerate(eps):
            #: At the last size at which a point isn't a core it has few points in reach, and these hold those of the sizes below.
            last = own & (since == k + 1)
            _, p, q = sparse(places, last, e, min_points, draw)
            d = places[p] - places[q]
            start = np.maximum(np.searchsorted(squares, d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]), since[q])
            at = start <= k
            out.append((pid[p[at]], pid[q[at]], start[at], np.full(int(at.sum()), k)))
            #: A point is reached by a core until it is one; cores are linked with what is new at a size.
            core = np.flatnonzero(since <= k)
            before = top.copy()
            join(top, core, core[linked(places[core], e, draw[core])])
            moved = np.flatnonzero((before == np.arange(len(top))) & (top != before))
            out.append((pid[moved], pid[top[moved]], np.full(len(moved), k), np.full(len(moved), -1)))
        a, b, start, end = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"a": a, "b": b, "start": start, "end": end})

    #: Links of cores have an end of -1; the others say by whom a point that isn't a core yet is reached.
    kinds = scratch.put(_tiled(known, reach, links, "a long, b long, start int, end int"), "links")
    since = known.where(F.col("since") < sizes).select((F.col("draw").cast("long") * DRAW_BIT + F.col("id")).alias("pid"), "since")
    tree, out = None, None
    for k in range(sizes):
        now = since.where(F.col("since") == k).select("pid", F.col("pid").alias("tree"))
        tree = now if tree is None else tree.unionByName(now)
        fresh = kinds.where((F.col("end") < 0) & (F.col("start") == k)).select("a", "b").distinct()
        moved = fresh.join(tree.toDF("a", "ta"), "a").join(tree.toDF("b", "tb"), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        joined = components(scratch, moved, f"cc{k}")
        held = tree.join(joined.toDF("tree", "root"), "tree", "left").withColumn("tree", F.coalesce("root", "tree")).drop("root")
        called = held.groupBy("tree").agg(F.min("pid").alias("cluster"))
        tree = scratch.put(held.join(called, "tree").select("pid", F.col("cluster").alias("tree")), f"tree{k}")
        reached = kinds.where((F.col("start") <= k) & (F.lit(k) <= F.col("end"))).select(F.col("a").alias("pid"), "b")
        border = reached.join(tree.toDF("b", "tree"), "b").groupBy("pid").agg(F.min("tree").alias("tree"))
        every = tree.unionByName(border)
        large = every.groupBy("tree").agg(F.count("*").alias("m")).where(F.col("m") >= least).select("tree")
        kept = every.join(large, "tree").select(F.lit(k).alias("level"), F.floor(F.col("pid") / DRAW_BIT).cast("int").alias("draw"), (F.col("pid") % DRAW_BIT).alias("id"), (F.col("tree") % DRAW_BIT).alias("cluster"))
        kept = scratch.put(kept, f"kept{k}")
        out = kept if out is None else out.unionByName(kept)
    return out


def clustering_sweep(points: DataFrame, broken: DataFrame, radius: float, eps_diameters: Sequence[float] = SWEEP, draws: int = DRAWS, seed: int = 1, min_points: int = MIN_POINTS, least: int = MIN_CLUSTER) -> DataFrame:
    """(eps_d, clusters, clusters_null, p_clusters, biggest, biggest_null, p_biggest, rms_r, rms_null, p_rms, frac_in) per neighbourhood size.

    ``points`` and its part ``broken`` have (id, z, y, x). The null draws as many of ``points`` without replacement, those with the least md5 of
    ``seed:draw:id``. p is the share of draws at or beyond what was observed, so it can be 0; rms in radii, smaller is flatter, and NULL without
    a cluster. What comes back to the driver is one number.
    """
    scratch = Scratch(points.sparkSession, "sweep")
    broken = scratch.put(broken.select("id", *AXES), "broken")
    many = broken.count()
    drawn = resampled(points.select("id"), many, draws, "id", seed).select("id", F.col("replica").alias("draw"))
    #: What was observed is one more draw.
    member = drawn.unionByName(broken.select("id", F.lit(draws).alias("draw")))
    eps = [e * 2 * radius for e in eps_diameters]
    found = draw_clusters(scratch, points.select("id", *AXES), member, draws + 1, eps, min_points, least)
    placed = found.join(points.select("id", *AXES), "id")
    planes = plane_fit(placed, ["level", "draw", "cluster"]).select("level", "draw", "n", "rms")
    per = planes.groupBy("level", "draw").agg(F.count("*").alias("n_clusters"), F.max("n").alias("biggest"), F.sum("n").alias("in_clusters"), F.min("rms").alias("best_rms"))
    domain = points.sparkSession.range(draws + 1).select(F.col("id").cast("int").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(len(eps) - 1))).alias("level"))
    got = scratch.put(domain.join(per, ["level", "draw"], "left").withColumn("rms", F.col("best_rms") / radius).na.fill(0, ["n_clusters", "biggest", "in_clusters"]), "got")
    seen = got.where(F.col("draw") == draws).select(F.col("level").alias("at"), F.col("n_clusters").alias("c0"), F.col("biggest").alias("b0"), F.col("in_clusters").alias("i0"), F.col("rms").alias("r0"))
    rows = got.where(F.col("draw") < draws).join(F.broadcast(seen), F.col("level") == F.col("at"))
    beyond = lambda c: F.avg(c.cast("int"))
    half = lambda c: F.percentile(c, F.lit(0.5))
    line = rows.groupBy("level", "c0", "b0", "i0", "r0").agg(half("n_clusters").alias("clusters_null"), beyond(F.col("n_clusters") >= F.col("c0")).alias("p_clusters"), half("biggest").alias("biggest_null"), beyond(F.col("biggest") >= F.col("b0")).alias("p_biggest"), half("rms").alias("rms_null"), beyond(F.col("rms") <= F.col("r0")).alias("p_rms"))
    size = F.get(F.array(*[F.lit(float(e)) for e in eps_diameters]), F.col("level"))
    return line.select(size.alias("eps_d"), F.col("c0").alias("clusters"), "clusters_null", "p_clusters", F.col("b0").alias("biggest"), "biggest_null", "p_biggest", F.col("r0").alias("rms_r"), "rms_null", "p_rms", (F.col("i0") / max(many, 1)).alias("frac_in"))
