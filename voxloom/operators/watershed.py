"""Touching bodies split by a watershed that doesn't depend on how a scan is cut.

A voxel belongs to the marker that it hangs from in the minimum spanning forest of the voxel graph: faces between voxels are its edges, in
the order of the height that one has to climb to, then of the voxels' ids, so there is one forest. Bricks grow the trees as far as they can tell alone,
until a tree's least edge leads out of the brick; only the edges between the trees that are left go through rounds of the graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.bricks import distance_transform
from voxloom.operators.forest import ONE_TASK, least_links, rooted_forest
from voxloom.operators.grid import KEY, adjacent, dilated, labelled, voxel_id
from voxloom.operators.settle import EDGE, reconstructed, skeleton
from voxloom.operators.spatial import AXES
from voxloom.scratch import Scratch


def distances(mask: DataFrame) -> DataFrame:
    """(scan, z, y, x, d): distance of each voxel of the mask (scan, z, y, x) to the nearest place that isn't one. The nearest such place always touches the
    mask, so only a shell round it is looked at."""
    own = mask.select(*KEY)
    shell = dilated(own).select(*KEY).distinct().join(own, [*KEY], "left_anti")
    return distance_transform(own.withColumn("m", F.lit(True)).unionByName(shell.withColumn("m", F.lit(False))), "m")


def thick_skeleton(mask: DataFrame, edge: int = EDGE, rim: int = 8) -> DataFrame:
    """(scan, z, y, x, d): the mask's skeleton with ``distances``. Only where a brick and its rim don't tell them are those of the whole mask made."""
    scratch = Scratch(mask.sparkSession, "skeleton")
    own = scratch.put(skeleton(mask, edge, rim), "voxels")
    if own.where("d = double('inf')").isEmpty():
        return own
    return own.drop("d").join(distances(mask), [*KEY])


def _trees(part: pd.DataFrame, edge: int) -> pd.DataFrame:
    """Kernel of one brick with a rim of one voxel: each of its voxels with the tree it is in, and whether it lies beside another."""
    base = np.array([int(part[f"b{a}"].iloc[0]) * edge - 1 for a in AXES])
    at = part[list(AXES)].to_numpy() - base
    core = ((at >= 1) & (at <= edge)).all(axis=1)
    if not core.any():
        return part[core].assign(node=0, beside=False)[[*KEY, "id", "d", "node", "beside"]]
    place = np.full((edge + 2,) * 3, -1)
    place[tuple(at.T)] = np.arange(len(part))
    ids, d = part.id.to_numpy(), part.d.to_numpy()
    marker = part.marker.to_numpy()
    pairs = []
    for axis in range(3):
        low, high = (tuple(slice(None) if a != axis else s for a in range(3)) for s in (slice(0, -1), slice(1, None)))
        p, q = place[low].ravel(), place[high].ravel()
        both = (p >= 0) & (q >= 0)
        pairs.append(np.stack([p[both], q[both]]))
    p, q = np.concatenate(pairs, axis=1)
    inner = core[p] | core[q]
    p, q = p[inner], q[inner]
    order = np.lexsort((np.maximum(ids[p], ids[q]), np.minimum(ids[p], ids[q]), -np.minimum(d[p], d[q])))
    p, q = p[order], q[order]
    #: A node is a voxel, or all voxels of one marker.
    name = np.where(marker >= 0, 2 * marker + 1, 2 * ids)
    nodes, of = np.unique(name, return_inverse=True)
    outside = ~(core[p] & core[q])
    first, second = np.where(core[p], p, q), np.where(core[p], q, p)
    top = least_links(of[first], np.where(outside, 0, of[second]), outside, nodes % 2 == 1)
    #: A tree is called by its marker, else by its least voxel.
    called = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(called, top, np.where(nodes % 2 == 1, nodes - np.iinfo(np.int64).max, nodes))
    called = np.where(called < 0, called + np.iinfo(np.int64).max, called)
    tree = called[top][of]
    beside = np.zeros(len(part), bool)
    differs = outside | (tree[p] != tree[q])
    beside[p[differs]] = beside[q[differs]] = True
    return part.assign(node=tree, beside=beside)[core][[*KEY, "id", "d", "node", "beside"]]


def instances(mask: DataFrame, shape: tuple[int, int, int], h: float, edge: int = EDGE, one_task: int = ONE_TASK) -> DataFrame:
    """(scan, z, y, x, d, label): every voxel of the mask (scan, z, y, x) once, with its distance to the outside and the body it belongs to.

    Markers are the regional maxima of the distance that stand out by ``h``, joined where they touch; a body is called by the least linear index
    (in a grid of ``shape``) of its marker's voxels. Parts of the mask that aren't connected are never one body. The result is the same for every ``edge``.
    """
    scratch = Scratch(mask.sparkSession, "watershed")
    dist = scratch.put(distances(mask).withColumn("id", voxel_id(shape)), "dist")
    level = reconstructed(dist, "d", h, edge)
    maxima = dist.join(level, [*KEY]).where(F.col("d") - F.col("level") >= h - 1e-9)
    markers = labelled(maxima.select(*KEY), shape, 26).select(*KEY, F.col("comp").alias("marker"))
    marked = scratch.put(dist.join(markers, [*KEY], "left").withColumn("marker", F.coalesce("marker", F.lit(-1))), "marked")
    spread = marked
    for a in AXES:
        spread = spread.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(a) - 1) / edge), F.floor((F.col(a) + 1) / edge))))
    ddl = "scan int, z int, y int, x int, id long, d double, node long, beside boolean"
    local = scratch.put(spread.groupBy("scan", *[f"b{a}" for a in AXES]).applyInPandas(lambda part: _trees(part, edge), ddl), "trees")
    links = adjacent(local.where("beside"), 6, ["node", "d", "id"]).where("a_node <> b_node")
    links = links.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"), F.struct((-F.least("a_d", "b_d")).alias("w"), F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi")).alias("o"))
    edges = links.groupBy("a", "b").agg(F.min("o").alias("o")).select("a", "b", "o.*")
    roots = local.where("node % 2 = 1").select("node").distinct()
    found = rooted_forest(scratch, edges, roots, ["w", "lo", "hi"], one_task).select("node", "root")
    named = local.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named.select(*KEY, "d", F.floor((F.col("root") - 1) / 2).cast("long").alias("label"))
