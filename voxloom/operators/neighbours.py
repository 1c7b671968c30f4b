"""Nearest neighbours through a tree of cells that follows the points' density.

Points lie in the cells of a tree of boxes, each cut in two along every axis, down to where a cell holds few points. The trees of both sides are gone down
together: a round replaces each pair of boxes by the pairs of their children, and drops those that lie further apart than the distance within
which enough points are sure to be found. So rounds follow the depth of the trees, never the distances, where points are dense or far apart doesn't
matter, and only the last rounds have many pairs. What is left for a cell, its own points and the points of the boxes it kept, is one group, solved as arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.series import same_keys
from voxloom.scratch import Scratch

AXES = ("z", "y", "x")
#: Points of a cell at most, unless it is of the last level; levels, each of a bit an axis.
CELL_POINTS, LEVELS = 32, 18
_BOX = [f"{e}{a}" for e in ("lo_", "hi_") for a in AXES]


def _coded(df: DataFrame, ends: dict[str, float]) -> Column:
    """The number of the smallest cell that a point is in: a bit an axis and level, the first level on top. What lies outside of the ends is in the outermost cells."""
    places = []
    for a in AXES:
        low, high = ends[f"lo_{a}"], ends[f"hi_{a}"]
        share = (F.col(a) - low) / (high - low) if high > low else F.lit(0.0)
        places.append(F.least(F.greatest(F.floor(share * (1 << LEVELS)), F.lit(0)), F.lit((1 << LEVELS) - 1)).cast("long"))
    code = F.lit(0).cast("long")
    for level in range(LEVELS - 1, -1, -1):
        for p in places:
            code = code * 2 + F.shiftright(p, level).bitwiseAND(F.lit(1).cast("long"))
    return code.cast("long")


def _node(code: Column, level: Column) -> Column:
    """One number for a cell of a level: its code, and the level in the last digits."""
    return (F.call_function("shiftright", code, (3 * (F.lit(LEVELS) - level)).cast("int")) * 32 + level).cast("long")


class CellTree:
    """Tables of a tree: ``nodes`` (keys, node, parent, leaf, n and the box of the points in it) and ``points`` (keys, id, z, y, x, node of their leaf)."""

    def __init__(self, scratch: Scratch, points: DataFrame, ends: dict[str, float], keys: Sequence[str], id_col: str, cell_points: int, name: str) -> None:
        own = points.select(*keys, F.col(id_col).alias("id"), *[F.col(a).cast("double").alias(a) for a in AXES]).dropna(subset=list(AXES))
        own = scratch.put(own.withColumn("code", _coded(own, ends)), f"{name}-coded")
        boxes = [f(a).alias(f"{e}{a}") for e, f in (("lo_", F.min), ("hi_", F.max)) for a in AXES]
        cells = own.groupBy(*keys, "code").agg(F.count("*").alias("n"), *boxes)
        up = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumns({"node": _node(F.col("code"), F.col("level")), "parent": F.when(F.col("level") > 0, _node(F.col("code"), F.col("level") - 1))})
        every = up.groupBy(*keys, "node", "parent", "level").agg(F.sum("n").alias("n"), *[f(c).alias(c) for c, f in zip(_BOX, [F.min] * 3 + [F.max] * 3, strict=True)])
        heavy = F.col("n") > cell_points
        #: A cell is there if the one above holds many points; it is a leaf if it holds few, or is of the last level.
        every = scratch.put(every, f"{name}-every")
        split = every.where(heavy & (F.col("level") < LEVELS)).select(*keys, F.col("node").alias("parent"), F.lit(True).alias("split"))
        there = same_keys(every, split, [*keys, "parent"], "left").where(F.col("split") | (F.col("level") == 0))
        self.nodes = scratch.put(there.select(*keys, "node", "parent", (~heavy | (F.col("level") == LEVELS)).alias("leaf"), "n", *_BOX), f"{name}-nodes")
        leaves = self.nodes.where("leaf").select(*keys, "node", F.lit(True).alias("is_leaf"))
        path = own.withColumn("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: _node(F.col("code"), k))))
        self.points = scratch.put(same_keys(path, leaves, [*keys, "node"]).select(*keys, "id", *AXES, "node"), f"{name}-points")
        scratch.drop(f"{name}-coded", f"{name}-every")


def _down(tree: CellTree, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, name_up, name, name_leaf, name_n and the box): each box's children; a leaf is its own child."""
    columns = [F.col("node").alias(name), F.col("leaf").alias(f"{name}_leaf"), F.col("n").alias(f"{name}_n"), *[F.col(c).alias(f"{name}_{c}") for c in _BOX]]
    below = tree.nodes.where("parent is not null").select(*keys, F.col("parent").alias(f"{name}_up"), *columns)
    return below.unionByName(tree.nodes.where("leaf").select(*keys, F.col("node").alias(f"{name}_up"), *columns))


def _kept(pairs: DataFrame, keys: Sequence[str], need: int) -> DataFrame:
    """Of each box's partners those that may hold one of the nearest points: none that lies beyond the least distance within which enough points are sure to lie."""
    nearest = sum((_squared(F.greatest(F.col(f"r_lo_{a}") - F.col(f"q_hi_{a}"), F.col(f"q_lo_{a}") - F.col(f"r_hi_{a}"), F.lit(0.0))) for a in AXES), F.lit(0.0))
    furthest = sum((_squared(F.greatest(F.col(f"r_hi_{a}") - F.col(f"q_lo_{a}"), F.col(f"q_hi_{a}") - F.col(f"r_lo_{a}"))) for a in AXES), F.lit(0.0))
    cell = Window.partitionBy(*keys, "q")
    sure = F.sum("r_n").over(cell.orderBy("far", "r").rowsBetween(Window.unboundedPreceding, 0))
    marked = pairs.select(*keys, "q", "q_leaf", "r", "r_leaf", "r_n", nearest.alias("near"), furthest.alias("far")).withColumn("sure", sure)
    bound = F.min(F.when(F.col("sure") >= need, F.col("far"))).over(cell)
    return marked.withColumn("bound", bound).where(F.col("bound").isNull() | (F.col("near") <= F.col("bound") * (1 + 1e-12))).select(*keys, "q", "q_leaf", "r", "r_leaf")


def _squared(x: Column) -> Column:
    return x * x


def knn_join(left: DataFrame, right: DataFrame, k: int, keys: Sequence[str] = (), id_col: str = "id", skip_self: bool = False, cell_points: int = CELL_POINTS) -> DataFrame:
    """(keys, a, b, d, rank): for each point of ``left`` its k nearest of ``right`` within equal keys, ties to the smaller id; fewer where there are fewer.

    Points with a missing coordinate take no part; a missing key is a key. ``skip_self`` leaves out pairs of one id. A group is one cell of the
    left side: its points, and those of the boxes that may hold one of their nearest.
    """
    scratch = Scratch(left.sparkSession, "knn")
    both = left.select(*AXES).unionByName(right.select(*AXES))
    #: Far outliers don't make the cells coarse: beyond these ends all is in the outermost cells.
    share = [0.005, 0.995]
    ends_of = both.agg(*[F.percentile_approx(F.col(a).cast("double"), share, 10_000).alias(a) for a in AXES]).first()
    ends = {f"{e}{a}": ends_of[a][i] if ends_of[a] else 0.0 for i, e in enumerate(("lo_", "hi_")) for a in AXES}
    theirs = CellTree(scratch, right, ends, keys, id_col, cell_points, "right")
    ours = theirs if left is right else CellTree(scratch, left, ends, keys, id_col, cell_points, "left")
    need = k + bool(skip_self)
    q_down, r_down = _down(ours, keys, "q"), _down(theirs, keys, "r")
    top = lambda tree, name: tree.nodes.where("parent is null").select(*keys, F.col("node").alias(name), F.col("leaf").alias(f"{name}_leaf"))
    open_ = same_keys(top(ours, "q"), top(theirs, "r"), keys)
    for step in range(LEVELS + 1):
        open_ = scratch.put(open_, f"open{step}")
        if step:
            scratch.drop(f"open{step - 1}")
        if open_.where("not q_leaf or not r_leaf").isEmpty():
            break
        below = same_keys(open_.select(*keys, F.col("q").alias("q_up"), F.col("r").alias("r_up")), q_down, [*keys, "q_up"]).drop("q_up")
        open_ = _kept(same_keys(below, r_down, [*keys, "r_up"]).drop("r_up"), keys, need)
    near = same_keys(open_.select(*keys, "q", F.col("r").alias("node")), theirs.points, [*keys, "node"]).select(*keys, "q", "id", *AXES, F.lit(False).alias("own"))
    own = ours.points.select(*keys, F.col("node").alias("q"), "id", *AXES, F.lit(True).alias("own"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        mine, found = part[part.own], part[~part.own].sort_values("id")
        a, b = mine[list(AXES)].to_numpy(), found[list(AXES)].to_numpy()
        names, out = found.id.to_numpy(), []
        step = max(1, (1 << 22) // max(1, len(b)))
        for at in range(0, len(a), step):
            some, ids = a[at : at + step], mine.id.to_numpy()[at : at + step]
            d2 = sum((some[:, i, None] - b[None, :, i]) ** 2 for i in range(3))
            if skip_self:
                d2[ids[:, None] == names[None]] = np.inf
            take = np.argsort(d2, axis=1, kind="stable")[:, :k]
            d = np.take_along_axis(d2, take, axis=1)
            row, col = np.nonzero(np.isfinite(d))
            out.append(pd.DataFrame({"a": ids[row], "b": names[take[row, col]], "d": np.sqrt(d[row, col]), "rank": (col + 1).astype(np.int32)}))
        got = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "d": [], "rank": []})
        return got.assign(**{key: part[key].iloc[0] for key in keys})[[*keys, "a", "b", "d", "rank"]]

    kinds = dict(left.dtypes)
    ddl = "".join(f"`{key}` {kinds[key]}, " for key in keys) + f"a {kinds[id_col]}, b {dict(right.dtypes)[id_col]}, d double, rank int"
    return own.unionByName(near).groupBy(*keys, "q").applyInPandas(one, ddl)
