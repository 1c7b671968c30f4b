"""Connected components by edge contraction; all state is in tables, none on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.scratch import Scratch

#: Edges that one task may finish.
ONE_TASK = 10_000


def components(scratch: Scratch, edges: DataFrame, tag: str = "cc", one_task: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is a node of the same component, equal for all of it.

    Each round maps every node to that of itself and its neighbours which is least in an order by hash, new in each
    round, and contracts the edges by that map. Stars vanish in two or three rounds; a path, in whatever order its ids
    are, loses a share of its nodes in each, so rounds grow with the log of its length. Minima are combined map-side, so a hub with
    a third of all edges is one row per task. Once at most ``one_task`` edges are left, one task finishes them, which spares the last rounds.
    No edges: an empty result. Self loops and repeats are ignored.
    """
    most = ONE_TASK if one_task is None else one_task
    live = scratch.put(edges.select("a", "b").where("a <> b").distinct(), f"{tag}-e0")
    maps, k = [], 0
    while left := live.limit(most + 1).count():
        if left <= most:
            maps.append(scratch.put(_at_once(live), f"{tag}-m{k}"))
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c, k=k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("n"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(ranked("b")).alias("b"))
        step = scratch.put(least.select("node", F.least("b", ranked("node"))["n"].alias("root")), f"{tag}-m{k}")
        maps.append(step)
        to_a, to_b = step.toDF("a", "ra"), step.toDF("b", "rb")
        k += 1
        live = scratch.put(live.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{tag}-e{k}")
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for step in maps[1:]:
        out = out.join(step.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return scratch.put(out, f"{tag}-out")


def _at_once(live: DataFrame) -> DataFrame:
    """(node, root) of all the edges, the least node of each component being its root."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([part.a, part.b]), return_inverse=True)
        first, second, top = at[: len(part)], at[len(part) :], np.arange(len(nodes))
        while True:
            before, low = top.copy(), np.minimum(top[first], top[second])
            np.minimum.at(top, top[first], low)
            np.minimum.at(top, top[second], low)
            top = top[top]
            if (top == before).all():
                return pd.DataFrame({"node": nodes, "root": nodes[top]})

    kind = dict(live.dtypes)["a"]
    return live.groupBy().applyInPandas(one, f"node {kind}, root {kind}")
