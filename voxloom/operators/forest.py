"""Minimum spanning forests that grow from roots, by rounds of least edges."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.components import components
from voxloom.scratch import Scratch, is_small

#: Edges that one task may finish.
ONE_TASK = 10_000


def least_links(first: np.ndarray, second: np.ndarray, outside: np.ndarray, rooted: np.ndarray) -> np.ndarray:
    """The tree of each node, for edges in their order: every tree without a root takes its first edge, until that leads ``outside`` or there is none.

    ``first`` and ``second`` are the nodes of the edges; an edge that leads outside has -1 as its second. ``rooted`` says which nodes are roots; two
    of them are never in one tree. The result is the least node of each tree.
    """
    n, none = len(rooted), len(first)
    top = np.arange(n)
    rooted, rank = rooted.copy(), np.arange(none)
    while True:
        a, b = top[first], np.where(outside, -1, top[second])
        live = (a != b) & ~(rooted[a] & (outside | rooted[np.maximum(b, 0)]))
        a, b, r = a[live], b[live], rank[live]
        best = np.full(n, none)
        np.minimum.at(best, a, r)
        np.minimum.at(best, b[b >= 0], r[b >= 0])
        pick = np.unique(best[(best < none) & ~rooted & (top == np.arange(n))])
        pick = pick[~outside[pick]]
        if not len(pick):
            return top
        x, y = top[first[pick]], top[second[pick]]
        while True:
            low = np.minimum(top[x], top[y])
            before = top.copy()
            np.minimum.at(top, top[x], low)
            np.minimum.at(top, top[y], low)
            top = top[top]
            if (top == before).all():
                break
        held = np.zeros(n, bool)
        np.logical_or.at(held, top, rooted)
        rooted = held


def rooted_forest(scratch: Scratch, edges: DataFrame, roots: DataFrame, order: Sequence[str], one_task: int = ONE_TASK, tag: str = "forest") -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b, order columns) the root it hangs from in the minimum spanning forest of the ``roots`` (node), NULL if it
    is connected with none. The order has to tell edges apart, so the forest is one.

    Each tree without a root takes its least edge (two such trees become one, and a tree that reaches a root is done); trees are contracted, and of
    the edges between two of them the least stays. What at most ``one_task`` edges are left of is finished by one task.
    """
    live = scratch.put(edges.select("a", "b", *order).where("a <> b"), f"{tag}-e0")
    named = scratch.put(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("tree", F.col("node")), f"{tag}-n0")
    hold = scratch.put(roots.select("node").distinct(), f"{tag}-r0")
    k = 0
    while not live.isEmpty():
        if is_small(live, one_task):
            step = _in_one_task(live, hold, order)
        else:
            least = lambda x, y: live.groupBy(F.col(x).alias("node")).agg(F.min(F.struct(*order, F.col(y).alias("to"))).alias("e"))  # noqa: B023, E731
            picks = least("a", "b").unionByName(least("b", "a")).groupBy("node").agg(F.min("e").alias("e"))
            picks = picks.join(hold, "node", "left_anti").select(F.col("node").alias("a"), F.col("e.to").alias("b"))
            step = components(scratch, picks, f"{tag}-c{k}").join(hold.withColumn("held", F.col("node")), "node", "left")
            step = step.join(step.groupBy("root").agg(F.coalesce(F.min("held"), F.min("node")).alias("tree")), "root").select("node", "tree")
        step = scratch.put(step, f"{tag}-s{k}")
        k += 1
        to = lambda c: F.coalesce(F.col(f"to_{c}"), F.col(c))
        moved = live.join(step.toDF("a", "to_a"), "a", "left").join(step.toDF("b", "to_b"), "b", "left").select(F.least(to("a"), to("b")).alias("a"), F.greatest(to("a"), to("b")).alias("b"), F.struct(*order).alias("o")).where("a <> b")
        moved = moved.groupBy("a", "b").agg(F.min("o").alias("o")).select("a", "b", "o.*")
        held = hold.select(F.col("node").alias("held"))
        both = moved.join(held.toDF("a"), "a", "left_semi").join(held.toDF("b"), "b", "left_semi").select("a", "b")
        live = scratch.put(moved.join(both, ["a", "b"], "left_anti"), f"{tag}-e{k}")
        named = scratch.put(named.join(step.toDF("tree", "next"), "tree", "left").select("node", F.coalesce("next", "tree").alias("tree")), f"{tag}-n{k}")
    return named.join(hold.select(F.col("node").alias("root")), F.col("tree") == F.col("root"), "left").select("node", "root")


def _in_one_task(live: DataFrame, roots: DataFrame, order: Sequence[str]) -> DataFrame:
    """(node, tree) of all the edges, at once."""
    marked = live.join(roots.toDF("a").withColumn("ra", F.lit(True)), "a", "left").join(roots.toDF("b").withColumn("rb", F.lit(True)), "b", "left").na.fill(False, ["ra", "rb"])

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order))
        nodes, at = np.unique(np.concatenate([part.a, part.b]), return_inverse=True)
        rooted = np.zeros(len(nodes), bool)
        np.logical_or.at(rooted, at, np.concatenate([part.ra, part.rb]).astype(bool))
        top = least_links(at[: len(part)], at[len(part) :], np.zeros(len(part), bool), rooted)
        name = np.where(rooted, nodes, np.iinfo(np.int64).max)
        tree = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(tree, top, name)
        tree = np.where(tree[top] == np.iinfo(np.int64).max, nodes[top], tree[top])
        return pd.DataFrame({"node": nodes, "tree": tree})

    return marked.groupBy().applyInPandas(one, "node long, tree long")
