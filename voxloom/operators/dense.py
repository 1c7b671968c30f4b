"""Which points a radius links, and which of them have enough others near, without the pairs, of which dense points have more than there is room for.

Points go to tiles of space with a rim of the radius. Inside of a tile they lie in cells so small that a cell's points are all within the radius of one another: a
cell is linked whatever it holds, and two cells by the first pair of points that is found. So a tile gives fewer links than it has points, and
pairs are only looked at between cells that nothing else links, some at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.neighbours import AXES

#: Edge of a cell in radii: its diagonal is shorter than a radius, and what lies further off than two cells is out of reach. Edge of a tile in radii, pairs held at once.
SIDE, TILE, HELD = 0.55, 4, 1 << 20
_MOVES = np.array(list(itertools.product(range(-2, 3), repeat=3)))


def join(top: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Lower the numbers of ``top`` to the least of what x and y link."""
    while True:
        last, low = top.copy(), np.minimum(top[x], top[y])
        np.minimum.at(top, top[x], low)
        np.minimum.at(top, top[y], low)
        top[:] = top[top]
        if (top == last).all():
            return


class Cells:
    """Points (n, 3) in cells; those of different ``group`` are never near."""

    def __init__(self, places: np.ndarray, radius: float, group: np.ndarray | None = None) -> None:
        self.places, self.limit = places, radius * radius
        at = np.floor(places / (SIDE * radius)).astype(np.int64)
        at = at - at.min(axis=0, initial=0 if not len(at) else np.iinfo(np.int64).max) + 2
        self.wide = at.max(axis=0, initial=0) + 3
        code = (at[:, 0] * self.wide[1] + at[:, 1]) * self.wide[2] + at[:, 2]
        if group is not None:
            code = code + np.unique(group, return_inverse=True)[1] * int(self.wide.prod())
        self.codes, self.cell, self.sizes = np.unique(code, return_inverse=True, return_counts=True)
        self.order = np.argsort(self.cell, kind="stable")
        self.first = np.cumsum(self.sizes) - self.sizes

    def beside(self, cells: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one, other): the cells that are there at the moves from ``cells``."""
        steps = (moves[:, 0] * self.wide[1] + moves[:, 1]) * self.wide[2] + moves[:, 2]
        to = (self.codes[cells][:, None] + steps[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.codes, to), len(self.codes) - 1)
        there = np.flatnonzero(self.codes[at] == to)
        return cells[there // len(steps)], at[there]

    def pairs(self, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, p, q): all pairs of a point of each cell, and which pair of cells they belong to."""
        many = self.sizes[one] * self.sizes[other]
        row = np.repeat(np.arange(len(one)), many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        wide = self.sizes[other][row]
        return row, self.order[self.first[one][row] + k // wide], self.order[self.first[other][row] + k % wide]

    def d2(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = self.places[p] - self.places[q]
        return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]


def _batches(weight: np.ndarray) -> Iterator[slice]:
    """Slices of at most HELD in all, or of one item."""
    total, at = np.cumsum(weight), 0
    while at < len(weight):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HELD, side="right")))
        yield slice(at, end)
        at = end


def linked(places: np.ndarray, radius: float, group: np.ndarray | None = None) -> np.ndarray:
    """For each point one of those that links at most ``radius`` long join it to, the same for all of them."""
    c = Cells(places, radius, group)
    top, lead = np.arange(len(c.codes)), c.order[c.first]
    if not len(places):
        return lead
    one, other = c.beside(top.copy(), _MOVES[len(_MOVES) // 2 + 1 :])
    near = c.d2(lead[one], lead[other]) <= c.limit
    join(top, one[near], other[near])
    low, high = (f.reduceat(places[c.order], c.first, axis=0) for f in (np.minimum, np.maximum))
    left = top[one] != top[other]
    one, other = one[left], other[left]
    gap = np.maximum(0.0, np.maximum(low[other] - high[one], low[one] - high[other]))
    left = (gap * gap).sum(axis=1) <= c.limit * (1 + 1e-9)
    one, other = one[left], other[left]
    few = np.argsort(c.sizes[one] * c.sizes[other], kind="stable")
    one, other = one[few], other[few]
    for some in _batches(c.sizes[one] * c.sizes[other]):
        a, b = one[some], other[some]
        left = top[a] != top[b]
        a, b = a[left], b[left]
        if len(a) == 1 and c.sizes[a[0]] * c.sizes[b[0]] > HELD:
            if _touch(c, a[0], b[0], low, high):
                join(top, a, b)
            continue
        row, p, q = c.pairs(a, b)
        hit = np.unique(row[c.d2(p, q) <= c.limit])
        join(top, a[hit], b[hit])
    return lead[top[c.cell]]


def _touch(c: Cells, one: int, other: int, low: np.ndarray, high: np.ndarray) -> bool:
    """Whether two large cells have points in reach of each other, of those that are in reach of the other's box."""
    sides = []
    for mine, box in ((one, other), (other, one)):
        rows = c.order[c.first[mine] : c.first[mine] + c.sizes[mine]]
        gap = np.maximum(0.0, np.maximum(low[box] - c.places[rows], c.places[rows] - high[box]))
        sides.append(rows[(gap * gap).sum(axis=1) <= c.limit * (1 + 1e-9)])
    p, q = sides
    step = max(1, HELD // max(1, len(q)))
    return any((c.d2(np.repeat(p[k : k + step], len(q)), np.tile(q, len(p[k : k + step]))) <= c.limit).any() for k in range(0, len(p), step))


def sparse(places: np.ndarray, own: np.ndarray, radius: float, least: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(many, p, q): whether each own point has ``least`` points within the radius, itself included, and for those that haven't all others that are. Rows that aren't
    own are taken to have many."""
    many = np.ones(len(places), bool)
    nothing = np.zeros(0, np.int64)
    if not own.any() or least <= 1:
        return many, nothing, nothing
    c = Cells(places, radius, group)
    thin = np.flatnonzero((c.sizes < least) & (np.bincount(c.cell[own], minlength=len(c.codes)) > 0))
    found_p, found_q = [nothing], [nothing]
    for some in _batches(np.full(len(thin), len(_MOVES))):
        a, b = c.beside(thin[some], _MOVES)
        cells, at = np.unique(a, return_index=True)
        ends = np.append(at, len(a))
        weight = np.add.reduceat(c.sizes[a] * c.sizes[b], at) if len(a) else nothing
        for few in _batches(weight):
            rows = slice(ends[few.start], ends[few.stop])
            _, p, q = c.pairs(a[rows], b[rows])
            near = own[p] & (p != q) & (c.d2(p, q) <= c.limit)
            p, q = p[near], q[near]
            mine = c.order[np.concatenate([np.arange(c.first[k], c.first[k] + c.sizes[k]) for k in cells[few]])] if len(cells[few]) else nothing
            counts = np.bincount(p, minlength=len(places)) if len(p) > len(places) // 8 else None
            n = counts[mine] if counts is not None else np.searchsorted(np.sort(p), mine, side="right") - np.searchsorted(np.sort(p), mine, side="left")
            many[mine[own[mine] & (n + 1 < least)]] = False
            lone = ~many[p]
            found_p.append(p[lone])
            found_q.append(q[lone])
    return many, np.concatenate(found_p), np.concatenate(found_q)


def tiled(points: DataFrame, reach: float, tile: float) -> tuple[DataFrame, list[str]]:
    """``points`` in every tile whose rim of ``reach`` they are in, with ``own`` for that which they lie in, and the names of a tile's columns. Points without a
    place are in none."""
    finite = F.lit(True)
    for a in AXES:
        finite = finite & F.abs(F.col(a)).isNotNull() & (F.abs(F.col(a)) < F.lit(float("inf")))
    spread, inside, rim = points.where(finite), F.lit(True), reach * (1 + 1e-9)
    for a in AXES:
        at = lambda shift, a=a: F.floor((F.col(a) + shift) / tile)
        spread = spread.withColumn(f"t{a}", F.explode(F.sequence(at(-rim), at(rim))))
        inside = inside & (F.col(f"t{a}") == at(0.0))
    return spread.withColumn("own", inside), [f"t{a}" for a in AXES]


def radius_links(points: DataFrame, radius: float, keys: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """(a, b): links of points to points that join just what all pairs at most ``radius`` apart join, within equal keys; fewer than a tile has points. Ids are unique
    over all keys, the radius is above 0."""
    if radius <= 0:
        raise ValueError("a radius is above 0")
    spread, tile = tiled(points.select(*keys, F.col(id_col).alias("id"), *AXES).dropna(subset=list(keys)), radius, TILE * radius)
    kind = dict(points.dtypes)[id_col]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        root, ids = linked(part[list(AXES)].to_numpy(float), radius), part.id.to_numpy()
        #: Rims that nothing links to an own point are other tiles' affair.
        mine = np.zeros(len(part), bool)
        mine[root[part.own.to_numpy(bool)]] = True
        kept = np.flatnonzero(mine[root] & (root != np.arange(len(part))))
        return pd.DataFrame({"a": ids[kept], "b": ids[root[kept]]})

    return spread.groupBy(*keys, *tile).applyInPandas(one, f"a {kind}, b {kind}")


def neighbourhoods(points: DataFrame, radius: float, least: int, keys: Sequence[str] = (), id_col: str = "id") -> DataFrame:
    """(keys, id, z, y, x, many, near): whether a point has ``least`` points within the radius, itself included, and if not the ids of the others that are; without
    points that have no place."""
    if radius <= 0:
        raise ValueError("a radius is above 0")
    spread, tile = tiled(points.select(*keys, id_col, *[F.col(a).cast("double").alias(a) for a in AXES]).dropna(subset=list(keys)), radius, TILE * radius)
    kinds = {c: k for c, k in spread.dtypes}

    def one(part: pd.DataFrame) -> pd.DataFrame:
        own, ids = part.own.to_numpy(bool), part[id_col].to_numpy()
        many, p, q = sparse(part[list(AXES)].to_numpy(float), own, radius, least)
        near: list[list] = [[] for _ in range(len(part))]
        for i, j in zip(p.tolist(), ids[q].tolist(), strict=True):
            near[i].append(j)
        return part[[*keys, id_col, *AXES]].assign(many=many, near=near)[own]

    return spread.groupBy(*keys, *tile).applyInPandas(one, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, id_col, *AXES]) + f", many boolean, near array<{kinds[id_col]}>")
