"""Brick kernels that settle by exchanging faces: distances along paths, reconstruction, thinning.

A scan is cut into bricks of ``edge`` voxels. A brick is solved alone, with a rim of what its neighbours last had there; what changed
near its faces goes to the neighbours, and bricks that get something are solved again, until nothing changes. A group is one brick and the
rims that it was sent, so no task holds more, and a round moves on by whole bricks: rounds follow the number of bricks that a path
crosses, not its steps.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.bricks import edt, simple_points
from voxloom.operators.spatial import AXES
from voxloom.scratch import Scratch

#: Edge of a brick.
EDGE = 64
MOVES = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
_BRICK = ["scan", "bz", "by", "bx"]
_ROWS = pa.schema([("scan", pa.int32()), ("bz", pa.int32()), ("by", pa.int32()), ("bx", pa.int32()), ("move", pa.int32()), ("fixed", pa.binary()), ("value", pa.binary()), ("changed", pa.int64())])
_DDL = "scan int, bz int, by int, bx int, move int, fixed binary, value binary, changed long"

#: Bricks are held compressed, so that what Spark takes a partition for is what its tasks hold.
_CODEC = pa.Codec("zstd", 1)


def _packed(v: np.ndarray) -> bytes:
    """The array's bytes, compressed, behind their number."""
    raw = np.ascontiguousarray(v).tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpacked(data: bytes, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), kind).reshape(shape)


#: (fixed, value, round) -> value: arrays of edge + 2 rim cells along each axis; what it says of the rim is passed over.
Solver = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def _inside(move: Sequence[int], edge: int, rim: int) -> tuple[slice, ...]:
    """The cells of a brick that lie in the rim of its neighbour at a move."""
    return tuple(slice(rim, edge + rim) if not m else slice(edge, edge + rim) if m > 0 else slice(rim, 2 * rim) for m in move)


def _rim(move: Sequence[int], edge: int, rim: int) -> tuple[slice, ...]:
    """The cells of a brick's rim that belong to its neighbour at a move."""
    return tuple(slice(rim, edge + rim) if not m else slice(edge + rim, edge + 2 * rim) if m > 0 else slice(0, rim) for m in move)


def laid_out(vox: DataFrame, fixed: str, value: str, outside: tuple[float, float], edge: int, rim: int, kind: type = np.float64) -> DataFrame:
    """Bricks of the voxels (scan, z, y, x, fixed, value), rims included, as arrays of a ``kind``; cells without a voxel hold ``outside``. Bricks without voxels of
    their own are left out."""
    spread = vox.select("scan", *AXES, F.col(fixed).cast("double").alias("f"), F.col(value).cast("double").alias("v"))
    for a in AXES:
        spread = spread.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(a) - rim) / edge), F.floor((F.col(a) + rim) / edge))))
    n = edge + 2 * rim

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        at = tuple((part[a] - int(first[f"b{a}"]) * edge + rim).to_numpy() for a in AXES)
        if not np.all([(rim <= x) & (x < edge + rim) for x in at], axis=0).any():
            return pd.DataFrame([], columns=_ROWS.names)
        arrays = []
        for name, other in zip(("f", "v"), outside, strict=True):
            arrays.append(np.full((n, n, n), other, kind))
            arrays[-1][at] = part[name]
        return pd.DataFrame([(*[int(first[c]) for c in _BRICK], -1, *[_packed(a) for a in arrays], 1)], columns=_ROWS.names)

    return spread.groupBy(*_BRICK).applyInPandas(pack, _DDL)


def settled(scratch: Scratch, bricks: DataFrame, solve: Solver, edge: int, rim: int, open_: Callable[[np.ndarray], int] | None = None, max_rounds: int = 10_000, kind: type = np.float64) -> DataFrame:
    """``bricks`` of ``laid_out`` after as many rounds as it takes until one changes nothing. Bricks that were sent something are solved; where rounds differ, ``open_``
    says of a brick how many of its cells any round could change as it is, and those with some are solved, until none has any. Each round is a table, so its
    bricks are read, not computed, by the next; the one before is deleted. More than ``max_rounds`` is an error."""
    n = edge + 2 * rim

    def round_of(k: int):
        def one(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            own = [r for r in rows if r["move"] < 0]
            if not own:
                return table.slice(0, 0)
            (own,) = own
            sent = [r for r in rows if r["move"] >= 0]
            if k and not sent and not (open_ and own["changed"]):
                return pa.Table.from_pylist([own | {"changed": 0}], _ROWS)
            fixed, value = (_unpacked(own[c], kind, (n, n, n)) for c in ("fixed", "value"))
            value = value.copy()
            for r in sent:
                place = _rim(MOVES[r["move"]], edge, rim)
                value[place] = _unpacked(r["value"], kind, value[place].shape)
            core = (slice(rim, edge + rim),) * 3
            left = open_(value) if open_ else 0
            new = solve(fixed, value, k) if left or not open_ else value.copy()
            changed = new[core] != value[core]
            value[core] = new[core]
            out = [own | {"value": _packed(value), "changed": int(changed.sum()) + left}]
            differs = np.zeros((n, n, n), bool)
            differs[core] = changed
            for m, move in enumerate(MOVES):
                place = _inside(move, edge, rim)
                if differs[place].any():
                    to = {f"b{a}": own[f"b{a}"] + d for a, d in zip(AXES, move, strict=True)}
                    out.append({"scan": own["scan"], **to, "move": MOVES.index(tuple(-d for d in move)), "value": _packed(value[place]), "changed": 0})
            return pa.Table.from_pylist(out, _ROWS)

        return one

    state = bricks
    for k in range(max_rounds + 1):
        state = scratch.put(state.groupBy(*_BRICK).applyInArrow(round_of(k), _DDL), f"round{k}")
        if k:
            scratch.drop(f"round{k - 1}")
        if not state.agg(F.sum("changed")).first()[0]:
            return state.where("move < 0")
        if k == max_rounds:
            break
    raise RuntimeError(f"bricks still change after {max_rounds} rounds")


def cells(bricks: DataFrame, value: str, edge: int, rim: int, kept: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: type = np.float64, measure: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(scan, z, y, x, value): the cells of settled bricks where ``kept`` of (fixed, value) holds, with their values or what ``measure`` makes of the brick's fixed ones."""
    n, schema = edge + 2 * rim, pa.schema([("scan", pa.int32()), *[(a, pa.int32()) for a in AXES], (value, pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        core, (r,) = (slice(rim, edge + rim),) * 3, table.to_pylist()
        fixed, v = (_unpacked(r[c], kind, (n, n, n)) for c in ("fixed", "value"))
        at = np.argwhere(kept(fixed[core], v[core]))
        v = (measure(fixed) if measure else v)[core]
        place = [(at[:, i] + r[f"b{a}"] * edge).astype(np.int32) for i, a in enumerate(AXES)]
        return pa.Table.from_arrays([pa.array(np.full(len(at), r["scan"], np.int32)), *map(pa.array, place), pa.array(v[tuple(at.T)].astype(np.float64))], schema=schema)

    #: By brick: a batch of a partition would hold many.
    return bricks.groupBy(*_BRICK).applyInArrow(run, f"scan int, z int, y int, x int, {value} double")


def _moved(v: np.ndarray, move: Sequence[int], fill: float) -> np.ndarray:
    """out[p] = v[p + move]; outside is ``fill``."""
    out = np.full_like(v, fill)
    to = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(move, v.shape, strict=True))
    of = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(move, v.shape, strict=True))
    out[to] = v[of]
    return out


def geodesic_distance(vox: DataFrame, cost: str, start: str, moves: int = 26, edge: int = EDGE, lengths: bool = True) -> DataFrame:
    """(scan, z, y, x, dist): least length of a path from the ``start`` voxels (a boolean column) through voxels whose cost isn't NULL: a move's
    length (or without ``lengths`` 1) times the mean cost of its ends. ``moves``: 26, or 6 along faces. Voxels that can't be reached are left out."""
    steps = [m for m in MOVES if moves == 26 or sum(map(abs, m)) == 1]
    open_ = vox.where(F.col(cost).isNotNull()).select("scan", *AXES, F.col(cost).alias("f"), F.when(F.col(start), 0.0).otherwise(F.lit(float("inf"))).alias("v"))

    def solve(fixed: np.ndarray, value: np.ndarray, _: int) -> np.ndarray:
        far = [(m, (sum(map(abs, m)) ** 0.5 if lengths else 1.0) * (fixed + _moved(fixed, m, np.inf)) / 2) for m in steps]
        value = value.copy()
        while True:
            before = value.copy()
            for m, length in far:
                np.minimum(value, _moved(value, m, np.inf) + length, out=value)
            if (value == before).all():
                return value

    scratch = Scratch(vox.sparkSession, "geodesic")
    done = settled(scratch, laid_out(open_, "f", "v", (np.inf, np.inf), edge, 1), solve, edge, 1)
    return cells(done, "dist", edge, 1, lambda f, v: np.isfinite(v))


def reconstructed(vox: DataFrame, height: str, drop: float, edge: int = EDGE) -> DataFrame:
    """(scan, z, y, x, level): the heights lowered by ``drop``, grown over faces as far as the heights allow, within the voxels. Where a level
    lies ``drop`` below its height, nothing higher can be reached without going down by as much: these are the maxima that stand out."""
    own = vox.select("scan", *AXES, F.col(height).alias("f"), (F.col(height) - drop).alias("v"))
    faces = [m for m in MOVES if sum(map(abs, m)) == 1]

    def solve(fixed: np.ndarray, value: np.ndarray, _: int) -> np.ndarray:
        value = value.copy()
        while True:
            before = value.copy()
            for m in faces:
                np.maximum(value, np.minimum(fixed, _moved(value, m, -np.inf)), out=value)
            if (value == before).all():
                return value

    scratch = Scratch(vox.sparkSession, "reconstructed")
    done = settled(scratch, laid_out(own, "f", "v", (-np.inf, -np.inf), edge, 1), solve, edge, 1)
    return cells(done, "level", edge, 1, lambda f, v: f > -np.inf)


#: Faces from which a skeleton is thinned, in turn, and the classes of voxels that are taken at once: no two of a class are neighbours.
_FACES = [m for m in MOVES if sum(map(abs, m)) == 1]
_CLASSES = list(itertools.product((0, 1), repeat=3))
SUB_STEPS = len(_FACES) * len(_CLASSES)


def thinning_step(mask: np.ndarray, step: int, origin: Sequence[int]) -> np.ndarray:
    """``mask`` without the voxels of one class that lie at one face and are simple; ends stay. As no two of a class are neighbours, their order
    doesn't matter. ``origin`` is the place of the array's first cell, which says what class a cell is of. Cells at the array's border stay."""
    face, parity = _FACES[step // len(_CLASSES) % len(_FACES)], _CLASSES[step % len(_CLASSES)]
    first = [(p - o) % 2 for p, o in zip(parity, origin, strict=True)]
    first = [f if f else 2 for f in first]
    inner = tuple(slice(f, n - 1, 2) for f, n in zip(first, mask.shape, strict=True))
    beside = lambda m: mask[tuple(slice(s.start + d, s.stop + d, 2) for s, d in zip(inner, m, strict=True))]
    at = np.nonzero(mask[inner] & ~beside(face))
    if not len(at[0]):
        return mask
    out = mask.copy()
    place = np.ravel_multi_index([s.start + 2 * i for s, i in zip(inner, at, strict=True)], mask.shape)
    out.ravel()[place[_goes(mask, place)]] = False
    return out


def _goes(mask: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the cells at these flat places, none of them at the array's border, are simple and no ends."""
    flat, wide = np.ascontiguousarray(mask).ravel(), (mask.shape[1] * mask.shape[2], mask.shape[2], 1)
    bits = np.zeros(len(place), np.int32)
    for i, m in enumerate(MOVES):
        bits |= flat[place + sum(d * w for d, w in zip(m, wide, strict=True))].astype(np.int32) << i
    goes = bits & (bits - 1) != 0
    goes[goes] = simple_points(bits[goes])
    return goes


def _removable(mask: np.ndarray) -> int:
    """How many cells some sub-step would take from the mask as it is; those at the array's border aren't looked at."""
    inner = (slice(1, -1),) * 3
    hidden = np.logical_and.reduce([mask[tuple(slice(1 + d, n - 1 + d) for d, n in zip(m, mask.shape, strict=True))] for m in _FACES])
    at = np.nonzero(mask[inner] & ~hidden)
    return int(_goes(mask, np.ravel_multi_index([i + 1 for i in at], mask.shape)).sum())


def skeleton(mask: DataFrame, edge: int = EDGE, rim: int = 8) -> DataFrame:
    """(scan, z, y, x, d): the voxels that are left when simple ones are taken from all sides in turn: the topology and the ends of thin parts stay. d is the distance to
    the nearest place outside of the mask, infinite where the brick and its rim don't tell.

    A round does ``rim`` sub-steps: what happens outside of the rim can't reach the brick in so many. It ends when no sub-step would take anything.
    """
    own = mask.select("scan", *AXES, F.lit(1.0).alias("f"), F.lit(1.0).alias("v"))
    #: Each brick knows its place by the cells' coordinates, which only matter modulo 2.
    if edge % 2 or SUB_STEPS % rim:
        raise ValueError("bricks have an even edge, and rims divide the number of sub-steps")

    def solve(_: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
        m = np.pad(value > 0, 1)
        for step in range(k * rim, (k + 1) * rim):
            m = thinning_step(m, step % SUB_STEPS, (-rim - 1,) * 3)
        return m[1:-1, 1:-1, 1:-1].astype(np.uint8)

    def thickness(fixed: np.ndarray) -> np.ndarray:
        #: What isn't in the array is more than a rim away.
        d = edt(fixed > 0)
        return np.where(d <= rim + 1, d, np.inf)

    scratch = Scratch(mask.sparkSession, "skeleton")
    done = settled(scratch, laid_out(own, "f", "v", (0, 0), edge, rim, np.uint8), solve, edge, rim, lambda v: _removable(v > 0), kind=np.uint8)
    return cells(done, "d", edge, rim, lambda f, v: v > 0, np.uint8, thickness)


def thinned(mask: np.ndarray) -> np.ndarray:
    """``skeleton`` of one array."""
    m, k, still = np.pad(mask.astype(bool), 2), 0, 0
    while still < SUB_STEPS:
        new = thinning_step(m, k % SUB_STEPS, (-2, -2, -2))
        still = 0 if (new != m).any() else still + 1
        m, k = new, k + 1
    return m[2:-2, 2:-2, 2:-2]
