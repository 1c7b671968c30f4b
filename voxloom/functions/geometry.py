"""Vectors, tensors and sizes as column arithmetic; coordinates are in the order z, y, x."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0]))


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum((p * q for p, q in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def branch_dip(dz: Column, dy: Column, dx: Column) -> Column:
    """Angle of a branch to the vertical axis in degrees, 0 to 90."""
    length = F.sqrt(dz * dz + dy * dy + dx * dx)
    return F.degrees(F.acos(F.least(F.abs(dz) / F.greatest(length, F.lit(1e-12)), F.lit(1.0))))


def azimuth(ny: Column, nx: Column) -> Column:
    """Direction in degrees modulo 180."""
    return F.pmod(F.degrees(F.atan2(ny, nx)), F.lit(180.0))


def equivalent_diameter(volume: Column) -> Column:
    return F.lit(2.0) * F.cbrt(F.lit(3.0) * volume / F.lit(4.0 * math.pi))


def box_sphericity(voxels: Column, dz: Column, dy: Column, dx: Column) -> Column:
    """Volume to that of the sphere in the bounding box's longest edge."""
    edge = F.greatest(dz, dy, dx).cast("double")
    return voxels / (F.lit(math.pi / 6.0) * edge * edge * edge)


def wadell_sphericity(volume: Column, area: Column) -> Column:
    return F.cbrt(F.lit(math.pi)) * F.pow(F.lit(6.0) * volume, F.lit(2.0 / 3.0)) / area


def eigenvalues3(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix, the largest first, in closed form."""
    q = (xx + yy + zz) / 3.0
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2.0 * off) / 6.0)
    safe = F.greatest(p, F.lit(1e-300))
    a, b, c = (xx - q) / safe, (yy - q) / safe, (zz - q) / safe
    d, e, f = xy / safe, xz / safe, yz / safe
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2.0
    angle = F.acos(F.greatest(F.least(half, F.lit(1.0)), F.lit(-1.0))) / 3.0
    first = q + 2.0 * p * F.cos(angle)
    last = q + 2.0 * p * F.cos(angle + F.lit(2.0 * math.pi / 3.0))
    return first, 3.0 * q - first - last, last


def planarity(first: Column, second: Column, last: Column, variant: str = "variance") -> Column:
    """variance: 1 - l3 / l2; singular: the same of the square roots; linear: (l2 - l1) / l3 with l ascending."""
    if variant == "variance":
        return 1 - F.try_divide(last, second)
    if variant == "singular":
        return 1 - F.try_divide(F.sqrt(F.greatest(last, F.lit(0.0))), F.sqrt(second))
    return F.try_divide(second - last, first)


def green_lagrange(g: Sequence[Column], linear: bool = False) -> list[Column]:
    """zz, yy, xx, zy, zx, yx of (H + Ht + Ht H) / 2 for a gradient H in rows; linear leaves out the product."""
    h = lambda i, j: g[3 * i + j]
    out = []
    for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)):
        e = h(i, j) + h(j, i)
        if not linear:
            e = e + h(0, i) * h(0, j) + h(1, i) * h(1, j) + h(2, i) * h(2, j)
        out.append(e / 2.0)
    return out


def volumetric(e: Sequence[Column]) -> Column:
    return e[0] + e[1] + e[2]


def equivalent_strain(e: Sequence[Column], factor: float = math.sqrt(2.0 / 3.0)) -> Column:
    """factor times the norm of the deviator; variants are sqrt(2/3) and sqrt(1.5)."""
    m = volumetric(e) / 3.0
    d = [e[0] - m, e[1] - m, e[2] - m]
    return F.lit(factor) * F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2.0 * (e[3] * e[3] + e[4] * e[4] + e[5] * e[5]))


def solve3(m: Sequence[Column], r: Sequence[Column]) -> list[Column]:
    """Cramer's rule for a 3 x 3 system in rows; NULL where it is singular."""

    def det(a: Sequence[Column]) -> Column:
        return a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])

    whole = det(m)
    out = []
    for k in range(3):
        own = list(m)
        for i in range(3):
            own[3 * i + k] = r[i]
        out.append(F.try_divide(det(own), whole))
    return out


def kozeny_carman(porosity: Column, surface: Column, c: float = 5.0) -> Column:
    """Permeability from porosity and specific surface."""
    return porosity * porosity * porosity / (F.lit(c) * surface * surface)


def kozeny_grain(porosity: Column, diameter: Column) -> Column:
    solid = 1.0 - porosity
    return F.try_divide(diameter * diameter * porosity * porosity * porosity, F.lit(180.0) * solid * solid)


def kozeny_tortuous(porosity: Column, tortuosity: Column, surface: Column, c: float = 5.0) -> Column:
    solid = 1.0 - porosity
    return F.try_divide(porosity * porosity * porosity, solid * solid * tortuosity * tortuosity * F.lit(c) * surface * surface)


def isotropic_moduli(c: Sequence[Sequence[Column]]) -> dict[str, Column]:
    """Bulk, shear and Young's modulus and Poisson's ratio of a 6 x 6 stiffness in Voigt order."""
    bulk = (c[0][0] + c[1][1] + c[2][2] + 2.0 * (c[0][1] + c[0][2] + c[1][2])) / 9.0
    shear = (c[0][0] + c[1][1] + c[2][2] - c[0][1] - c[0][2] - c[1][2] + 3.0 * (c[3][3] + c[4][4] + c[5][5])) / 15.0
    return {"bulk": bulk, "shear": shear, "young": 9.0 * bulk * shear / (3.0 * bulk + shear), "poisson": (3.0 * bulk - 2.0 * shear) / (2.0 * (3.0 * bulk + shear))}
