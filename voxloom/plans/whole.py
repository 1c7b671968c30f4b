"""Queries between and inside bodies over the whole grid: zones of all touching pairs, cubes placed by each scan's extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import grid, synthetic
from voxloom.plans.grids import _OFF6, _beside, r6
from voxloom.plans.registry import query
from voxloom.plans.standins import GRAINS, VOXELS, grains, voxels

_GROWN = "ball AS (SELECT p AS dz, q AS dy, r AS dx FROM range(-5, 6) a(p), range(-5, 6) b(q), range(-5, 6) c(r) WHERE abs(p) + abs(q) + abs(r) <= 5), grown AS (SELECT DISTINCT scan, z + dz AS z, y + dy AS y, x + dx AS x, label FROM voxels, ball WHERE label > 0)"


@query(f"WITH {VOXELS}, {_OFF6}, {_GROWN}, f AS (SELECT a.scan, a.z AS az, a.y AS ay, a.x AS ax, b.z AS bz, b.y AS by_, b.x AS bx, a.label AS la, b.label AS lb FROM {_beside('voxels', 'off', 'voxels')} WHERE a.label > 0 AND b.label > 0 AND a.label <> b.label), t AS (SELECT scan, least(la, lb) AS lo, greatest(la, lb) AS hi, count(DISTINCT CASE WHEN la < lb THEN (az, ay, ax) ELSE (bz, by_, bx) END) AS contact FROM f GROUP BY 1, 2, 3), g AS (SELECT v.scan, a.label AS lo, b.label AS hi, count(*) AS zone, count(*) FILTER (WHERE v.phase = 1) AS air, count(*) FILTER (WHERE v.phase = 2) AS ice FROM voxels v JOIN grown a USING (scan, z, y, x) JOIN grown b USING (scan, z, y, x) WHERE a.label < b.label AND v.label <> a.label AND v.label <> b.label GROUP BY 1, 2, 3) SELECT scan, lo, hi, coalesce(zone, 0) AS zone, coalesce(air, 0) AS air, coalesce(ice, 0) AS ice, contact FROM t LEFT JOIN g USING (scan, lo, hi)")
def contact_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zones between all touching bodies, grown by five voxels."""
    vox = voxels(spark, d)[0]
    return grid.contact_zones(vox, "label", grid.contact_pairs(vox, "label", F.lit(True), 1), F.col("phase") == 1, F.col("phase") == 2)


_PLACED = "per AS (SELECT scan, z, count(*) AS n, avg(y) AS y, avg(x) AS x, any_value(edge) AS edge FROM voxels GROUP BY 1, 2), ends AS (SELECT scan, min(z) AS low, max(z) - min(z) + 1 AS nz FROM per JOIN (SELECT scan, max(n) AS most FROM per GROUP BY 1) USING (scan) WHERE n > 0.25 * most GROUP BY 1), mid AS (SELECT p.scan, low, nz, edge, least(16, nz - 2) // 2 AS h, floor(p.y)::INTEGER AS cy, floor(p.x)::INTEGER AS cx FROM ends e JOIN per p ON p.scan = e.scan AND p.z = low + nz // 2), spot AS (SELECT *, floor(CASE WHEN k = 2 THEN nz * 0.72::DOUBLE ELSE nz * 0.28::DOUBLE + k * ((nz * 0.72::DOUBLE - nz * 0.28::DOUBLE) / 2) END)::INTEGER AS cz FROM mid, range(3) t(k)), held AS (SELECT *, cz + low AS mz, h > 0 AND cz >= h AND cz + h <= nz AND cy >= h AND cy + h <= edge AND cx >= h AND cx + h <= edge AS held FROM spot)"


@query(f"WITH {VOXELS}, {_PLACED} SELECT a.scan, k::INTEGER AS k, mz AS z, 2 * h AS edge, count(v.scan) AS n, round(avg((phase = 2)::INT), 6) AS phi, any_value(held) AND count(v.scan) > 0.98 * any_value(8 * h * h * h) AS accepted FROM held a LEFT JOIN voxels v ON a.scan = v.scan AND v.z >= mz - h AND v.z < mz + h AND v.y >= cy - h AND v.y < cy + h AND v.x >= cx - h AND v.x < cx + h GROUP BY 1, 2, 3, 4")
def whole_cubes(spark: SparkSession, d: str) -> DataFrame:
    """Cubes at three heights of each scan, placed by its extents, their share of ice, and whether they are accepted."""
    vox, edge = voxels(spark, d)
    return grid.cubes(vox, F.col("phase") == 2, (edge, edge), 16).withColumn("phi", r6(F.col("phi")))


_BODIES = "bodies AS (SELECT scan, id + 1 AS id, (z + 4) * 6 AS cz, (y + 4) * 6 AS cy, (x + 4) * 6 AS cx, r * 30 AS rz, r * 24 AS ry, r * 20 AS rx, uz * 90 AS turn, uy * 90 AS tilt FROM grains)"
_INSIDE = "cells AS (SELECT *, z - cz AS oz, (y - cy) * cos(turn) - (x - cx) * sin(turn) AS oy, (y - cy) * sin(turn) + (x - cx) * cos(turn) AS ox FROM bodies, range(48) a(z), range(48) b(y), range(48) c(x) WHERE abs(z - cz) <= greatest(rz, ry, rx) * sqrt(3) AND abs(y - cy) <= greatest(rz, ry, rx) * sqrt(3) AND abs(x - cx) <= greatest(rz, ry, rx) * sqrt(3)), drawn AS MATERIALIZED (SELECT scan, z, y, x, min(id) AS label FROM cells WHERE pow(abs(oz * cos(tilt) - oy * sin(tilt)) / rz, 2.5) + pow(abs(oz * sin(tilt) + oy * cos(tilt)) / ry, 2.5) + pow(abs(ox) / rx, 2.5) <= 1 GROUP BY 1, 2, 3, 4)"
_FILL = "run AS (SELECT scan, label, sum(n) OVER (PARTITION BY scan ORDER BY label) AS filled FROM (SELECT scan, label, count(*) AS n FROM drawn GROUP BY 1, 2)), last AS (SELECT scan, min(label) AS last FROM run WHERE filled >= 0.04 * 48 * 48 * 48 GROUP BY 1)"


@query(f"WITH {GRAINS}, {_BODIES}, {_INSIDE}, {_FILL} SELECT scan, label, count(*) AS n, sum(z)::BIGINT AS sz, sum(y)::BIGINT AS sy, sum(x)::BIGINT AS sx FROM drawn LEFT JOIN last USING (scan) WHERE last IS NULL OR label <= last GROUP BY 1, 2")
def synthetic_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Turned superellipsoids at the points of two scans, drawn until a share of the grid is filled."""
    own = grains(spark, d)
    bodies = own.select("scan", (F.col("id") + 1).alias("id"), *[((F.col(a) + 4) * 6).alias(f"c{a}") for a in "zyx"], *[(F.col("r") * k).alias(f"r{a}") for a, k in zip("zyx", (30, 24, 20), strict=True)], (F.col("uz") * 90).alias("turn"), (F.col("uy") * 90).alias("tilt"))
    got = synthetic.filled_to(bodies, (48, 48, 48), 0.04)
    return got.groupBy("scan", "label").agg(F.count("*").alias("n"), *[F.sum(a).cast("long").alias(f"s{a}") for a in "zyx"])
