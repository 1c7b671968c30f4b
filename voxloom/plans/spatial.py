"""Queries with spatial joins, graphs and fields over points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import classify as c
from voxloom.functions import geometry as g
from voxloom.operators import dense, field, graph, inference, spatial, stats
from voxloom.operators.components import components
from voxloom.operators.neighbours import knn_join
from voxloom.plans.objects import _EIG
from voxloom.plans.registry import query
from voxloom.plans.standins import EDGES, GRAINS, edges, grains, table
from voxloom.scratch import Scratch

r6 = lambda x, n=6: F.round(x, n)
RADIUS = 0.05
_D2 = "((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))"


@query(f"WITH {GRAINS} SELECT a.id AS a, b.id AS b, round(sqrt({_D2}), 6) AS d FROM grains a JOIN grains b ON a.id < b.id AND {_D2} <= 0.05::DOUBLE * 0.05::DOUBLE")
def radius_pairs(spark: SparkSession, d: str) -> DataFrame:
    return spatial.radius_pairs(grains(spark, d), RADIUS).select("a", "b", r6(F.col("d")).alias("d"))


@query(f"WITH {GRAINS} SELECT a.id, count(b.id) AS n FROM grains a LEFT JOIN grains b ON a.id <> b.id AND {_D2} <= 0.08::DOUBLE * 0.08::DOUBLE GROUP BY 1")
def neighbour_count(spark: SparkSession, d: str) -> DataFrame:
    return spatial.neighbour_count(grains(spark, d), 0.08)


_NEAR = f"near AS (SELECT a.id AS a, b.id AS b, sqrt({_D2}) AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS rank FROM grains a JOIN grains b ON a.scan = 0 AND b.scan = 1 AND {_D2} < 0.1::DOUBLE * 0.1::DOUBLE)"
_BACK = f"back AS (SELECT a.id AS a, b.id AS b, sqrt({_D2}) AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS rank FROM grains a JOIN grains b ON a.scan = 1 AND b.scan = 0 AND {_D2} < 0.1::DOUBLE * 0.1::DOUBLE)"


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = grains(spark, d)
    return own.where("scan = 0"), own.where("scan = 1")


@query(f"WITH {GRAINS}, {_NEAR} SELECT a, b, round(d, 6) AS d FROM near WHERE rank = 1")
def nearest_match(spark: SparkSession, d: str) -> DataFrame:
    a, b = _scans(spark, d)
    return spatial.nearest_match(a, b, 0.1).select("a", "b", r6(F.col("d")).alias("d"))


@query(f"WITH {GRAINS}, {_NEAR} SELECT a, b, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY d, a) AS k FROM near WHERE rank = 1) WHERE k = 1")
def best_per_target(spark: SparkSession, d: str) -> DataFrame:
    a, b = _scans(spark, d)
    return spatial.best_per_target(a, b, 0.1).select("a", "b", r6(F.col("d")).alias("d"))


@query(f"WITH {GRAINS}, {_NEAR}, {_BACK} SELECT n.a, n.b, round(n.d, 6) AS d FROM near n JOIN back k ON n.rank = 1 AND k.rank = 1 AND k.a = n.b AND k.b = n.a")
def reciprocal_match(spark: SparkSession, d: str) -> DataFrame:
    a, b = _scans(spark, d)
    return spatial.reciprocal_match(spatial.nearest_match(a, b, 0.1), spatial.nearest_match(b, a, 0.1)).select("a", "b", r6(F.col("d")).alias("d"))


@query(f"WITH {GRAINS}, {_NEAR}, {_BACK}, s(shift) AS (VALUES (0.0::DOUBLE), (0.05::DOUBLE)), g2 AS (SELECT id, z + shift AS z, y, x, scan, shift FROM grains, s WHERE scan = 0), f AS (SELECT a.shift, a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.shift, a.id ORDER BY {_D2}, b.id) AS rank FROM g2 a JOIN grains b ON b.scan = 1 AND {_D2} < 0.1::DOUBLE * 0.1::DOUBLE) SELECT f.shift, count(*) AS n, count(k.a) AS reciprocal FROM f LEFT JOIN back k ON k.rank = 1 AND k.a = f.b AND k.b = f.a WHERE f.rank = 1 GROUP BY 1")
def reciprocity_null(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal matches of a seed, and of the same seed shifted."""
    a, b = _scans(spark, d)
    back = spatial.nearest_match(b, a, 0.1).select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit(1).alias("hit"))
    seeds = a.withColumn("shift", F.explode(F.array(F.lit(0.0), F.lit(0.05)))).withColumn("z", F.col("z") + F.col("shift"))
    targets = b.withColumn("shift", F.explode(F.array(F.lit(0.0), F.lit(0.05))))
    forth = spatial.nearest_match(seeds, targets, 0.1, keys=["shift"])
    return forth.join(back, ["a", "b"], "left").groupBy("shift").agg(F.count("*").alias("n"), F.count("hit").alias("reciprocal"))


_GREEDY = f"""WITH RECURSIVE {GRAINS}, {_NEAR}, e AS (SELECT a, b, d, row_number() OVER (ORDER BY d, a, b) AS k FROM near WHERE rank <= 6),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS ua, []::BIGINT[] AS ub UNION ALL
  SELECT e.k, CASE WHEN list_contains(ua, e.a) OR list_contains(ub, e.b) THEN ua ELSE list_append(ua, e.a) END, CASE WHEN list_contains(ua, e.a) OR list_contains(ub, e.b) THEN ub ELSE list_append(ub, e.b) END FROM walk JOIN e ON e.k = walk.k + 1),
won AS (SELECT unnest(ua) AS a, unnest(ub) AS b FROM (SELECT ua, ub FROM walk ORDER BY k DESC LIMIT 1)) SELECT won.a, won.b, round(e.d, 6) AS d FROM won JOIN e USING (a, b)"""


@query(_GREEDY)
def injective_match(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one match among the six nearest, the globally shortest first."""
    a, b = _scans(spark, d)
    return spatial.injective_match(spatial.candidate_edges(a, b, 0.0999999999, 6)).select("a", "b", r6(F.col("d")).alias("d"))


_STEPS = range(9)
_CHAIN = ", ".join(f"m{k} AS (SELECT a, b FROM (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS r FROM grains a JOIN grains b ON a.label = {k} AND b.label = {k + 1} AND {_D2} < 0.3::DOUBLE * 0.3::DOUBLE) WHERE r = 1)" for k in _STEPS)
_LINKS = " ".join(f"JOIN m{k} ON m{k - 1}.b = m{k}.a" for k in _STEPS[1:]) + " " + " ".join(f"JOIN grains p{k} ON p{k}.id = m{k}.a" for k in _STEPS)
_SUMS = ", ".join(f"round({' + '.join(f'p{k}.u{a}' for k in _STEPS)}, 6) AS u{a}" for a in "zyx")


@query(f"WITH {GRAINS}, {_CHAIN} SELECT m0.a AS id, {_SUMS} FROM m0 {_LINKS}")
def chain_displacement(spark: SparkSession, d: str) -> DataFrame:
    """Displacements composed over all nine transitions; whoever loses its match is gone."""
    own = grains(spark, d)
    at = [own.where(f"label = {k}") for k in range(10)]
    #: All transitions at once: each is a key.
    source, target = (own.where(f"label between {k} and {k + 8}").withColumn("step", F.col("label") - k) for k in (0, 1))
    found = Scratch(spark, "chain").put(spatial.nearest_match(source, target, 0.3, keys=["step"]), "matches")
    matches = [found.where(f"step = {k}").select("a", "b") for k in _STEPS]
    return spatial.chain(matches, [a.select("id", "uz", "uy", "ux") for a in at[:9]]).select("id", *[r6(F.col(f"u{a}")).alias(f"u{a}") for a in "zyx"])


_KNN = f"knn AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, sqrt({_D2}) AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS rank FROM grains a JOIN grains b ON a.id <> b.id) WHERE rank <= 12)"


def _neighbours(spark: SparkSession, d: str, k: int) -> DataFrame:
    own = grains(spark, d)
    return knn_join(own, own, k, skip_self=True)


@query(f"WITH {GRAINS}, {_KNN} SELECT a, b, rank, round(d, 6) AS d FROM knn WHERE rank <= 5")
def knn_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d, 5).select("a", "b", "rank", r6(F.col("d")).alias("d"))


@query(f"WITH {GRAINS}, {_KNN} SELECT label, round(quantile_cont(d, 0.5) / 2, 6) AS radius FROM knn JOIN grains ON id = a WHERE rank = 1 GROUP BY 1")
def spacing_radius(spark: SparkSession, d: str) -> DataFrame:
    """Half the median distance to the nearest neighbour."""
    near = _neighbours(spark, d, 1).select(F.col("a").alias("id"), "d")
    return near.join(grains(spark, d), "id").groupBy("label").agg(r6(F.percentile("d", F.lit(0.5)) / 2).alias("radius"))


_LOCAL = "rel AS (SELECT k.a AS id, q.z - p.z AS z, q.y - p.y AS y, q.x - p.x AS x, q.uz - p.uz AS uz, q.uy - p.uy AS uy, q.ux - p.ux AS ux FROM knn k JOIN grains p ON p.id = k.a JOIN grains q ON q.id = k.b), n AS (SELECT id, count(*) AS n, covar_pop(z, z) AS zz, covar_pop(z, y) AS zy, covar_pop(z, x) AS zx, covar_pop(y, y) AS yy, covar_pop(y, x) AS yx, covar_pop(x, x) AS xx, covar_pop(uz, z) AS az, covar_pop(uz, y) AS ay, covar_pop(uz, x) AS ax, covar_pop(uy, z) AS bz, covar_pop(uy, y) AS by_, covar_pop(uy, x) AS bx, covar_pop(ux, z) AS cz, covar_pop(ux, y) AS cy, covar_pop(ux, x) AS cx FROM rel GROUP BY 1), det AS (SELECT *, zz * (yy * xx - yx * yx) - zy * (zy * xx - yx * zx) + zx * (zy * yx - yy * zx) AS dd FROM n)"


def _solve(p: str) -> list[str]:
    z, y, x = f"{p}z", f"{p}y" if p != "b" else "by_", f"{p}x"
    return [f"(({z}) * (yy * xx - yx * yx) - zy * (({y}) * xx - yx * ({x})) + zx * (({y}) * yx - yy * ({x}))) / dd", f"(zz * (({y}) * xx - yx * ({x})) - ({z}) * (zy * xx - yx * zx) + zx * (zy * ({x}) - ({y}) * zx)) / dd", f"(zz * (yy * ({x}) - ({y}) * yx) - zy * (zy * ({x}) - ({y}) * zx) + ({z}) * (zy * yx - yy * zx)) / dd"]


_H = ", ".join(f"{e} AS h{k}" for k, e in enumerate(_solve("a") + _solve("b") + _solve("c")))
_E = "h AS (SELECT id, n, " + _H + " FROM det), e AS (SELECT id, n, h0 + (h0 * h0 + h3 * h3 + h6 * h6) / 2 AS ezz, h4 + (h1 * h1 + h4 * h4 + h7 * h7) / 2 AS eyy, h8 + (h2 * h2 + h5 * h5 + h8 * h8) / 2 AS exx, (h1 + h3 + h0 * h1 + h3 * h4 + h6 * h7) / 2 AS ezy, (h2 + h6 + h0 * h2 + h3 * h5 + h6 * h8) / 2 AS ezx, (h5 + h7 + h1 * h2 + h4 * h5 + h7 * h8) / 2 AS eyx FROM h)"


def local_strain(spark: SparkSession, d: str) -> DataFrame:
    own = grains(spark, d)
    return field.gradient(own, _neighbours(spark, d, 12))


@query(f"WITH {GRAINS}, {_KNN}, {_LOCAL}, {_E} SELECT id, n, round(ezz, 5) AS ezz, round(ezz + eyy + exx, 5) AS vol, round(sqrt(2.0 / 3.0) * sqrt((ezz - (ezz + eyy + exx) / 3) * (ezz - (ezz + eyy + exx) / 3) + (eyy - (ezz + eyy + exx) / 3) * (eyy - (ezz + eyy + exx) / 3) + (exx - (ezz + eyy + exx) / 3) * (exx - (ezz + eyy + exx) / 3) + 2 * (ezy * ezy + ezx * ezx + eyx * eyx)), 5) AS eq FROM e")
def knn_gradient_strain(spark: SparkSession, d: str) -> DataFrame:
    """Green-Lagrange strain from twelve neighbours, by normal equations with an intercept."""
    h = local_strain(spark, d)
    e = g.green_lagrange([F.col(f"h{k}") for k in range(9)])
    return h.select("id", "n", F.round(e[0], 5).alias("ezz"), F.round(g.volumetric(e), 5).alias("vol"), F.round(g.equivalent_strain(e), 5).alias("eq"))


def _polar() -> str:
    """Recursive SQL: (id, k, r0 .. r8), the iteration R <- (R + R^-T) / 2 from I + H, whose limit is the polar decomposition's rotation."""
    cof = [f"(r{(i + 1) % 3 * 3 + (j + 1) % 3} * r{(i + 2) % 3 * 3 + (j + 2) % 3} - r{(i + 1) % 3 * 3 + (j + 2) % 3} * r{(i + 2) % 3 * 3 + (j + 1) % 3})" for i in range(3) for j in range(3)]
    det = " + ".join(f"r{j} * {cof[j]}" for j in range(3))
    first = ", ".join(f"h{k} + {int(k % 4 == 0)} AS r{k}" for k in range(9))
    step = ", ".join(f"(r{k} + {cof[k]} / dr) / 2 AS r{k}" for k in range(9))
    return f"polar AS (SELECT id, 0 AS k, {first} FROM h UNION ALL SELECT id, k + 1, {step} FROM (SELECT *, {det} AS dr FROM polar WHERE k < 16)), stretch AS (SELECT id, {det} AS dr FROM polar WHERE k = 0)"


@query(f"WITH RECURSIVE {GRAINS}, {_KNN}, {_LOCAL}, {_E}, {_polar()} SELECT id, round(degrees(acos(least(greatest((r0 + r4 + r8 - 1) / 2, -1), 1))), 4) AS angle, round(dr - 1, 5) AS vol FROM polar JOIN stretch USING (id) WHERE k = 16")
def rotation_angles(spark: SparkSession, d: str) -> DataFrame:
    """Rotation of the polar decomposition and volume change, in Arrow batches."""
    return field.rotations(local_strain(spark, d)).select("id", F.round("angle", 4).alias("angle"), F.round("vol", 5).alias("vol"))


@query()
def tetra_strain(spark: SparkSession, d: str) -> DataFrame:
    """Volume-weighted strain over the Delaunay tetrahedra of each label's points."""
    t = field.tetra_gradients(grains(spark, d), "label")
    e = g.green_lagrange([F.col(f"h{k}") for k in range(9)])
    own = t.select("label", "volume", g.volumetric(e).alias("vol"), g.equivalent_strain(e).alias("eq"))
    mean = lambda n: F.round(F.sum(F.col(n) * F.col("volume")) / F.sum("volume"), 5).alias(n)
    return own.groupBy("label").agg(F.count("*").alias("n"), mean("vol"), mean("eq"))


_RIGID = "m AS (SELECT avg(z) AS mz, avg(y) AS my, avg(x) AS mx, avg(uz) AS muz, avg(uy) AS muy, avg(ux) AS mux FROM grains), r AS (SELECT id, z - mz AS z, y - my AS y, x - mx AS x, uz - muz AS uz, uy - muy AS uy, ux - mux AS ux FROM grains, m), s AS (SELECT sum(y * y + x * x) AS a0, sum(-z * y) AS a1, sum(-z * x) AS a2, sum(z * z + x * x) AS a4, sum(-y * x) AS a5, sum(z * z + y * y) AS a8, sum(y * ux - x * uy) AS b0, sum(x * uz - z * ux) AS b1, sum(z * uy - y * uz) AS b2 FROM r), t AS (SELECT *, a0 * (a4 * a8 - a5 * a5) - a1 * (a1 * a8 - a5 * a2) + a2 * (a1 * a5 - a4 * a2) AS dd FROM s), w AS (SELECT (b0 * (a4 * a8 - a5 * a5) - a1 * (b1 * a8 - a5 * b2) + a2 * (b1 * a5 - a4 * b2)) / dd AS w0, (a0 * (b1 * a8 - a5 * b2) - b0 * (a1 * a8 - a5 * a2) + a2 * (a1 * b2 - b1 * a2)) / dd AS w1, (a0 * (a4 * b2 - b1 * a5) - a1 * (a1 * b2 - b1 * a2) + b0 * (a1 * a5 - a4 * a2)) / dd AS w2 FROM t)"


@query(f"WITH {GRAINS}, {_RIGID} SELECT id, round(uz - (w1 * x - w2 * y), 6) AS uz, round(uy - (w2 * z - w0 * x), 6) AS uy, round(ux - (w0 * y - w1 * z), 6) AS ux FROM r, w")
def rigid_removed(spark: SparkSession, d: str) -> DataFrame:
    return field.rigid_removed(grains(spark, d)).select("id", *[r6(F.col(f"u{a}")).alias(f"u{a}") for a in "zyx"])


@query(f"WITH {GRAINS}, a AS (SELECT quantile_cont(z, 0.02) AS z0, quantile_cont(z, 0.98) AS z1, sqrt(var_pop(y) + var_pop(x)) AS r FROM grains WHERE scan = 0), b AS (SELECT quantile_cont(z, 0.02) AS z0, quantile_cont(z, 0.98) AS z1, sqrt(var_pop(y) + var_pop(x)) AS r FROM grains WHERE scan = 1) SELECT round((b.z1 - b.z0) / (a.z1 - a.z0), 6) AS stretch_z, round(b.z0 - (b.z1 - b.z0) / (a.z1 - a.z0) * a.z0, 6) AS shift_z, round(b.r / a.r, 6) AS stretch_r FROM a, b")
def affine_seed(spark: SparkSession, d: str) -> DataFrame:
    a, b = _scans(spark, d)
    return field.affine_seed(a, b).select(*[r6(F.col(k)).alias(k) for k in ("stretch_z", "shift_z", "stretch_r")])


def _outline(name: str, scan: int) -> str:
    """SQL: axis and outer radius per band of height."""
    return f"{name}0 AS (SELECT *, least(floor((z - z0) / ((z1 - z0) / 8)), 7)::INTEGER AS band FROM (SELECT *, min(z) OVER () AS z0, max(z) OVER () AS z1 FROM grains WHERE scan = {scan})), {name}1 AS (SELECT band, any_value(z0 + (band + 0.5::DOUBLE) * ((z1 - z0) / 8)) AS h, median(y) AS cy, median(x) AS cx, any_value(z0) AS z0, any_value(z1) AS z1 FROM {name}0 GROUP BY 1 HAVING count(*) >= 10), {name} AS MATERIALIZED (SELECT h, cy, cx, quantile_cont(sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)), 0.98) AS r FROM {name}0 JOIN {name}1 USING (band) GROUP BY 1, 2, 3)"


def _bent(at: str, knots: str, column: str) -> str:
    """SQL: linear between the knots beside a height, clamped."""
    one = lambda c, test, order: f"(SELECT {c} FROM {knots} k WHERE k.h {test} p.{at} ORDER BY k.h {order} LIMIT 1)"
    a, b, ha, hb = one(column, "<=", "DESC"), one(column, ">", ""), one("h", "<=", "DESC"), one("h", ">", "")
    return f"CASE WHEN {ha} IS NULL THEN {b} WHEN {hb} IS NULL THEN {a} ELSE {a} + ({b} - {a}) * (p.{at} - {ha}) / ({hb} - {ha}) END"


_ENDS = "p AS (SELECT id, z, y, x, b0 + (z - a0) * ((b1 - b0) / (a1 - a0)) AS pz FROM (SELECT * FROM grains WHERE scan = 0), (SELECT min(z) AS a0, max(z) AS a1 FROM grains WHERE scan = 0), (SELECT min(z) AS b0, max(z) AS b1 FROM grains WHERE scan = 1))"


@query(f"WITH {GRAINS}, {_outline('ka', 0)}, {_outline('kb', 1)}, {_ENDS}, w AS (SELECT *, {_bent('pz', 'kb', 'r')} / {_bent('z', 'ka', 'r')} AS f, {_bent('pz', 'kb', 'cy')} AS by_, {_bent('z', 'ka', 'cy')} AS ay, {_bent('pz', 'kb', 'cx')} AS bx, {_bent('z', 'ka', 'cx')} AS ax FROM p) SELECT id, round(pz - z, 6) AS sz, round(by_ + (y - ay) * f - y, 6) AS sy, round(bx + (x - ax) * f - x, 6) AS sx FROM w")
def outline_seed(spark: SparkSession, d: str) -> DataFrame:
    """Where the change of the outline between two scans puts each point: a start for matching."""
    a, b = _scans(spark, d)
    return field.outline_seed(a, b, 8, 10).select("id", *[r6(F.col(f"s{k}")).alias(f"s{k}") for k in "zyx"])


@query()
def followed_points(spark: SparkSession, d: str) -> DataFrame:
    """Matching with a prediction refined from accepted neighbours."""
    a, b = _scans(spark, d)
    return spatial.follow(a, b, 0.1, 8, 3, 20).select("a", "b", r6(F.col("d")).alias("d"))


def _tree(pairs: str, nodes: str) -> str:
    """Recursive SQL: (id, comp) from undirected pairs (a, b) over nodes (id)."""
    return f"ways AS (SELECT a, b FROM {pairs} UNION SELECT b, a FROM {pairs}), reach AS (SELECT id, id AS seen FROM {nodes} UNION SELECT reach.id, ways.b FROM reach JOIN ways ON ways.a = reach.seen), comp AS (SELECT id, min(seen) AS comp FROM reach GROUP BY 1)"


@query(f"WITH RECURSIVE {GRAINS}, p AS (SELECT a.id AS a, b.id AS b FROM grains a JOIN grains b ON a.id < b.id AND {_D2} <= 0.05::DOUBLE * 0.05::DOUBLE), {_tree('p', 'grains')} SELECT id, comp, count(*) OVER (PARTITION BY comp) AS size FROM comp")
def point_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of the radius graph."""
    own = grains(spark, d)
    return graph.labelled_components(own, dense.radius_links(own, RADIUS))


@query(f"WITH RECURSIVE {GRAINS}, p AS (SELECT a.id AS a, b.id AS b FROM grains a JOIN grains b ON {_D2} <= 0.06::DOUBLE * 0.06::DOUBLE), core AS (SELECT a AS id FROM p GROUP BY 1 HAVING count(*) >= 4), i AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), {_tree('i', 'core')}, r AS (SELECT p.b AS id, min(comp) AS c FROM p JOIN comp ON comp.id = p.a GROUP BY 1) SELECT grains.id, comp.comp IS NOT NULL AS core, coalesce(comp.comp, r.c, -1) AS cluster FROM grains LEFT JOIN comp ON comp.id = grains.id LEFT JOIN r ON r.id = grains.id")
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    """DBSCAN: core points, clusters by the smallest core id, border points with the lowest cluster in reach."""
    return graph.dbscan(grains(spark, d), 0.06, 4)


@query(f"WITH RECURSIVE {GRAINS}, k AS (SELECT a.id, count(b.id) AS n FROM grains a LEFT JOIN grains b ON a.id <> b.id AND {_D2} <= 0.08::DOUBLE * 0.08::DOUBLE GROUP BY 1), low AS (SELECT grains.id, z, y, x, n FROM grains JOIN k USING (id) WHERE n <= (SELECT quantile_cont(n, 0.2) FROM k)), p AS (SELECT a.id AS a, b.id AS b FROM low a JOIN low b ON a.id < b.id AND {_D2} <= 0.15::DOUBLE * 0.15::DOUBLE), {_tree('p', 'low')} SELECT low.id, n, CASE WHEN count(*) OVER (PARTITION BY comp) >= 3 THEN comp ELSE -1 END AS comp FROM low JOIN comp USING (id)")
def vacancy_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Points with few neighbours, linked; small groups are dropped to -1."""
    return graph.vacancies(grains(spark, d), 0.08, 0.2, 0.15, 3)


@query(f"WITH {EDGES}, n AS (SELECT DISTINCT unnest([a, b]) AS id FROM edges), e AS (SELECT scan, unnest([a, b]) AS id FROM edges) SELECT n.id, count(e.id) FILTER (scan = 0) AS degree, count(e.id) FILTER (scan = 1) AS degree_after FROM n LEFT JOIN e USING (id) GROUP BY 1")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    own = edges(spark, d)
    nodes = own.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    after = graph.degree(nodes, own.where("scan = 1")).withColumnRenamed("degree", "degree_after")
    return graph.degree(nodes, own.where("scan = 0")).join(after, "id")


_MAP = "map AS (SELECT a AS n, CASE WHEN a % 7 = 0 THEN NULL WHEN a % 11 = 0 THEN a + 1 ELSE a END AS image FROM (SELECT DISTINCT unnest([a, b]) AS a FROM edges))"


@query(f"WITH {EDGES}, {_MAP}, o AS (SELECT e.a, e.b, e.thick, ma.image AS ia, mb.image AS ib, least(ma.image, mb.image) AS lo, greatest(ma.image, mb.image) AS hi FROM edges e LEFT JOIN map ma ON ma.n = e.a LEFT JOIN map mb ON mb.n = e.b WHERE scan = 0), w AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, thick FROM edges WHERE scan = 1), j AS (SELECT o.*, w.thick AS t2 FROM o LEFT JOIN w ON o.ia IS NOT NULL AND o.ib IS NOT NULL AND o.ia <> o.ib AND w.lo = o.lo AND w.hi = o.hi), s AS (SELECT CASE WHEN ia IS NULL OR ib IS NULL OR ia = ib OR t2 IS NULL THEN 'broken' WHEN t2 / thick < 0.5 THEN 'weakened' ELSE 'kept' END AS status FROM j UNION ALL SELECT 'new' FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.ia IS NOT NULL AND o.ib IS NOT NULL AND o.ia <> o.ib AND o.lo = w.lo AND o.hi = w.hi)) SELECT status, count(*) AS n FROM s GROUP BY 1")
def network_diff(spark: SparkSession, d: str) -> DataFrame:
    """Edges kept, weakened, broken and new between two scans, through a map of nodes."""
    own = edges(spark, d)
    nodes = own.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    mapping = nodes.withColumn("b", F.when(F.col("a") % 7 == 0, None).when(F.col("a") % 11 == 0, F.col("a") + 1).otherwise(F.col("a")))
    got = graph.network_diff(own.where("scan = 0"), own.where("scan = 1"), mapping)
    status = F.when(F.col("side") == "new", "new").otherwise(c.edge_status(F.col("na"), F.col("nb"), F.col("thick_before"), F.col("thick_after")))
    return got.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {GRAINS}, c AS (SELECT label AS comp, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx FROM grains GROUP BY 1), t AS (SELECT label AS comp, z, y, x, (z - cz) * 0.6::DOUBLE + (y - cy) * 0.8::DOUBLE AS t FROM grains JOIN c ON label = comp), e AS (SELECT comp, min(t) AS t0, max(t) AS t1 FROM t GROUP BY 1), f AS (SELECT t.*, (t - t0) / ((t1 - t0) / 8) AS f FROM t JOIN e USING (comp)), b AS (SELECT comp, z, y, x, unnest(CASE WHEN f = floor(f) AND f > 0 AND f < 8 THEN [least(floor(f), 7) - 1, least(floor(f), 7)] ELSE [least(floor(f), 7)] END)::INTEGER AS bin FROM f) SELECT comp, bin, count(*) AS n, round(avg(z), 6) AS z, round(avg(y), 6) AS y, round(avg(x), 6) AS x FROM b GROUP BY 1, 2")
def crack_spine(spark: SparkSession, d: str) -> DataFrame:
    """Points of a cluster averaged in bins along a given axis."""
    own = grains(spark, d)
    mid = own.groupBy(F.col("label").alias("comp")).agg(*[F.avg(a).alias(f"c{a}") for a in "zyx"]).select("*", F.lit(0.6).alias("az"), F.lit(0.8).alias("ay"), F.lit(0.0).alias("ax"))
    got = graph.spine(own.select(F.col("label").alias("comp"), "z", "y", "x"), mid, 8)
    return got.select("comp", F.col("bin").cast("int").alias("bin"), "n", *[r6(F.col(a)).alias(a) for a in "zyx"])


_NAMES = (("szz", "szy", "szx"), ("szy", "syy", "syx"), ("szx", "syx", "sxx"))


def _axis_column(j: int) -> str:
    """SQL: a column of (S - l2 I)(S - l3 I), which points along the largest principal direction."""
    entry = lambda i, k, x: f"({_NAMES[i][k]} - {x})" if i == k else _NAMES[i][k]
    return "{" + ", ".join(f"'{a}': " + " + ".join(f"{entry(i, k, 'l2')} * {entry(k, j, 'l3')}" for k in range(3)) for i, a in enumerate("zyx")) + "}"


_AXIS = f"c AS (SELECT label AS comp, count(*) AS n, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx, covar_pop(z, z) AS szz, covar_pop(z, y) AS szy, covar_pop(z, x) AS szx, covar_pop(y, y) AS syy, covar_pop(y, x) AS syx, covar_pop(x, x) AS sxx FROM grains GROUP BY 1), {_EIG}, e6 AS (SELECT *, 3.0 * q - l1 - l3 AS l2 FROM e5), u AS (SELECT comp, n, cz, cy, cx, unnest([{', '.join(_axis_column(j) for j in range(3))}]) AS v FROM e6), ax AS (SELECT comp, any_value(n) AS n, any_value(cz) AS cz, any_value(cy) AS cy, any_value(cx) AS cx, max({{'m': v.z * v.z + v.y * v.y + v.x * v.x, 'z': v.z, 'y': v.y, 'x': v.x}}) AS v FROM u GROUP BY 1), axes AS (SELECT *, CASE WHEN CASE WHEN abs(v.z) > 1e-12 * sqrt(v.m) THEN v.z WHEN abs(v.y) > 1e-12 * sqrt(v.m) THEN v.y ELSE v.x END < 0 THEN -1.0 ELSE 1.0 END / sqrt(v.m) AS s, least(16, greatest(2, n // 4))::INTEGER AS bins FROM ax WHERE n >= 5)"
_ALONG = "t AS (SELECT comp, n, bins, z, y, x, (z - cz) * (v.z * s) + (y - cy) * (v.y * s) + (x - cx) * (v.x * s) AS t FROM grains JOIN axes ON label = comp), span AS (SELECT comp, min(t) AS t0, max(t) AS t1 FROM t GROUP BY 1), f AS (SELECT t.*, t1 - t0 AS length, CASE WHEN t1 > t0 THEN (t - t0) / ((t1 - t0) / bins) ELSE 0 END AS f FROM t JOIN span USING (comp)), b AS (SELECT comp, n, length, z, y, x, unnest(CASE WHEN f = floor(f) AND f > 0 AND f < bins THEN [least(floor(f), bins - 1) - 1, least(floor(f), bins - 1)] ELSE [least(floor(f), bins - 1)] END)::INTEGER AS bin FROM f)"


@query(f"WITH {GRAINS}, {_AXIS}, {_ALONG} SELECT comp, n, round(length, 6) AS length, bin, count(*) AS m, round(avg(z), 6) AS z, round(avg(y), 6) AS y, round(avg(x), 6) AS x FROM b GROUP BY 1, 2, 3, 4")
def crack_paths(spark: SparkSession, d: str) -> DataFrame:
    """Spine of each cluster along its own principal axis; tests hold it against a singular value decomposition."""
    got = graph.crack_paths(grains(spark, d).select(F.col("label").alias("comp"), "z", "y", "x"))
    return got.select("comp", "n", r6(F.col("length")).alias("length"), F.col("bin").cast("int").alias("bin"), "m", *[r6(F.col(a)).alias(a) for a in "zyx"])


@query(f"WITH RECURSIVE {GRAINS}, p AS (SELECT a.id AS a, b.id AS b FROM grains a JOIN grains b ON a.id < b.id AND {_D2} <= 0.06::DOUBLE * 0.06::DOUBLE), {_tree('p', 'grains')}, blobs AS (SELECT comp AS id, count(*) AS size, sum(z) / count(*) AS z, sum(y) / count(*) AS y, sum(x) / count(*) AS x FROM comp JOIN grains USING (id) GROUP BY 1 HAVING count(*) >= 2) SELECT a.id AS a, b.id AS b, round(sqrt({_D2}), 5) AS d FROM blobs a JOIN blobs b ON a.id < b.id AND {_D2} <= 0.2::DOUBLE * 0.2::DOUBLE")
def blob_graph(spark: SparkSession, d: str) -> DataFrame:
    """Components of two points or more, and which of their centres lie near one another."""
    own = grains(spark, d)
    comps = graph.labelled_components(own, dense.radius_links(own, 0.06), 2).where("comp >= 0")
    blobs = own.join(comps, "id").groupBy(F.col("comp").alias("id")).agg(*[(F.sum(a) / F.count("*")).alias(a) for a in "zyx"])
    return spatial.radius_pairs(blobs, 0.2).select("a", "b", F.round("d", 5).alias("d"))


@query(f"WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT a, b FROM edges WHERE scan = 0), ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT 1::BIGINT AS id, 0 AS dist UNION SELECT ways.b, w.dist + 1 FROM w JOIN ways ON ways.a = w.id WHERE w.dist < 40) SELECT id, min(dist)::DOUBLE AS dist FROM w GROUP BY 1")
def hop_distance(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first distance from one node; each round relaxes from the front alone."""
    own = edges(spark, d).where("scan = 0").select("a", "b", F.lit(1.0).alias("w"))
    return graph.shortest_paths(own, own, spark.range(1, 2).select("id"))


@query(f"WITH {GRAINS}, p AS (SELECT a.label, sqrt({_D2}) - a.r - b.r AS sep FROM grains a JOIN grains b ON a.id < b.id AND a.label = b.label AND {_D2} <= 0.3::DOUBLE * 0.3::DOUBLE), t AS (SELECT quantile_cont(sep, 0.99) AS cut FROM p WHERE label = 0) SELECT label, count(*) AS n, count(*) FILTER (WHERE sep > cut) AS opened, round(any_value(cut), 6) AS cut FROM p, t WHERE label <> 0 GROUP BY 1")
def calibrated_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The 99th percentile of an unloaded control as threshold for the rest; one row is broadcast."""
    own = grains(spark, d)
    near = spatial.radius_join(own, own, 0.3, keys=["label"]).where("a < b")
    r = own.select("id", "r")
    sep = near.join(r.toDF("a", "ra"), "a").join(r.toDF("b", "rb"), "b").select("label", (F.col("d") - F.col("ra") - F.col("rb")).alias("sep"))
    cut = stats.exact_summary(sep.where("label = 0"), {"cut": ("sep", 0.99)})
    return sep.where("label <> 0").crossJoin(F.broadcast(cut)).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("sep") > F.col("cut")).alias("opened"), r6(F.first("cut")).alias("cut"))


_SIZES = "sizes(level, e) AS (VALUES " + ", ".join(f"({k}, {e}::DOUBLE * 2 * 0.05::DOUBLE)" for k, e in enumerate(inference.SWEEP)) + ")"
#: Draw 400 is what was observed; a node is a point in a draw at a size.
_DRAWN = "own AS (SELECT id, z, y, x, label FROM grains), broken AS (SELECT id FROM own WHERE label = 0), member AS MATERIALIZED (SELECT draw, id FROM (SELECT draw, id, row_number() OVER (PARTITION BY draw ORDER BY md5('20:' || draw || ':' || id), id) AS r FROM own, range(400) t(draw)) WHERE r <= (SELECT count(*) FROM broken) UNION ALL SELECT 400, id FROM broken)"
_NEAR = f"near AS MATERIALIZED (SELECT a.id AS a, b.id AS b, {_D2} AS d2 FROM own a JOIN own b ON a.id <> b.id AND {_D2} <= 0.2::DOUBLE * 0.2::DOUBLE), lives AS MATERIALIZED (SELECT draw, level, a, b FROM near JOIN member m ON m.id = a JOIN member n ON n.id = b AND n.draw = m.draw, sizes WHERE d2 <= e * e)".replace("SELECT draw, level", "SELECT m.draw, level")
_GROUPS = "core AS MATERIALIZED (SELECT draw, level, a AS id FROM lives GROUP BY 1, 2, 3 HAVING count(*) >= 4), ways AS MATERIALIZED (SELECT l.draw, l.level, l.a, l.b FROM lives l JOIN core c ON c.draw = l.draw AND c.level = l.level AND c.id = l.a JOIN core k ON k.draw = l.draw AND k.level = l.level AND k.id = l.b), tree(draw, level, id, top) USING KEY (draw, level, id) AS (SELECT draw, level, id, id FROM core UNION (SELECT w.draw, w.level, w.b, min(t.top) AS top FROM tree t JOIN ways w ON w.draw = t.draw AND w.level = t.level AND w.a = t.id JOIN recurring.tree k ON k.draw = w.draw AND k.level = w.level AND k.id = w.b WHERE t.top < k.top GROUP BY 1, 2, 3)), every AS (SELECT draw, level, id, top FROM tree UNION ALL SELECT l.draw, l.level, l.a, min(t.top) FROM lives l JOIN tree t ON t.draw = l.draw AND t.level = l.level AND t.id = l.b ANTI JOIN core c ON c.draw = l.draw AND c.level = l.level AND c.id = l.a GROUP BY 1, 2, 3)"
_PLANES = f"c AS (SELECT draw, level, top, count(*) AS n, covar_pop(z, z) AS szz, covar_pop(z, y) AS szy, covar_pop(z, x) AS szx, covar_pop(y, y) AS syy, covar_pop(y, x) AS syx, covar_pop(x, x) AS sxx FROM every JOIN own USING (id) GROUP BY 1, 2, 3 HAVING count(*) >= 6), {_EIG}, per AS (SELECT draw, level, count(*) AS n, max(n) AS biggest, sum(n) AS inside, min(sqrt(greatest(l3, 0))) / 0.05::DOUBLE AS rms FROM e5 GROUP BY 1, 2), got AS (SELECT draw, level, coalesce(n, 0) AS n, coalesce(biggest, 0) AS biggest, coalesce(inside, 0) AS inside, rms FROM (SELECT draw, level FROM range(401) t(draw), sizes) LEFT JOIN per USING (draw, level)), seen AS (SELECT level, n AS c0, biggest AS b0, inside AS i0, rms AS r0 FROM got WHERE draw = 400)"


@query(f"WITH RECURSIVE {GRAINS}, {_SIZES}, {_DRAWN}, {_NEAR}, {_GROUPS}, {_PLANES} SELECT round(any_value(e) / 0.1::DOUBLE, 6) AS eps_d, any_value(c0) AS clusters, round(median(n), 6) AS clusters_null, round(avg((n >= c0)::INT), 6) AS p_clusters, any_value(b0) AS biggest, round(median(biggest), 6) AS biggest_null, round(avg((biggest >= b0)::INT), 6) AS p_biggest, round(any_value(r0), 6) AS rms_r, round(median(rms), 6) AS rms_null, round(avg((rms <= r0)::INT), 6) AS p_rms, round(any_value(i0) / greatest((SELECT count(*) FROM broken), 1), 6) AS frac_in FROM got JOIN seen USING (level) JOIN sizes USING (level) WHERE draw < 400 GROUP BY level")
def clustering_null(spark: SparkSession, d: str, draws: int = inference.DRAWS) -> DataFrame:
    """Clusters of broken points against as many drawn at random, over the whole sweep of neighbourhood sizes."""
    own = Scratch(spark, "null").put(grains(spark, d), "points")
    got = inference.clustering_sweep(own, own.where("label = 0"), 0.05, inference.SWEEP, draws, 20)
    return got.select(*[r6(F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in got.dtypes])


@query(f"WITH {GRAINS}, own AS (SELECT *, floor(z * 10)::INTEGER AS band FROM grains), want AS (SELECT band, count(*) AS want FROM own WHERE label = 0 GROUP BY 1), h AS (SELECT replica, id, band, want, y, x, row_number() OVER (PARTITION BY replica, band ORDER BY md5('21:' || replica || ':' || id), id) AS r FROM own JOIN want USING (band), range(60) t(replica)) SELECT replica::INTEGER AS replica, count(*) AS n, round(stddev_pop(y) + stddev_pop(x), 6) AS spread FROM h WHERE r <= want GROUP BY 1")
def stratified_null(spark: SparkSession, d: str, replicas: int = 60) -> DataFrame:
    """Mean spread of draws that keep the number of broken points per height band."""
    own = grains(spark, d).withColumn("band", F.floor(F.col("z") * 10).cast("int"))
    want = own.where("label = 0").groupBy("band").agg(F.count("*").alias("want"))
    draws = stats.stratified(own.select("id", "band", "y", "x"), want, "band", replicas, "id", 21)
    return draws.groupBy("replica").agg(F.count("*").alias("n"), r6(F.stddev_pop("y") + F.stddev_pop("x")).alias("spread"))


@query("WITH n AS (SELECT l_suppkey % 20 AS test, l_quantity AS v FROM lineitem), o AS (SELECT test, 45.0 + test / 10.0 AS obs FROM (SELECT DISTINCT test FROM n)) SELECT test, round(avg((v >= obs)::INTEGER), 6) AS p, round((sum((v >= obs)::INTEGER) + 1) / (count(*) + 1), 6) AS p_floored FROM n JOIN o USING (test) GROUP BY 1")
def tail_p(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("test"), F.col("l_quantity").alias("v"))
    obs = 45.0 + F.col("test") / 10.0
    a = stats.tail_p(n, obs, "v", ["test"]).withColumnRenamed("p", "p0")
    b = stats.tail_p(n, obs, "v", ["test"], floored=True)
    return a.join(b, "test").select("test", r6(F.col("p0")).alias("p"), r6(F.col("p")).alias("p_floored"))


@query(f"WITH {GRAINS} SELECT id FROM grains WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def sound_points(spark: SparkSession, d: str) -> DataFrame:
    """Semi-join with a gate table."""
    gate = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return grains(spark, d).join(gate, "id", "left_semi").select("id")


def roots(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """(node, root) of the pairs alone."""
    return components(Scratch(spark, "roots"), pairs)
