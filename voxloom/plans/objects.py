"""Queries over object tables: classes, gates, counts, shares, distributions, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions import classify as c
from voxloom.functions import geometry as g
from voxloom.operators import stats
from voxloom.operators.graph import kept_edges
from voxloom.operators.series import running_total
from voxloom.plans.registry import query
from voxloom.plans.standins import GRAINS, THROATS, edges, grains, table, throats

r6 = lambda x, n=6: F.round(x, n)


def sound_throats(spark: SparkSession, d: str) -> DataFrame:
    """Throats both of whose bodies pass the gate: suppliers with a balance, parts of some size."""
    parts = table(spark, d, "part").where("p_size >= 10").select(F.col("p_partkey").alias("bead_a"))
    suppliers = table(spark, d, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") + 1_000_000).alias("bead_b"))
    return throats(spark, d).join(parts, "bead_a", "left_semi").join(suppliers, "bead_b", "left_semi")


SOUND = THROATS + ", sound AS (SELECT * FROM throats WHERE bead_a IN (SELECT p_partkey FROM part WHERE p_size >= 10) AND bead_b IN (SELECT s_suppkey + 1000000 FROM supplier WHERE s_acctbal > 0))"
_SWEEP = ", ".join(f"count(*) FILTER (WHERE least(cover_a, cover_b) >= {t}::DOUBLE) AS coh_{str(t)[2:]}0, count(*) FILTER (WHERE least(cover_a, cover_b) < {t}::DOUBLE) AS adh_{str(t)[2:]}0" for t in c.SWEEP)


@query(f"WITH {SOUND} SELECT coalesce(specimen, 'all') AS specimen, count(*) AS answerable, round(quantile_cont(gap_vox, 0.5), 6) AS gap_med, round(quantile_cont(greatest(cover_a, cover_b), 0.5), 6) AS share_med, {_SWEEP} FROM sound WHERE dsum_min >= 7 AND crack_vox >= 200 GROUP BY GROUPING SETS ((specimen), ())")
def bond_failure_census(spark: SparkSession, d: str) -> DataFrame:
    """Failure modes of answerable throats at every threshold, per specimen and in all."""
    own = sound_throats(spark, d).where(c.answerable(F.col("dsum_min"), F.col("crack_vox")))
    low = F.least("cover_a", "cover_b")
    marks = [f for t in c.SWEEP for f in (F.count_if(low >= t).alias(f"coh_{str(t)[2:]}0"), F.count_if(low < t).alias(f"adh_{str(t)[2:]}0"))]
    #: Each throat under its specimen and under all, so that both come from the same passes.
    own = own.select(F.explode(F.array("specimen", F.lit("all"))).alias("specimen"), "gap_vox", F.greatest("cover_a", "cover_b").alias("share"), "cover_a", "cover_b")
    counts = own.groupBy("specimen").agg(F.count("*").alias("answerable"), *marks)
    medians = stats.exact_summary(own, {"gap_med": ("gap_vox", 0.5), "share_med": ("share", 0.5)}, ["specimen"])
    return counts.join(medians, "specimen").select("specimen", "answerable", r6(F.col("gap_med")).alias("gap_med"), r6(F.col("share_med")).alias("share_med"), *[m for m in counts.columns[2:]])


_FACE = "CASE WHEN cover_a IS NULL OR cover_b IS NULL THEN 'unmeasured' WHEN least(cover_a, cover_b) >= 0.5::DOUBLE THEN 'cohesive' WHEN greatest(cover_a, cover_b) >= 0.5::DOUBLE AND least(cover_a, cover_b) < 0.2::DOUBLE THEN 'adhesive' WHEN greatest(cover_a, cover_b) < 0.2::DOUBLE THEN 'stripped' ELSE 'mixed' END"
_Q = "CASE WHEN q_crack <= 0.15::DOUBLE THEN 'adhesive' WHEN q_crack >= 0.3::DOUBLE THEN 'cohesive' ELSE 'mixed' END"


@query(f"WITH {THROATS}, k AS (SELECT specimen, {_FACE} AS face_class FROM throats), d AS (SELECT DISTINCT specimen FROM throats), v(face_class) AS (VALUES ('cohesive'), ('adhesive'), ('stripped'), ('mixed'), ('unmeasured')) SELECT d.specimen, v.face_class, count(k.specimen) AS n FROM d CROSS JOIN v LEFT JOIN k ON k.specimen = d.specimen AND k.face_class = v.face_class GROUP BY 1, 2")
def face_class_counts(spark: SparkSession, d: str) -> DataFrame:
    own = throats(spark, d).withColumn("face_class", c.face_class(F.col("cover_a"), F.col("cover_b")))
    return stats.value_counts(own, "face_class", c.FACE_CLASSES, ["specimen"])


@query(f"WITH {THROATS}, k AS (SELECT specimen, CASE WHEN crack_vox < 200 THEN 'intact' ELSE {_Q} END AS q_class FROM throats), d AS (SELECT DISTINCT specimen FROM throats), v(q_class) AS (VALUES ('intact'), ('adhesive'), ('cohesive'), ('mixed')) SELECT d.specimen, v.q_class, count(k.specimen) AS n FROM d CROSS JOIN v LEFT JOIN k ON k.specimen = d.specimen AND k.q_class = v.q_class GROUP BY 1, 2")
def q_class_counts(spark: SparkSession, d: str) -> DataFrame:
    own = throats(spark, d).withColumn("q_class", c.q_class(F.col("crack_vox"), F.col("q_crack")))
    return stats.value_counts(own, "q_class", c.Q_CLASSES, ["specimen"])


@query(f"WITH {THROATS}, k AS (SELECT specimen, l_orderkey, l_linenumber, bead_a, bead_b, crack_frac, CASE WHEN NOT connected THEN 'detached' WHEN crack_vox < 200 THEN NULL ELSE {_Q} END AS q_class FROM throats) SELECT specimen, q_class, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY specimen, q_class ORDER BY crack_frac DESC, l_orderkey, l_linenumber, bead_a, bead_b) AS rank FROM k WHERE q_class IS NOT NULL")
def rank_in_class(spark: SparkSession, d: str) -> DataFrame:
    """Single throats by class, those with the most crack first; uncracked ones have no class."""
    own = throats(spark, d).withColumn("q_class", c.q_class(F.col("crack_vox"), F.col("q_crack"), F.col("connected"))).where("q_class is not null")
    own = own.select("specimen", "q_class", "l_orderkey", "l_linenumber", (-F.col("crack_frac")).alias("order"), F.struct("l_orderkey", "l_linenumber", "bead_a", "bead_b").alias("tie"))
    return running_total(own, "order", "tie", F.lit(1), "rank", ["specimen", "q_class"]).select("specimen", "q_class", "l_orderkey", "l_linenumber", "rank")


@query(f"WITH {THROATS}, t(threshold) AS (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) SELECT specimen, threshold, CASE WHEN least(cover_a, cover_b) >= threshold THEN 'cohesive' ELSE 'adhesive' END AS mode, count(*) AS n FROM throats, t GROUP BY 1, 2, 3")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Every throat at every threshold: the grid is an array in the row, not a join."""
    own = throats(spark, d).select("specimen", "cover_a", "cover_b", F.explode(F.array(*[F.lit(t) for t in c.SWEEP])).alias("threshold"))
    return own.groupBy("specimen", "threshold", c.mode_at(F.col("cover_a"), F.col("cover_b"), F.col("threshold")).alias("mode")).agg(F.count("*").alias("n"))


@query(f"WITH {THROATS} SELECT l_orderkey, l_linenumber, CASE WHEN cover_a <= cover_b THEN bead_a ELSE bead_b END AS bare_bead, round(abs(cover_a - cover_b) / greatest(cover_a + cover_b, 1e-9), 6) AS asymmetry FROM throats WHERE {_FACE} = 'adhesive'")
def bare_beads(spark: SparkSession, d: str) -> DataFrame:
    a = [F.col(n) for n in ("cover_a", "cover_b", "bead_a", "bead_b")]
    own = throats(spark, d).withColumn("bare_bead", c.bare_bead(*a)).where(c.face_class(*a[:2]) == "adhesive")
    return own.select("l_orderkey", "l_linenumber", "bare_bead", r6(c.asymmetry(*a[:2])).alias("asymmetry"))


@query(f"WITH {THROATS}, k AS (SELECT specimen, CASE WHEN l_orderkey % 10 = 0 THEN 'lost' WHEN gap_vox > 12 THEN 'separated' WHEN connected THEN 'survived' ELSE 'detached' END AS o FROM throats WHERE scan = 1) SELECT specimen, count(*) AS followed, round(100.0 * avg((o = 'separated')::INTEGER), 6) AS separated_pct, round(100.0 * avg((o = 'detached')::INTEGER), 6) AS detached_pct, round(100.0 * avg((o = 'survived')::INTEGER), 6) AS survived_pct FROM k WHERE o <> 'lost' GROUP BY 1")
def survival_shares(spark: SparkSession, d: str) -> DataFrame:
    gap = F.when(F.col("l_orderkey") % 10 != 0, F.col("gap_vox"))
    own = throats(spark, d).where("scan = 1").withColumn("o", c.survival_outcome(gap, F.col("connected"))).where("o <> 'lost'")
    share = lambda o: r6(100.0 * F.avg((F.col("o") == o).cast("int"))).alias(f"{o}_pct")
    return own.groupBy("specimen").agg(F.count("*").alias("followed"), share("separated"), share("detached"), share("survived"))


@query(f"WITH {THROATS} SELECT specimen, count(*) AS bonds, count(*) FILTER (WHERE crack_vox > 200) AS cracked, count(*) FILTER (WHERE crack_vox > 200 AND dsum_min >= 7) AS wide_enough, count(*) FILTER (WHERE crack_vox > 200 AND dsum_min >= 7 AND bead_a IN (SELECT p_partkey FROM part WHERE p_size >= 10) AND bead_b IN (SELECT s_suppkey + 1000000 FROM supplier WHERE s_acctbal > 0)) AS both_sound FROM throats GROUP BY 1")
def failure_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Bonds, of them cracked, of them wide enough, of them between sound bodies."""
    parts = table(spark, d, "part").where("p_size >= 10").select(F.col("p_partkey").alias("bead_a"), F.lit(True).alias("sa"))
    suppliers = table(spark, d, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") + 1_000_000).alias("bead_b"), F.lit(True).alias("sb"))
    own = throats(spark, d).join(parts, "bead_a", "left").join(suppliers, "bead_b", "left")
    cracked, wide = F.col("crack_vox") > c.MIN_CRACK, F.col("dsum_min") >= c.MIN_DSUM
    sound = F.coalesce(F.col("sa") & F.col("sb"), F.lit(False))
    return own.groupBy("specimen").agg(F.count("*").alias("bonds"), F.count_if(cracked).alias("cracked"), F.count_if(cracked & wide).alias("wide_enough"), F.count_if(cracked & wide & sound).alias("both_sound"))


@query(f"WITH {THROATS} SELECT specimen, scan, count(*) AS n, round(quantile_cont(gap_vox, 0.5), 6) AS gap_med, round(quantile_cont(gap_vox, 0.9), 6) AS gap_p90, round(avg(gap_vox), 6) AS gap_mean, round(stddev_pop(gap_vox), 6) AS gap_sd, round(quantile_cont(q_crack, 0.5), 6) AS q_med FROM throats GROUP BY 1, 2")
def throat_geometry_stats(spark: SparkSession, d: str) -> DataFrame:
    own, key = throats(spark, d), ["specimen", "scan"]
    some = own.groupBy(*key).agg(F.count("*").alias("n"), r6(F.avg("gap_vox")).alias("gap_mean"), r6(F.stddev_pop("gap_vox")).alias("gap_sd"))
    ranks = stats.exact_summary(own, {"gap_med": ("gap_vox", 0.5), "gap_p90": ("gap_vox", 0.9), "q_med": ("q_crack", 0.5)}, key)
    return some.join(ranks.select(*key, *[r6(F.col(n)).alias(n) for n in ("gap_med", "gap_p90", "q_med")]), key)


@query(f"WITH {THROATS}, b AS (SELECT specimen, bead_a AS bead FROM throats WHERE connected UNION ALL SELECT specimen, bead_b FROM throats WHERE connected), g AS (SELECT specimen, count(DISTINCT bead) AS grains FROM (SELECT specimen, bead_a AS bead FROM throats UNION ALL SELECT specimen, bead_b FROM throats) GROUP BY 1) SELECT g.specimen, grains, (SELECT count(*) FROM b WHERE b.specimen = g.specimen) // 2 AS bonded, round((SELECT count(*) FROM b WHERE b.specimen = g.specimen)::DOUBLE / grains, 6) AS z_bar FROM g")
def coordination_number(spark: SparkSession, d: str) -> DataFrame:
    """Twice the bonds to the bodies, those without a bond included."""
    ends = throats(spark, d).select("specimen", "connected", F.explode(F.array("bead_a", "bead_b")).alias("bead"))
    per = ends.groupBy("specimen", "bead").agg(F.count_if("connected").alias("n"))
    return per.groupBy("specimen").agg(F.count("*").alias("grains"), (F.sum("n") / 2).cast("long").alias("bonded"), r6(F.sum("n") / F.count("*")).alias("z_bar"))


@query(f"WITH {THROATS}, e AS (SELECT specimen, bead_a AS bead, crack_vox > 200 AS cracked, NOT connected AS detached FROM throats UNION ALL SELECT specimen, bead_b, crack_vox > 200, NOT connected FROM throats) SELECT specimen, bead, count(*) AS n, round(avg(cracked::INTEGER), 6) AS cracked, round(avg(detached::INTEGER), 6) AS detached FROM e GROUP BY 1, 2 HAVING count(*) >= 3")
def per_bead_rollup(spark: SparkSession, d: str) -> DataFrame:
    ends = throats(spark, d).select("specimen", F.explode(F.array("bead_a", "bead_b")).alias("bead"), (F.col("crack_vox") > 200).cast("int").alias("k"), (~F.col("connected")).cast("int").alias("l"))
    return ends.groupBy("specimen", "bead").agg(F.count("*").alias("n"), r6(F.avg("k")).alias("cracked"), r6(F.avg("l")).alias("detached")).where("n >= 3")


_BIN = "CASE WHEN q_crack BETWEEN 0 AND 0.5 THEN least(floor((q_crack - 0.0::DOUBLE) / ((0.5::DOUBLE - 0.0::DOUBLE) / 25))::INTEGER, 24) END"
_HIST = f"h AS (SELECT d.specimen, b.bin::INTEGER AS bin, count(k.specimen) AS n FROM (SELECT DISTINCT specimen FROM throats WHERE connected) d CROSS JOIN range(25) b(bin) LEFT JOIN (SELECT specimen, {_BIN} AS bin FROM throats WHERE connected) k ON k.specimen = d.specimen AND k.bin = b.bin GROUP BY 1, 2)"


@query(f"WITH {THROATS}, {_HIST} SELECT * FROM h")
def q_histogram(spark: SparkSession, d: str) -> DataFrame:
    """25 bins on [0, 0.5], the last one closed, empty bins present."""
    return stats.histogram(throats(spark, d).where("connected"), F.col("q_crack"), 0.0, 0.5, 25, ["specimen"])


@query(f"WITH {THROATS}, {_HIST}, s AS (SELECT bin, sum(n)::DOUBLE AS a FROM h WHERE specimen <> 'S0' GROUP BY 1), z AS (SELECT bin, n::DOUBLE AS b FROM h WHERE specimen = 'S0') SELECT bin, round((a / sum(a) OVER ()) / nullif(b / sum(b) OVER (), 0), 6) AS ratio FROM s JOIN z USING (bin)")
def q_hist_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Density against a null, missing where the null is empty."""
    h = q_histogram(spark, d).withColumn("null", F.col("specimen") == "S0")
    sums = h.groupBy("bin").agg(F.sum(F.when(~F.col("null"), F.col("n"))).cast("double").alias("a"), F.sum(F.when(F.col("null"), F.col("n"))).cast("double").alias("b"))
    every = Window.partitionBy()
    return sums.select("bin", r6(F.try_divide(F.col("a") / F.sum("a").over(every), F.col("b") / F.sum("b").over(every))).alias("ratio"))


_PSD = "p AS (SELECT p_partkey AS id, p_retailprice AS d, p_retailprice * p_retailprice * p_retailprice AS w FROM part), q AS (SELECT id, d, 100.0::DOUBLE * sum(w) OVER (ORDER BY d, id) / sum(w) OVER () AS q3 FROM p)"


def size_curve(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("d"))
    return stats.cumulative_q3(part, "d", "id", F.col("d") * F.col("d") * F.col("d")).select("id", "d", "q3")


@query(f"WITH {_PSD} SELECT id, d, round(q3, 4) AS q3 FROM q")
def psd_q3(spark: SparkSession, d: str) -> DataFrame:
    """Volume-weighted cumulative size distribution."""
    return size_curve(spark, d).select("id", "d", F.round("q3", 4).alias("q3"))


def _interp_sql(target: str) -> str:
    return f"SELECT {target} FROM g LEFT JOIN LATERAL (SELECT q3 AS x0, d AS y0 FROM q WHERE q3 <= g.pos ORDER BY q3 DESC, d DESC LIMIT 1) a ON true LEFT JOIN LATERAL (SELECT q3 AS x1, d AS y1 FROM q WHERE q3 >= g.pos ORDER BY q3, d DESC LIMIT 1) b ON true"


_LINE = "CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * ((g.pos - x0) / (x1 - x0)) END"


@query(f"WITH {_PSD}, g(pos) AS (VALUES (10.0::DOUBLE), (50.0::DOUBLE), (90.0::DOUBLE)) {_interp_sql(f'g.pos AS q3, round({_LINE}, 4) AS d')}")
def psd_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """D10, D50 and D90, linear between points of the curve."""
    return stats.percentiles_q3(size_curve(spark, d), "d", [10, 50, 90]).select("q3", F.round("d", 4).alias("d"))


@query("WITH p AS (SELECT p_retailprice AS d FROM part), b AS (SELECT min(d) AS lo, max(d) AS hi FROM p), k AS (SELECT floor((d - lo) / ((hi - lo) / 40))::INTEGER AS bin, d * d * d AS w FROM p, b WHERE d < hi), t AS (SELECT sum(d * d * d) AS total FROM p) SELECT bin, round(100.0::DOUBLE * sum(w) / any_value(total) / ((any_value(hi) - any_value(lo)) / 40), 6) AS density FROM k, t, b WHERE bin < 40 GROUP BY 1")
def psd_density(spark: SparkSession, d: str) -> DataFrame:
    """Percent of volume per unit of size in 40 bins, open above, so the largest is left out."""
    p = table(spark, d, "part").select(F.col("p_retailprice").alias("d")).withColumn("w", F.col("d") * F.col("d") * F.col("d"))
    b = p.agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum("w").alias("total"))
    own = p.crossJoin(F.broadcast(b)).where("d < hi").withColumn("bin", F.floor((F.col("d") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 40)).cast("int")).where("bin < 40")
    return own.groupBy("bin").agg(r6(100.0 * F.sum("w") / F.first("total") / ((F.first("hi") - F.first("lo")) / 40)).alias("density"))


@query(f"WITH {_PSD}, r AS (SELECT id, d, q3 FROM q WHERE id % 2 = 0), g AS (SELECT unnest(range(5, 96))::DOUBLE AS pos), m AS ({_interp_sql(f'g.pos, {_LINE} AS d')}), e AS (SELECT list_extract(ds, pos::INTEGER - 4) AS d0, pos FROM (SELECT quantile_cont(d, list_transform(range(5, 96), lambda k: k / 100.0)) AS ds FROM p) x, g) SELECT round(sqrt(avg(((m.d - e.d0) / e.d0) * ((m.d - e.d0) / e.d0))), 4) AS rms FROM m JOIN e USING (pos)")
def psd_rms(spark: SparkSession, d: str) -> DataFrame:
    """RMS of the relative difference of sizes at 5 to 95 percent against the distribution by number."""
    at = [float(k) for k in range(5, 96)]
    mine = stats.percentiles_q3(size_curve(spark, d), "d", at)
    named = stats.exact_percentiles(table(spark, d, "part"), "p_retailprice", [a / 100 for a in at])
    other = named.select(F.round(F.col("p") * 100).alias("q3"), F.col("p_retailprice").alias("d0"))
    off = (F.col("d") - F.col("d0")) / F.col("d0")
    return mine.join(other, "q3").agg(F.round(F.sqrt(F.avg(off * off)), 4).alias("rms"))


@query("WITH g AS (SELECT 900.0 + 50.0 * unnest(range(0, 20)) AS x), p AS (SELECT p_retailprice AS d, p_retailprice * p_retailprice * p_retailprice AS w FROM part), s AS (SELECT sum(w) AS sw, sum(w) * sum(w) / sum(w * w) AS neff, sum(w * d) / sum(w) AS m FROM p), v AS (SELECT sqrt(sum(w * (d - m) * (d - m)) / any_value(sw) / (1 - 1 / any_value(neff))) * pow(any_value(neff), -0.2) AS h, any_value(sw) AS sw FROM p, s) SELECT x::DOUBLE AS x, round(100 * sum(w * exp(-0.5 * ((x - d) / h) * ((x - d) / h))) / any_value(sw) / (any_value(h) * sqrt(2 * pi())), 6) AS density FROM g, p, v GROUP BY 1")
def psd_kernel_density(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian kernel density of volume on a fixed grid, with Scott's factor of the effective number. The grid is an array in the row."""
    p = table(spark, d, "part").select(F.col("p_retailprice").alias("d")).withColumn("w", F.col("d") * F.col("d") * F.col("d"))
    w, x = F.col("w"), F.col("d")
    s = p.agg(F.sum(w).alias("sw"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("neff"), (F.sum(w * x) / F.sum(w)).alias("m"))
    v = p.crossJoin(F.broadcast(s)).agg((F.sqrt(F.sum(w * (x - F.col("m")) * (x - F.col("m"))) / F.first("sw") / (1 - 1 / F.first("neff"))) * F.pow(F.first("neff"), F.lit(-0.2))).alias("h"), F.first("sw").alias("sw"))
    own = p.crossJoin(F.broadcast(v)).select("w", "d", "h", "sw", F.explode(F.array(*[F.lit(900.0 + 50.0 * k) for k in range(20)])).alias("x"))
    u = (F.col("x") - x) / F.col("h")
    return own.groupBy("x").agg(r6(100 * F.sum(w * F.exp(-0.5 * u * u)) / F.first("sw") / (F.first("h") * F.sqrt(2 * F.pi()))).alias("density"))


@query("SELECT s_nationkey AS scan, round(sum(s_acctbal * w) / sum(w), 6) AS mean, round(sum(w * abs(s_acctbal - m)) / sum(w), 4) AS ra, round(sqrt(sum(w * (s_acctbal - m) * (s_acctbal - m)) / sum(w)), 4) AS rq, round(max(s_acctbal) - min(s_acctbal), 4) AS rt, round((sum(w * (s_acctbal - m) * (s_acctbal - m) * (s_acctbal - m)) / sum(w)) / nullif(sqrt(sum(w * (s_acctbal - m) * (s_acctbal - m)) / sum(w)) ** 3, 0), 4) + 0.0::DOUBLE AS rsk, round((sum(w * (s_acctbal - m) * (s_acctbal - m) * (s_acctbal - m) * (s_acctbal - m)) / sum(w)) / nullif((sum(w * (s_acctbal - m) * (s_acctbal - m)) / sum(w)) ** 2, 0), 4) AS rku FROM (SELECT *, sum(s_acctbal * w) OVER (PARTITION BY s_nationkey) / sum(w) OVER (PARTITION BY s_nationkey) AS m FROM (SELECT *, (s_suppkey % 7 + 1)::DOUBLE AS w FROM supplier)) GROUP BY 1")
def roughness_moments(spark: SparkSession, d: str) -> DataFrame:
    """Area-weighted mean, Ra, Rq, Rt, skewness and kurtosis."""
    own = table(spark, d, "supplier").select(F.col("s_nationkey").alias("scan"), F.col("s_acctbal").alias("h"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("w"))
    return stats.weighted_moments(own, "h", "w", ["scan"]).select("scan", r6(F.col("mean")).alias("mean"), F.round("ra", 4).alias("ra"), *[F.round(k, 4).alias(k) for k in ("rq", "rt", "rku")], (F.round("rsk", 4) + 0.0).alias("rsk"))


@query("WITH s AS (SELECT n_nationkey AS stage, n_regionkey AS specimen, 0.3 + 0.01 * n_nationkey AS eps, 2.0 + 0.1 * n_nationkey AS sv, 1.0 + 0.05 * n_nationkey AS tau FROM nation), k AS (SELECT specimen, stage, eps * eps * eps / (5.0 * (sv * 1000) * (sv * 1000)) AS k_sv, eps * eps * eps / ((1 - eps) * (1 - eps) * tau * tau * 5.0 * sv * sv) AS k_tau, 0.25 * eps * eps * eps / (180.0 * (1 - eps) * (1 - eps)) AS k_d FROM s) SELECT specimen, stage, round(k_sv * 1e9, 6) AS k_sv, round(k_tau, 6) AS k_tau, round(k_d, 6) AS k_d, round((k_sv - lag(k_sv) OVER w) * 1e9, 6) AS step FROM k WINDOW w AS (PARTITION BY specimen ORDER BY stage)")
def permeability(spark: SparkSession, d: str) -> DataFrame:
    """Three forms of the Kozeny-Carman law, and the change from the stage before."""
    s = table(spark, d, "nation").select(F.col("n_nationkey").alias("stage"), F.col("n_regionkey").alias("specimen"))
    eps, sv, tau = 0.3 + 0.01 * F.col("stage"), 2.0 + 0.1 * F.col("stage"), 1.0 + 0.05 * F.col("stage")
    k = s.select("specimen", "stage", g.kozeny_carman(eps, sv * 1000).alias("k_sv"), g.kozeny_tortuous(eps, tau, sv).alias("k_tau"), g.kozeny_grain(eps, F.lit(0.5)).alias("k_d"))
    w = Window.partitionBy("specimen").orderBy("stage")
    return k.select("specimen", "stage", r6(F.col("k_sv") * 1e9).alias("k_sv"), r6(F.col("k_tau")).alias("k_tau"), r6(F.col("k_d")).alias("k_d"), r6((F.col("k_sv") - F.lag("k_sv").over(w)) * 1e9).alias("step"))


@query("WITH f AS (SELECT l_shipmode_k AS k, sum(l_quantity) / sum(sum(l_quantity)) OVER () AS phi, 0.5 + 1.5 * l_shipmode_k AS c FROM (SELECT l_quantity, l_linenumber % 3 AS l_shipmode_k FROM lineitem) GROUP BY 1), m AS (SELECT arg_max(c, phi) AS cm FROM f) SELECT round(sum(phi * c), 6) AS parallel, round(1 / sum(phi / c), 6) AS series, round((SELECT cm FROM m) * (sum(phi * 3 * c / (2 * (SELECT cm FROM m) + c)) / sum(phi * 3 * (SELECT cm FROM m) / (2 * (SELECT cm FROM m) + c))), 6) AS maxwell FROM f")
def mixture_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Conductivity of a mixture: parallel, in series, and Maxwell-Eucken with the largest phase as matrix."""
    sums = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") % 3).alias("k")).agg(F.sum("l_quantity").alias("v"))
    f = sums.select((F.col("v") / F.sum("v").over(Window.partitionBy())).alias("phi"), (0.5 + 1.5 * F.col("k")).alias("c"))
    cm = f.agg(F.max_by("c", "phi").alias("cm"))
    phi, c_, m = F.col("phi"), F.col("c"), F.col("cm")
    return f.crossJoin(F.broadcast(cm)).agg(r6(F.sum(phi * c_)).alias("parallel"), r6(1 / F.sum(phi / c_)).alias("series"), r6(F.first("cm") * (F.sum(phi * 3 * c_ / (2 * m + c_)) / F.sum(phi * 3 * m / (2 * m + c_)))).alias("maxwell"))


@query("SELECT l_returnflag AS k, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) AS slope0, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1")
def slope_fits(spark: SparkSession, d: str) -> DataFrame:
    """Slope through the origin, and the straight line."""
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.round(stats.slope_through_origin("l_quantity", "l_extendedprice"), 4).alias("slope0"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"))


@query("WITH m AS (SELECT median(p_retailprice) AS v FROM part WHERE p_size >= 10) SELECT p_partkey AS id, p_retailprice AS voxels FROM part, m WHERE p_retailprice BETWEEN 0.9 * v AND 1.05 * v")
def volume_gate(spark: SparkSession, d: str) -> DataFrame:
    """Bodies within a band about the median of the gated ones; one row is broadcast."""
    part = table(spark, d, "part")
    m = stats.exact_summary(part.where("p_size >= 10"), {"v": ("p_retailprice", 0.5)})
    return part.crossJoin(F.broadcast(m)).where("p_retailprice between 0.9 * v and 1.05 * v").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("voxels"))


@query("WITH f AS (SELECT min(c_nationkey) AS first_scan FROM customer WHERE c_acctbal > 0), ok AS (SELECT c_custkey FROM customer, f WHERE c_acctbal > 0 AND c_nationkey = first_scan) SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM ok) OR NOT EXISTS (SELECT 1 FROM ok)")
def shape_gate(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose body passes the gate of the first gated scan; all of them if no gate has rows."""
    good = table(spark, d, "customer").where("c_acctbal > 0")
    first = good.agg(F.min("c_nationkey").alias("c_nationkey"))
    ok = good.join(F.broadcast(first), "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, d, "orders")
    return orders.join(ok, "o_custkey", "left_semi").select("o_orderkey") if not ok.isEmpty() else orders.select("o_orderkey")


@query(f"WITH {GRAINS}, n AS (SELECT 0.004 + 3 * stddev_pop(uz) / 4 AS cap FROM grains) SELECT id FROM grains, n WHERE abs(uz) <= cap AND isfinite(uz)")
def physical_bound(spark: SparkSession, d: str) -> DataFrame:
    """Displacements no larger than the shortening and three times the noise."""
    own = grains(spark, d)
    cap = own.agg((0.004 + 3 * F.stddev_pop("uz") / 4).alias("cap"))
    return own.crossJoin(F.broadcast(cap)).where("abs(uz) <= cap").select("id")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE p_size / 40.0 <= 0.9 AND p_retailprice <= 1500) AS kept, count(*) FILTER (WHERE NOT (p_size / 40.0 <= 0.9 AND p_retailprice <= 1500)) AS dropped FROM part")
def psd_quality(spark: SparkSession, d: str) -> DataFrame:
    """Bodies that are round and small enough, and how many aren't."""
    ok = (F.col("p_size") / 40.0 <= 0.9) & (F.col("p_retailprice") <= 1500)
    return table(spark, d, "part").agg(F.count("*").alias("n"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query(f"WITH {GRAINS}, p AS (SELECT a.id AS a, b.id AS b, degrees(acos(least(abs(b.z - a.z) / greatest(sqrt((b.z - a.z) * (b.z - a.z) + (b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x)), 1e-12), 1.0))) AS dip FROM grains a JOIN grains b ON a.label = b.label AND b.id = a.id + 10) SELECT a, b, round(dip, 4) AS dip, CASE WHEN dip >= 70 THEN 'vertical' WHEN dip >= 20 THEN 'diagonal' ELSE 'horizontal' END AS dip_class, CASE WHEN dip >= 60 THEN 'vertical' WHEN dip >= 30 THEN 'diagonal' ELSE 'horizontal' END AS dip_class_30 FROM p")
def dip_classes(spark: SparkSession, d: str) -> DataFrame:
    a, b = grains(spark, d).select("id", "z", "y", "x", "label"), grains(spark, d).select((F.col("id") - 10).alias("id"), F.col("z").alias("z2"), F.col("y").alias("y2"), F.col("x").alias("x2"), "label")
    dip = g.branch_dip(F.col("z2") - F.col("z"), F.col("y2") - F.col("y"), F.col("x2") - F.col("x"))
    own = a.join(b, ["id", "label"]).withColumn("dip", dip)
    return own.select(F.col("id").alias("a"), (F.col("id") + 10).alias("b"), F.round("dip", 4).alias("dip"), c.dip_class(F.col("dip")).alias("dip_class"), c.dip_class(F.col("dip"), 30, 60).alias("dip_class_30"))


@query("WITH k AS (SELECT p_size * 10 AS n, (p_partkey % 10) / 10.0 AS pl, (p_partkey % 4)::DOUBLE AS th, (p_partkey % 7) / 10.0 AS gs, (p_partkey % 9) / 10.0 AS ice, p_partkey % 3 = 0 AS perc, p_retailprice AS len FROM part), c AS (SELECT *, CASE WHEN n < 50 THEN 'NOISE' WHEN pl >= 0.6 AND th <= 2 THEN 'CRACK' WHEN gs >= 0.55 THEN 'DELAMINATION' WHEN ice >= 0.55 THEN 'ICE-FRACTURE' ELSE 'CAVITY' END AS damage_class FROM k) SELECT damage_class, damage_class = 'CRACK' AND perc AND len / 2000.0 >= 0.5 AS fully_developed, count(*) AS n FROM c GROUP BY 1, 2")
def damage_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    own = table(spark, d, "part").withColumn("damage_class", c.damage_class(F.col("p_size") * 10, k % 10 / 10.0, (k % 4).cast("double"), k % 7 / 10.0, k % 9 / 10.0))
    full = c.fully_developed(F.col("damage_class"), k % 3 == 0, F.col("p_retailprice"), F.lit(2000.0))
    return own.groupBy("damage_class", full.alias("fully_developed")).agg(F.count("*").alias("n"))


@query("WITH z AS (SELECT l_quantity AS ice0, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity * l_discount * 10 END AS ice1, (l_partkey % 40)::DOUBLE AS air, l_quantity AS ice, (l_suppkey % 300)::DOUBLE AS contact FROM lineitem) SELECT CASE WHEN coalesce(ice1, 0) = 0 THEN 'BROKEN' WHEN ice1 < 0.5::DOUBLE * ice0 THEN 'WEAKENED' ELSE 'SURVIVING' END AS state, CASE WHEN air + ice + contact < 20 THEN 'UNCLEAR' WHEN (contact > 0 AND air + ice < 20) OR contact / (air + ice + contact) >= 0.8::DOUBLE THEN 'CRUSHED' WHEN air / (air + ice) >= 0.7::DOUBLE THEN 'DELAMINATION' WHEN air / (air + ice) <= 0.3::DOUBLE THEN 'COHESIVE' ELSE 'MIXED' END AS mode, count(*) AS n FROM z GROUP BY 1, 2")
def failure_modes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    after = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity") * F.col("l_discount") * 10)
    mode = c.volume_mode((F.col("l_partkey") % 40).cast("double"), F.col("l_quantity"), (F.col("l_suppkey") % 300).cast("double"))
    return li.groupBy(c.bond_state(F.col("l_quantity"), after).alias("state"), mode.alias("mode")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT l_suppkey AS bead, l_linenumber % 2 AS scan, count(*) AS n, avg((l_discount >= 0.05)::INTEGER) AS dry FROM lineitem GROUP BY 1, 2), c AS (SELECT a.bead, b.dry - a.dry AS change FROM s a JOIN s b ON a.bead = b.bead AND a.scan = 0 AND b.scan = 1 WHERE a.n >= 20 AND b.n >= 20) SELECT CASE WHEN change > 0.30 THEN 'strong' WHEN change > 0.10 THEN 'mild' WHEN change >= -0.10 THEN 'stable' ELSE 'wetter' END AS band, count(*) AS n FROM c GROUP BY 1")
def dryness_bands(spark: SparkSession, d: str) -> DataFrame:
    """Change of the dry share of a body's surface between two scans, where both have 20 voxels."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("bead")).agg(*[f(F.when(F.col("l_linenumber") % 2 == k, v)).alias(f"{n}{k}") for k in (0, 1) for n, f, v in (("n", F.count, F.lit(1)), ("dry", F.avg, (F.col("l_discount") >= 0.05).cast("int")))])
    own = s.where("n0 >= 20 and n1 >= 20")
    return own.groupBy(c.dryness_band(F.col("dry1") - F.col("dry0")).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, round(2.0 * cbrt(3.0 * p_retailprice / (4.0 * pi())), 6) AS d_eq, round(p_size / (pi() / 6.0 * (greatest(p_size % 5, 3)::DOUBLE ** 3)), 6) AS box_sphericity, round(cbrt(pi()) * pow(6.0 * p_retailprice, 2.0 / 3.0) / (p_size * 100), 6) AS wadell FROM part")
def derived_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Equivalent diameter and two sphericities."""
    v, n = F.col("p_retailprice"), F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), r6(g.equivalent_diameter(v)).alias("d_eq"), r6(g.box_sphericity(n, n % 5, F.lit(3), F.lit(2))).alias("box_sphericity"), r6(g.wadell_sphericity(v, n * 100)).alias("wadell"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 40 = 0")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every 40th slice: the sampling operator itself."""
    return table(spark, d, "lineitem").where("l_orderkey % 40 = 0").select("l_orderkey", "l_linenumber")


@query("WITH m AS (SELECT l_linenumber % 2 AS scan, l_orderkey % 20 AS z, median(l_extendedprice) AS grain, quantile_cont(l_extendedprice, 0.05) AS pore FROM lineitem GROUP BY 1, 2), s AS (SELECT scan, median(grain) AS grain, median(pore) AS pore FROM m GROUP BY 1), p AS (SELECT a.grain - a.pore AS g0, a.pore AS p0, b.grain - b.pore AS g1, b.pore AS p1 FROM s a, s b WHERE a.scan = 0 AND b.scan = 1) SELECT round(g0 / g1, 6) AS gain, round(p0 - g0 / g1 * p1, 4) AS offset_, CASE WHEN abs(g0 / g1 - 1) <= 0.10 THEN 'skip' ELSE 'map' END AS verdict FROM p")
def grey_landmarks(spark: SparkSession, d: str) -> DataFrame:
    """Linear map between two scans from two landmarks: medians of slices, then of the scan."""
    own = table(spark, d, "lineitem").select((F.col("l_linenumber") % 2).alias("scan"), (F.col("l_orderkey") % 20).alias("z"), "l_extendedprice")
    z = stats.exact_summary(own, {"grain": ("l_extendedprice", 0.5), "pore": ("l_extendedprice", 0.05)}, ["scan", "z"])
    s = z.groupBy("scan").agg(F.percentile("grain", F.lit(0.5)).alias("grain"), F.percentile("pore", F.lit(0.5)).alias("pore"))
    one = s.groupBy().agg(*[F.max(F.when(F.col("scan") == k, F.col(n))).alias(f"{n}{k}") for k in (0, 1) for n in ("grain", "pore")])
    gain = (F.col("grain0") - F.col("pore0")) / (F.col("grain1") - F.col("pore1"))
    return one.select(r6(gain).alias("gain"), F.round(F.col("pore0") - gain * F.col("pore1"), 4).alias("offset_"), F.when(F.abs(gain - 1) <= 0.10, "skip").otherwise("map").alias("verdict"))


@query("SELECT l_orderkey, l_linenumber, floor(greatest(0, least(65535, l_extendedprice * 0.9::DOUBLE - 5000)))::INTEGER AS grey FROM lineitem")
def clipped_grey(spark: SparkSession, d: str) -> DataFrame:
    """Linear map, clipped to 16 bits and cut to whole numbers."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(65535.0), F.col("l_extendedprice") * 0.9 - 5000))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor(v).cast("int").alias("grey"))


@query("WITH a AS (SELECT l_orderkey AS id, l_partkey % 6 AS true_label, CASE WHEN l_tax > 0.04 THEN l_partkey % 6 ELSE l_suppkey % 6 END AS raw FROM lineitem), c AS (SELECT true_label, raw, count(*) AS n FROM a GROUP BY 1, 2), p AS (SELECT raw, max(n) / sum(n) AS purity, sum(n) AS n FROM c WHERE raw > 0 GROUP BY 1) SELECT round((SELECT sum(n) FROM c WHERE true_label > 0 AND raw > 0) / (SELECT sum(n) FROM c WHERE true_label > 0), 6) AS coverage, round((SELECT 2 * sum(n) FROM c WHERE true_label > 0 AND raw > 0) / ((SELECT sum(n) FROM c WHERE true_label > 0) + (SELECT sum(n) FROM c WHERE raw > 0)), 6) AS dice, round(avg(purity), 6) AS purity FROM p")
def coverage_scores(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, Dice and mean purity of predicted instances."""
    a = table(spark, d, "lineitem").select((F.col("l_partkey") % 6).alias("t"), F.when(F.col("l_tax") > 0.04, F.col("l_partkey") % 6).otherwise(F.col("l_suppkey") % 6).alias("raw"))
    n = a.groupBy("t", "raw").agg(F.count("*").alias("n"))
    both = F.sum(F.when((F.col("t") > 0) & (F.col("raw") > 0), F.col("n")))
    whole = n.agg(r6(both / F.sum(F.when(F.col("t") > 0, F.col("n")))).alias("coverage"), r6(2 * both / (F.sum(F.when(F.col("t") > 0, F.col("n"))) + F.sum(F.when(F.col("raw") > 0, F.col("n"))))).alias("dice"))
    pure = n.where("raw > 0").groupBy("raw").agg((F.max("n") / F.sum("n")).alias("p")).agg(r6(F.avg("p")).alias("purity"))
    return whole.crossJoin(F.broadcast(pure))


@query("WITH t AS (SELECT vec_id AS tag, list_transform(embedding, lambda x: 1 + 2 * x::DOUBLE) AS tau FROM embeddings) SELECT tag, len(list_filter(tau, lambda x: x >= 1)) AS n_ok, round(list_avg(list_filter(tau, lambda x: x >= 1)), 6) AS tau_mean, round(list_stddev_pop(list_filter(tau, lambda x: x >= 1)), 6) AS tau_sd FROM t")
def accepted_tau(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation of accepted cubes, inside the nested row; counts always."""
    tau = F.transform("embedding", lambda x: 1 + 2 * x.cast("double"))
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("tag"), F.filter(tau, lambda x: (x >= 1) & ~F.isnan(x)).alias("ok"))
    total = lambda f: F.aggregate("ok", F.lit(0.0), f)
    own = own.withColumn("m", F.try_divide(total(lambda a, x: a + x), F.size("ok")))
    var = F.try_divide(F.aggregate("ok", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))), F.size("ok"))
    return own.select("tag", F.size("ok").cast("long").alias("n_ok"), r6(F.col("m")).alias("tau_mean"), r6(F.sqrt(var)).alias("tau_sd"))


@query("SELECT o_custkey % 9 AS specimen, count(*) AS n, round(arg_min(o_totalprice, o_orderkey), 6) AS first_value, round(arg_max(o_totalprice, o_orderkey), 6) AS last_value, round(arg_max(o_totalprice, o_orderkey) - arg_min(o_totalprice, o_orderkey), 4) AS change FROM orders GROUP BY 1")
def first_last(spark: SparkSession, d: str) -> DataFrame:
    """First and last row of each specimen in order of the scans, by one aggregation."""
    a, b = F.min_by("o_totalprice", "o_orderkey"), F.max_by("o_totalprice", "o_orderkey")
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 9).alias("specimen")).agg(F.count("*").alias("n"), r6(a).alias("first_value"), r6(b).alias("last_value"), F.round(b - a, 4).alias("change"))


@query(f"WITH {THROATS}, t AS (SELECT specimen, count(*) AS throats, round(median(gap_vox), 6) AS gap_med FROM throats GROUP BY 1), o AS (SELECT 'S' || (o_orderkey % 9) AS specimen, count(*) AS orders, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY 1), k AS (SELECT 'S' || (c_custkey % 9) AS specimen, string_agg(DISTINCT c_mktsegment, ' / ' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1) SELECT t.specimen, throats, gap_med, orders, price, segments FROM t LEFT JOIN o USING (specimen) LEFT JOIN k USING (specimen)")
def specimen_summary(spark: SparkSession, d: str) -> DataFrame:
    """One wide row per specimen from three relations."""
    own = throats(spark, d)
    t = own.groupBy("specimen").agg(F.count("*").alias("throats")).join(stats.exact_summary(own, {"gap_med": ("gap_vox", 0.5)}, ["specimen"]).withColumn("gap_med", r6(F.col("gap_med"))), "specimen")
    s = lambda k: F.concat(F.lit("S"), (F.col(k) % 9).cast("string")).alias("specimen")
    o = table(spark, d, "orders").groupBy(s("o_orderkey")).agg(F.count("*").alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("price"))
    #: Distinct names, of which there are few: a list of all rows would be one value of unbounded size.
    k = table(spark, d, "customer").groupBy(s("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), " / ").alias("segments"))
    return t.join(o, "specimen", "left").join(k, "specimen", "left")


@query("SELECT c_nationkey AS id, n_name AS name, count(*) AS n, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS kinds FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def table_join(spark: SparkSession, d: str) -> DataFrame:
    """Equi-join of two published tables; the size of the dimension is left for the optimizer to measure."""
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("c_nationkey").alias("id"), F.col("n_name").alias("name")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("kinds"))


@query("WITH s AS (SELECT l_suppkey AS comp, l_linenumber % 2 AS scan, count(*) AS size FROM lineitem GROUP BY 1, 2) SELECT scan, comp, size, rank, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY size DESC, comp) AS rank, size / sum(size) OVER (PARTITION BY scan) AS share FROM s) WHERE rank <= 4 AND share >= 0.0001")
def top_components(spark: SparkSession, d: str) -> DataFrame:
    """The four largest that hold enough of the total: a top-k report."""
    from voxloom.operators.graph import ranked_components

    s = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") % 2).alias("scan"), F.col("l_suppkey").alias("comp")).agg(F.count("*").alias("size"))
    return ranked_components(s, ["scan"], 4, 0.0001).select("scan", "comp", "size", "rank", r6(F.col("share")).alias("share"))


@query("SELECT p_brand AS material, max_p AS top, n FROM (SELECT p_brand, arg_max(p_partkey, (p_size, -p_partkey)) AS max_p, count(*) AS n FROM part GROUP BY 1)")
def largest_per_class(spark: SparkSession, d: str) -> DataFrame:
    """The largest member of each class, ties to the smaller id."""
    best = F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey")))
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("material")).agg(best.alias("top"), F.count("*").alias("n"))


@query("WITH o(o_orderpriority, pos) AS (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 4), ('5-LOW', 5)) SELECT o_orderpriority AS class, coalesce(pos, 99)::INTEGER AS pos, count(*) AS n FROM orders LEFT JOIN o USING (o_orderpriority) GROUP BY 1, 2 ORDER BY pos")
def categorical_order(spark: SparkSession, d: str) -> DataFrame:
    """Classes in a stated order."""
    order = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    pos = F.array_position(order, F.col("o_orderpriority")).cast("int")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("class"), F.when(pos == 0, 99).otherwise(pos).alias("pos")).agg(F.count("*").alias("n")).orderBy("pos")


@query(f"WITH {THROATS}, a AS (SELECT DISTINCT bead_a, bead_b FROM throats WHERE scan = 1), b AS (SELECT DISTINCT bead_a, bead_b FROM throats WHERE scan = 2) SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def pair_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of intersection, differences and union of two scans' pairs, from one aggregation instead of four set operations."""
    per = throats(spark, d).groupBy("bead_a", "bead_b").agg(F.max((F.col("scan") == 1).cast("int")).alias("a"), F.max((F.col("scan") == 2).cast("int")).alias("b"))
    one = per.agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.sum(F.col("a") * (1 - F.col("b"))).alias("first"), F.sum((1 - F.col("a")) * F.col("b")).alias("second"), F.count("*").alias("any"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.coalesce(s, F.lit(0)).cast("long").alias("n")) for s in ("both", "first", "second", "any")])).alias("s")).select("s.side", "s.n")


@query("WITH old AS (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier WHERE s_suppkey % 3 <> 0), new AS (SELECT s_suppkey AS id, s_acctbal + 1 AS v FROM supplier WHERE s_suppkey % 2 = 0) SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    return stats.upsert(s.where("id % 3 <> 0"), s.where("id % 2 = 0").withColumn("v", F.col("v") + 1), ["id"])


@query("SELECT label, count(*) AS n FROM (SELECT l_partkey % 500 AS label FROM lineitem) WHERE label > 0 GROUP BY 1")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("label")).where("label > 0").groupBy("label").agg(F.count("*").alias("n"))


def fabric(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, f**, anisotropy): mean of n n^T over unit vectors, and sqrt(1.5) times its deviator's norm."""
    pairs = [(a, b) for i, a in enumerate("zyx") for b in "zyx"[i:]]
    f = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.col(f"n{a}") * F.col(f"n{b}")).alias(f"f{a}{b}") for a, b in pairs])
    dev = [F.col(f"f{a}{a}") - 1 / 3.0 for a in "zyx"]
    off = F.col("fzy") * F.col("fzy") + F.col("fzx") * F.col("fzx") + F.col("fyx") * F.col("fyx")
    return f.withColumn("anisotropy", F.sqrt(1.5 * (dev[0] * dev[0] + dev[1] * dev[1] + dev[2] * dev[2] + 2 * off)))


@query(f"WITH {GRAINS}, u AS (SELECT label, z / s AS nz, y / s AS ny, x / s AS nx FROM (SELECT *, sqrt(z * z + y * y + x * x) AS s FROM grains)), f AS (SELECT label, count(*) AS n, avg(nz * nz) AS zz, avg(nz * ny) AS zy, avg(nz * nx) AS zx, avg(ny * ny) AS yy, avg(ny * nx) AS yx, avg(nx * nx) AS xx FROM u GROUP BY 1) SELECT label, n, round(zz, 6) AS fzz, round(yy, 6) AS fyy, round(xx, 6) AS fxx, round(sqrt(1.5 * ((zz - 1 / 3.0) * (zz - 1 / 3.0) + (yy - 1 / 3.0) * (yy - 1 / 3.0) + (xx - 1 / 3.0) * (xx - 1 / 3.0) + 2 * (zy * zy + zx * zx + yx * yx))), 6) AS anisotropy FROM f")
def fabric_tensor(spark: SparkSession, d: str) -> DataFrame:
    s = F.sqrt(F.col("z") * F.col("z") + F.col("y") * F.col("y") + F.col("x") * F.col("x"))
    u = grains(spark, d).withColumn("s", s).select("label", *[(F.col(a) / F.col("s")).alias(f"n{a}") for a in "zyx"])
    return fabric(u, ["label"]).select("label", "n", r6(F.col("fzz")).alias("fzz"), r6(F.col("fyy")).alias("fyy"), r6(F.col("fxx")).alias("fxx"), r6(F.col("anisotropy")).alias("anisotropy"))


_EIG = "e AS (SELECT *, (szz + syy + sxx) / 3.0 AS q FROM c), e2 AS (SELECT *, sqrt(((szz - q) * (szz - q) + (syy - q) * (syy - q) + (sxx - q) * (sxx - q) + 2.0 * (szy * szy + szx * szx + syx * syx)) / 6.0) AS p FROM e), e3 AS (SELECT *, (szz - q) / p AS a, (syy - q) / p AS b, (sxx - q) / p AS cc, szy / p AS d, szx / p AS ee, syx / p AS f FROM e2), e4 AS (SELECT *, acos(greatest(least((a * (b * cc - f * f) - d * (d * cc - f * ee) + ee * (d * f - b * ee)) / 2.0, 1.0), -1.0)) / 3.0 AS t FROM e3), e5 AS (SELECT *, q + 2.0 * p * cos(t) AS l1, q + 2.0 * p * cos(t + 2.0 * pi() / 3.0) AS l3 FROM e4)"


@query(f"WITH {GRAINS}, c AS (SELECT label, count(*) AS n, covar_pop(z, z) AS szz, covar_pop(z, y) AS szy, covar_pop(z, x) AS szx, covar_pop(y, y) AS syy, covar_pop(y, x) AS syx, covar_pop(x, x) AS sxx FROM grains GROUP BY 1), {_EIG} SELECT label, n, round(l1, 8) AS l1, round(3.0 * q - l1 - l3, 8) AS l2, round(l3, 8) AS l3, round(1 - l3 / (3.0 * q - l1 - l3), 5) AS planarity, round(((3.0 * q - l1 - l3) - l3) / l1, 5) AS planarity_linear, round(sqrt(l3), 6) AS rms FROM e5")
def plane_fit_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Principal values in closed form from one aggregation; three definitions of planarity."""
    p = stats.plane_fit(grains(spark, d), ["label"])
    l = [F.col(k) for k in ("l1", "l2", "l3")]  # noqa: E741
    return p.select("label", "n", *[F.round(x, 8).alias(k) for x, k in zip(l, ("l1", "l2", "l3"), strict=True)], F.round(g.planarity(*l), 5).alias("planarity"), F.round(g.planarity(*l, variant="linear"), 5).alias("planarity_linear"), r6(F.col("rms")).alias("rms"))


@query(f"WITH {GRAINS} SELECT label, count(*) AS n, round(min(z), 6) AS z0, round(max(z), 6) AS z1, round(min(y), 6) AS y0, round(max(y), 6) AS y1, round(sum(z) / count(*), 6) AS cz, round(sum(y) / count(*), 6) AS cy, round(sum(x) / count(*), 6) AS cx FROM grains GROUP BY 1")
def bbox_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Bounding box and centroid per label from partial sums."""
    return grains(spark, d).groupBy("label").agg(F.count("*").alias("n"), *[r6(f(a)).alias(f"{a}{k}") for a in "zy" for k, f in ((0, F.min), (1, F.max))], *[r6(F.sum(a) / F.count("*")).alias(f"c{a}") for a in "zyx"])


@query(f"WITH {GRAINS}, m AS (SELECT avg(y) AS my, avg(x) AS mx, min(z) AS lo, max(z) AS hi FROM grains), r AS (SELECT z, sqrt((y - my) * (y - my) + (x - mx) * (x - mx)) AS rad, lo, hi FROM grains, m) SELECT round(any_value(hi) - any_value(lo), 6) AS height, round(quantile_cont(CASE WHEN z BETWEEN lo + 0.2 * (hi - lo) AND lo + 0.8 * (hi - lo) THEN rad END, 0.98), 6) AS radius, count(*) FILTER (WHERE z BETWEEN lo + 0.2 * (hi - lo) AND lo + 0.8 * (hi - lo)) AS inside FROM r")
def column_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Height, and the radius that holds 98 percent of the middle 60 percent of it."""
    own = grains(spark, d)
    m = own.agg(F.avg("y").alias("my"), F.avg("x").alias("mx"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    dy, dx = F.col("y") - F.col("my"), F.col("x") - F.col("mx")
    mid = F.col("z").between(F.col("lo") + 0.2 * (F.col("hi") - F.col("lo")), F.col("lo") + 0.8 * (F.col("hi") - F.col("lo")))
    near = own.crossJoin(F.broadcast(m)).select("lo", "hi", mid.alias("mid"), F.when(mid, F.sqrt(dy * dy + dx * dx)).alias("r"))
    some = near.agg(r6(F.first("hi") - F.first("lo")).alias("height"), F.count_if("mid").alias("inside"))
    return some.crossJoin(F.broadcast(stats.exact_summary(near, {"radius": ("r", 0.98)}).withColumn("radius", r6(F.col("radius")))))


_LONG = "s_acctbal >= 200 AND s_suppkey % 50 >= 5"


@query(f"SELECT s_nationkey AS scan, count(*) AS n, count(*) FILTER (WHERE {_LONG}) AS kept FROM supplier GROUP BY 1 HAVING count(*) FILTER (WHERE {_LONG}) >= 5")
def edge_filter(spark: SparkSession, d: str) -> DataFrame:
    """Edges that are long and thick enough; scans left with fewer than five are skipped."""
    own = table(spark, d, "supplier").select(F.col("s_nationkey").alias("scan"), F.col("s_acctbal").alias("length"), (F.col("s_suppkey") % 50).alias("thick"))
    kept = kept_edges(own, 200.0, 5.0, 5).groupBy("scan").agg(F.count("*").alias("kept"))
    return own.groupBy("scan").agg(F.count("*").alias("n")).join(kept, "scan")


@query(f"WITH {THROATS}, s AS (SELECT *, CASE WHEN cover_a >= 0.5::DOUBLE THEN 3 ELSE 1 END AS phase FROM throats) SELECT specimen, scan, round(avg(gap_vox) FILTER (WHERE phase = 3) / nullif(stddev_pop(gap_vox) FILTER (WHERE phase = 3), 0), 6) AS snr, round(abs(avg(gap_vox) FILTER (WHERE phase = 3) - avg(gap_vox) FILTER (WHERE phase = 1)) / nullif(sqrt((var_pop(gap_vox) FILTER (WHERE phase = 3) + var_pop(gap_vox) FILTER (WHERE phase = 1)) / 2), 0), 6) AS cnr FROM s GROUP BY 1, 2")
def phase_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Signal to noise of a phase, and contrast to noise of two."""
    own = throats(spark, d).withColumn("phase", F.when(F.col("cover_a") >= 0.5, 3).otherwise(1))
    return stats.contrast(own, "gap_vox", "phase", 1, 3, ["specimen", "scan"]).select("specimen", "scan", r6(F.col("snr")).alias("snr"), r6(F.col("cnr")).alias("cnr"))


@query("SELECT cluster, n, rank FROM (SELECT p_brand AS cluster, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY 1) WHERE rank <= 6")
def first_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The first six clusters of a report, the largest first."""
    n = table(spark, d, "part").groupBy(F.col("p_brand").alias("cluster")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "cluster").limit(6).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "cluster")))


@query("SELECT p_partkey AS id, p_retailprice AS volume FROM part ORDER BY p_retailprice DESC, p_partkey")
def by_volume(spark: SparkSession, d: str) -> DataFrame:
    """Rows for output, the largest first, ties by id: a sort by ranges."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("volume")).orderBy(F.desc("volume"), "id")


@query(f"WITH {THROATS} SELECT end_, count(*) AS n, count(DISTINCT bead) AS beads FROM (SELECT 'a' AS end_, bead_a AS bead FROM throats UNION ALL SELECT 'b', bead_b FROM throats) GROUP BY 1")
def endpoint_union(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of all pairs as one relation."""
    own = throats(spark, d)
    ends = own.select(F.lit("a").alias("end_"), F.col("bead_a").alias("bead")).unionByName(own.select(F.lit("b").alias("end_"), F.col("bead_b").alias("bead")))
    return ends.groupBy("end_").agg(F.count("*").alias("n"), F.count_distinct("bead").alias("beads"))


@query(f"WITH {THROATS} SELECT specimen, count(*) AS tests, count(*) FILTER (WHERE q_crack <= 0.05::DOUBLE) AS hits, round(0.05::DOUBLE * count(*), 6) AS expected FROM throats WHERE q_crack IS NOT NULL GROUP BY 1")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tests flagged at a level against those expected by chance."""
    own = throats(spark, d).where("q_crack is not null")
    return stats.flags_against_chance(own, F.col("q_crack") <= 0.05, 0.05, ["specimen"]).withColumn("expected", r6(F.col("expected")))


@query("WITH n AS (SELECT l_suppkey % 20 AS test, l_quantity AS v, l_discount AS w FROM lineitem), o AS (SELECT test, 40.0 + test / 10.0 AS v0, 0.05 + test / 500.0 AS w0 FROM (SELECT DISTINCT test FROM n)) SELECT test, round(greatest(avg((v >= v0 AND w >= w0)::INTEGER), 1.0::DOUBLE / (count(*) + 1)), 6) AS p FROM n JOIN o USING (test) GROUP BY 1")
def joint_p(spark: SparkSession, d: str) -> DataFrame:
    """Share of draws at or beyond the observed in two values at once, no less than the draws resolve."""
    n = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("test"), F.col("l_quantity").alias("v"), F.col("l_discount").alias("w"))
    seen = n.select("test").distinct().select("test", (40.0 + F.col("test") / 10.0).alias("v"), (0.05 + F.col("test") / 500.0).alias("w"))
    return stats.joint_tail_p(n, seen, ["v", "w"], ["test"]).withColumn("p", r6(F.col("p")))
