"""Queries over ordered series and records: runs, smoothing, interpolation, adjustment, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.operators import series as s
from voxloom.operators import stats
from voxloom.plans.registry import query
from voxloom.plans.standins import GRAINS, SERIES, grains, series, table

r6 = lambda x, n=6: F.round(x, n)


@query("WITH p AS (SELECT l_suppkey AS test, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE avg((l_quantity > 45)::INTEGER) END AS p FROM lineitem GROUP BY 1), r AS (SELECT *, count(p) OVER () AS n, row_number() OVER (ORDER BY p NULLS LAST, test) AS k FROM p) SELECT test, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1) END, 6) AS p_bh FROM r")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Benjamini-Hochberg over one p value per test: a table of tests, not of rows."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("test")).agg(F.avg((F.col("l_quantity") > 45).cast("int")).alias("p"))
    p = p.withColumn("p", F.when(F.col("test") % 11 != 0, F.col("p")))
    return s.benjamini_hochberg(p, "p", "test").select("test", r6(F.col("p")).alias("p"), r6(F.col("p_bh")).alias("p_bh"))


@query(f"WITH {SERIES} SELECT key, pos, round(value - lag(value) OVER w, 6) AS step, round(value - first_value(value) OVER w, 6) AS change, round(log10(greatest(value, 0.001) / greatest(first_value(value) OVER w, 0.001)), 5) AS log_ratio FROM series WINDOW w AS (PARTITION BY key ORDER BY pos)")
def baseline_change(spark: SparkSession, d: str) -> DataFrame:
    """Change from the step before and from the first listed step."""
    w = Window.partitionBy("key").orderBy("pos")
    v, first = F.col("value"), F.first("value").over(w)
    return series(spark, d).select("key", "pos", r6(v - F.lag(v).over(w)).alias("step"), r6(v - first).alias("change"), F.round(F.log10(F.greatest(v, F.lit(0.001)) / F.greatest(first, F.lit(0.001))), 5).alias("log_ratio"))


_RUNS = "runs AS (SELECT key, min(pos) AS start, max(pos) AS end_, count(*) AS n FROM (SELECT key, pos, pos - row_number() OVER (PARTITION BY key ORDER BY pos) AS g FROM series WHERE value > 20) GROUP BY key, g)"


@query(f"WITH {SERIES}, {_RUNS} SELECT key, start, end_, n FROM runs")
def segment_runs(spark: SparkSession, d: str) -> DataFrame:
    return s.runs(series(spark, d), "pos", F.col("value") > 20, ["key"]).withColumnRenamed("end", "end_")


@query(f"WITH {SERIES}, {_RUNS} SELECT key, start, end_, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, start) AS k FROM runs) WHERE k = 1")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    """The first of the longest runs in band, as for the granular column."""
    return s.longest_run(series(spark, d), "pos", F.col("value") > 20, ["key"]).withColumnRenamed("end", "end_")


@query(f"WITH {SERIES}, g AS (SELECT key, min(pos) AS a, max(pos) AS b FROM series WHERE value > 40 GROUP BY 1) SELECT key, pos, round(value, 6) AS value FROM series JOIN g USING (key) WHERE pos BETWEEN a AND b")
def end_trim(spark: SparkSession, d: str) -> DataFrame:
    return s.end_trim(series(spark, d), "pos", F.col("value") > 40, ["key"]).select("key", "pos", r6(F.col("value")).alias("value"))


@query(f"WITH {SERIES}, m AS (SELECT key, median(value) AS m, count(*) AS n FROM series GROUP BY 1), k AS (SELECT s.key, pos, value, m, n FROM series s JOIN m USING (key) WHERE value BETWEEN 0.2 * m AND 3 * m) SELECT key, count(*) AS kept, any_value(n) - count(*) AS dropped, round(sum(value), 4) AS total FROM k GROUP BY 1")
def slice_drop(spark: SparkSession, d: str) -> DataFrame:
    """Slices far from their scan's median are dropped and counted."""
    own = series(spark, d)
    m = own.groupBy("key").agg(F.percentile("value", F.lit(0.5)).alias("m"), F.count("*").alias("n"))
    return own.join(m, "key").where("value between 0.2 * m and 3 * m").groupBy("key").agg(F.count("*").alias("kept"), (F.first("n") - F.count("*")).alias("dropped"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {SERIES} SELECT key, pos, round(quantile_cont(value, 0.5) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS median FROM series")
def moving_median(spark: SparkSession, d: str) -> DataFrame:
    return s.moving_median(series(spark, d), "pos", "value", 10, ["key"]).select("key", "pos", r6(F.col("median")).alias("median"))


@query(f"WITH {SERIES} SELECT key, pos, round(avg(value) OVER w, 6) AS mean, round(coalesce(lag(value) OVER (PARTITION BY key ORDER BY pos), value) * 0.25::DOUBLE + value * 0.5::DOUBLE + coalesce(lead(value) OVER (PARTITION BY key ORDER BY pos), value) * 0.25::DOUBLE, 6) AS smooth FROM series WINDOW w AS (PARTITION BY key ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    """A moving average, and weights with the ends repeated."""
    own = s.moving_average(series(spark, d), "pos", "value", 2, ["key"])
    return s.smoothed(own, "pos", "value", [0.25, 0.5, 0.25], ["key"]).select("key", "pos", r6(F.col("mean")).alias("mean"), r6(F.col("smooth")).alias("smooth"))


@query(f"WITH {SERIES}, p AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM series WINDOW w AS (PARTITION BY key ORDER BY pos)) SELECT key, pos, round(value, 6) AS value FROM p WHERE value > a AND value > b AND value >= 30")
def local_peaks(spark: SparkSession, d: str) -> DataFrame:
    return s.peaks(series(spark, d), "pos", "value", ["key"], 30).select("key", "pos", r6(F.col("value")).alias("value"))


#: A plateau counts at its middle; peaks are taken from the highest down if none that was taken is near.
_FOUND = "h AS (SELECT b::INTEGER AS bin, count(v.bin) AS n FROM range(128) r(b) LEFT JOIN (SELECT least(floor((l_extendedprice - 900) / ((105000.0::DOUBLE - 900) / 128)), 127)::INTEGER AS bin FROM lineitem WHERE l_extendedprice BETWEEN 900 AND 105000) v ON v.bin = b GROUP BY 1), run AS (SELECT min(bin) AS b0, max(bin) AS b1, any_value(n) AS n FROM (SELECT *, sum(fresh) OVER (ORDER BY bin) AS run FROM (SELECT *, (n IS DISTINCT FROM lag(n) OVER (ORDER BY bin))::INTEGER AS fresh FROM h)) GROUP BY run), ranked AS (SELECT (b0 + b1) // 2 AS p, n, row_number() OVER (ORDER BY n DESC, b0 + b1 DESC) AS k FROM (SELECT *, lag(n) OVER (ORDER BY b0) AS before, lead(n) OVER (ORDER BY b0) AS after FROM run) WHERE n > before AND n > after AND n >= 10), pick AS (SELECT 0::BIGINT AS k, []::INTEGER[] AS kept UNION ALL SELECT r.k, CASE WHEN list_min(list_transform(kept, lambda o: abs(o - r.p))) < 4 THEN kept ELSE list_append(kept, r.p) END FROM pick JOIN ranked r ON r.k = pick.k + 1), taken AS (SELECT unnest(kept) AS p FROM (SELECT kept FROM pick ORDER BY k DESC LIMIT 1))"
_BOUND = "bound AS (SELECT p, a.n, max(h.bin) FILTER (WHERE h.bin < p AND h.n > a.n) AS l, min(h.bin) FILTER (WHERE h.bin > p AND h.n > a.n) AS r FROM ranked a JOIN taken USING (p), h GROUP BY 1, 2), base AS (SELECT p, bound.n, greatest(min(h.n) FILTER (WHERE bin <= p), min(h.n) FILTER (WHERE bin >= p)) AS base FROM bound, h WHERE bin > coalesce(l, -1) AND bin < coalesce(r, 128) GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {_FOUND}, {_BOUND} SELECT 0 AS scan, p::INTEGER AS bin, n::DOUBLE AS n, (n - base)::DOUBLE AS prominence FROM base WHERE n - base >= 5")
def prominent_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of a grey histogram, thinned by distance and prominence."""
    h = stats.histogram(table(spark, d, "lineitem"), F.col("l_extendedprice"), 900.0, 105_000.0, 128, []).withColumn("scan", F.lit(0))
    return s.find_peaks(h, "bin", "n", ["scan"], 10, 4, 5.0)


_KNOTS = "knots AS (SELECT user_id % 20 AS key, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS t, max(value) AS v FROM events GROUP BY 1, 2), grid AS (SELECT key, 30 * g AS t FROM (SELECT DISTINCT key FROM knots), range(48) r(g))"


@query(f"WITH {_KNOTS} SELECT g.key, g.t, round(CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * ((g.t - x0)::DOUBLE / (x1 - x0)) END, 6) AS v FROM grid g LEFT JOIN LATERAL (SELECT t AS x0, v AS y0 FROM knots k WHERE k.key = g.key AND k.t <= g.t ORDER BY k.t DESC LIMIT 1) a ON true LEFT JOIN LATERAL (SELECT t AS x1, v AS y1 FROM knots k WHERE k.key = g.key AND k.t >= g.t ORDER BY k.t LIMIT 1) b ON true")
def interp_join(spark: SparkSession, d: str) -> DataFrame:
    """Values on a grid, linear between the knots beside each point and clamped at the ends."""
    ev = table(spark, d, "events").select((F.col("user_id") % 20).alias("key"), (F.hour("ts") * 60 + F.minute("ts")).cast("long").alias("t"), F.col("value").alias("v"))
    grid = ev.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1410).cast("long"), F.lit(30).cast("long"))).alias("t"))
    return s.interpolate(grid, ev, "t", "v", ["key"]).select("key", "t", r6(F.col("v")).alias("v"))


@query(f"WITH {GRAINS}, e AS (SELECT min(z) AS lo, max(z) AS hi FROM grains), b AS (SELECT id, uz, least(floor((z - lo) / ((hi - lo) / 12)), 11)::INTEGER AS band FROM grains, e), m AS (SELECT *, count(*) OVER (PARTITION BY band) AS n, median(uz) OVER (PARTITION BY band) AS m FROM b) SELECT id, band, round(CASE WHEN n > 20 THEN uz - m ELSE uz END, 6) AS uz FROM m")
def layer_relative(spark: SparkSession, d: str) -> DataFrame:
    """Displacement less its height band's median, where the band has more than 20 members."""
    own = grains(spark, d)
    e = own.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    banded = own.crossJoin(F.broadcast(e)).withColumn("band", stats.bin_of(F.col("z"), F.col("lo"), F.col("hi"), 12))
    m = banded.groupBy("band").agg(F.count("*").alias("n")).join(stats.exact_summary(banded, {"m": ("uz", 0.5)}, ["band"]), "band")
    return banded.join(m, "band").select("id", "band", r6(F.when(F.col("n") > 20, F.col("uz") - F.col("m")).otherwise(F.col("uz"))).alias("uz"))


@query("SELECT l_orderkey % 100 AS key, l_partkey AS id, round(sum(l_quantity) OVER (PARTITION BY l_orderkey % 100 ORDER BY l_extendedprice, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING), 4) AS run FROM lineitem")
def running_sum(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("key"), F.col("l_partkey").alias("id"), "l_extendedprice", F.struct("l_partkey", "l_suppkey", "l_quantity").alias("tie"), F.col("l_quantity").alias("v"))
    return s.running_total(own, "l_extendedprice", "tie", F.col("v"), "run", ["key"]).select("key", "id", F.round("run", 4).alias("run"))


@query("WITH o AS (SELECT o_custkey % 50 AS specimen, o_orderkey AS scan, o_totalprice AS v FROM orders) SELECT specimen, scan, lead(scan) OVER w AS next_scan, round(lead(v) OVER w - v, 4) AS step FROM o WINDOW w AS (PARTITION BY specimen ORDER BY scan)")
def scan_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Each scan with the next of its specimen."""
    w = Window.partitionBy("specimen").orderBy("scan")
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("specimen"), F.col("o_orderkey").alias("scan"), F.col("o_totalprice").alias("v"))
    return o.select("specimen", "scan", F.lead("scan").over(w).alias("next_scan"), F.round(F.lead("v").over(w) - F.col("v"), 4).alias("step"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/]+)', 1) AS host, length(html) AS n, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def parse_records(spark: SparkSession, d: str) -> DataFrame:
    """Fields out of text by regular expressions."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.length("html").cast("long").alias("n"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def parse_json_props(spark: SparkSession, d: str) -> DataFrame:
    """Nested text into one row per field."""
    ev = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return ev.select("event_id", F.explode("m").alias("k", "v"))


@query("SELECT user_id % 10 AS k, printf('%-8s & %8.2f & %d', event_type, round(sum(value), 2), count(*)) AS line FROM events GROUP BY user_id % 10, event_type")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-width text of a table's rows."""
    g = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("k"), "event_type").agg(F.round(F.sum("value"), 2).alias("v"), F.count("*").alias("n"))
    return g.select("k", F.format_string("%-8s & %8.2f & %d", "event_type", "v", "n").alias("line"))
