"""Rows whose keys are missing stay, as they do in SQL's windows and groups."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.operators import series, stats


@pytest.fixture(scope="module")
def data(spark):
    draw = random.Random(4)
    key = lambda values: draw.choice([None, *values])
    rows = [(i, key(["a", "b"]), key([1, 2]), None if draw.random() < 0.1 else round(draw.random() * 20) / 4, draw.random()) for i in range(300)]
    rows += [(300, None, None, 1.0, 0.5), (301, "c", None, None, 0.25)]
    df = spark.createDataFrame(rows, "id long, k string, m long, x double, p double")
    con = duckdb.connect()
    con.register("t", pd.DataFrame(rows, columns=["id", "k", "m", "x", "p"]).astype({"m": "Int64", "x": "Float64"}))
    return df, con


def same(df, con, sql):
    clean = lambda rows: sorted((tuple(None if v is None or v != v else round(v, 7) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    got, want = clean(map(tuple, df.collect())), clean(con.execute(sql).fetchall())
    assert got == want and want


KEYS = ["k", "m"]


def test_running_total(data):
    df, con = data
    got = series.running_total(df, "x", "id", F.col("p"), "run", KEYS).select("id", "run")
    same(got, con, "SELECT id, sum(p) OVER (PARTITION BY k, m ORDER BY x NULLS FIRST, id) FROM t")


def test_cumulative_share(data):
    df, con = data
    got = stats.cumulative_q3(df, "x", "id", F.col("p"), KEYS).select("id", "q3")
    same(got, con, "SELECT id, 100 * sum(p) OVER (PARTITION BY k, m ORDER BY x NULLS FIRST, id) / sum(p) OVER (PARTITION BY k, m) FROM t")


def test_adjusted_p(data):
    df, con = data
    got = series.benjamini_hochberg(df, "p", "id", KEYS).select("id", "p_bh")
    same(got, con, """WITH r AS (SELECT *, p * count(*) OVER (PARTITION BY k, m) / row_number() OVER (PARTITION BY k, m ORDER BY p, id) AS s FROM t)
        SELECT id, least(1.0, min(s) OVER (PARTITION BY k, m ORDER BY p DESC, id DESC)) FROM r""")


def test_percentiles(data):
    df, con = data
    got = stats.exact_percentiles(df, "x", [0.1, 0.5], KEYS)
    same(got, con, "SELECT k, m, 0.1::DOUBLE, quantile_cont(x, 0.1) FROM t WHERE x IS NOT NULL GROUP BY k, m UNION ALL SELECT k, m, 0.5, quantile_cont(x, 0.5) FROM t WHERE x IS NOT NULL GROUP BY k, m")
    got = stats.exact_summary(df, {"a": ("x", 0.5), "b": ("p", 0.9), "c": ("x", 0.0), "d": ("x", 1.0)}, KEYS)
    same(got, con, "SELECT k, m, quantile_cont(x, 0.5), quantile_cont(p, 0.9), min(x), max(x) FROM t GROUP BY k, m")
    whole = stats.exact_summary(df, {"a": ("x", 0.25), "b": ("p", 0.75)})
    same(whole, con, "SELECT quantile_cont(x, 0.25), quantile_cont(p, 0.75) FROM t")
    assert [tuple(r) for r in stats.exact_summary(df.limit(0), {"a": ("x", 0.5)}).collect()] == [(None,)]
    assert stats.exact_summary(df.limit(0), {"a": ("x", 0.5)}, KEYS).count() == 0 and stats.exact_percentiles(df.limit(0), "x", [0.5]).count() == 0


def test_histogram(data):
    df, con = data
    got = stats.histogram(df, F.col("x"), 0.0, 4.0, 2, KEYS)
    same(got, con, "SELECT k, m, b, count(*) FILTER (x BETWEEN 0 AND 4 AND least(floor(x / 2), 1) = b) FROM t, (VALUES (0), (1)) v(b) GROUP BY k, m, b")


def test_moments(data):
    df, con = data
    got = stats.weighted_moments(df.where("x is not null"), "x", "p", KEYS).select(*KEYS, "mean", "ra")
    same(got, con, """WITH c AS (SELECT *, sum(x * p) OVER w / sum(p) OVER w AS mean FROM t WHERE x IS NOT NULL WINDOW w AS (PARTITION BY k, m))
        SELECT k, m, any_value(mean), sum(p * abs(x - mean)) / sum(p) FROM c GROUP BY k, m""")


def test_interpolation(spark):
    knots = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 4.0), (None, 0.0, 10.0), (None, 1.0, 20.0), (None, None, 5.0), ("a", 1.0, None)], "k string, x double, y double")
    ask = spark.createDataFrame([(1, "a", 1.0), (2, None, 0.5), (3, None, 9.0), (4, "z", 1.0), (5, None, None)], "id long, k string, x double")
    got = {r["id"]: r["y"] for r in series.interpolate(ask, knots, "x", "y", ["k"]).collect()}
    assert got == {1: 2.0, 2: 15.0, 3: 20.0, 4: None, 5: None}


def test_draws(data):
    df, _ = data
    want = spark_want = df.groupBy("k").agg((F.count("*") / 2).cast("int").alias("want"))
    got = stats.stratified(df, spark_want, "k", 3, "id", 5)
    counts = {(r["replica"], r["k"]): r["n"] for r in got.groupBy("replica", "k").agg(F.count("*").alias("n")).collect()}
    assert counts == {(i, r["k"]): r["want"] for i in range(3) for r in want.collect() if r["want"]}


def test_joint_p_and_upsert(spark):
    seen = spark.createDataFrame([(None, 2.0), ("a", 2.0)], "k string, v double")
    null = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 1.0), ("a", 1.0)], "k string, v double")
    assert {r["k"]: r["p"] for r in stats.joint_tail_p(null, seen, ["v"], ["k"]).collect()} == {None: 0.5, "a": 1 / 3}
    done = stats.upsert(seen, spark.createDataFrame([(None, 7.0)], "k string, v double"), ["k"])
    assert sorted(map(tuple, done.collect()), key=str) == sorted([(None, 7.0), ("a", 2.0)], key=str)
