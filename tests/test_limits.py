"""Round limits lose nothing: searches end exactly, or with an error."""

import pytest
from pyspark.sql import functions as F

from voxloom.operators import graph, neighbours, spatial


def test_knn_reaches_a_far_outlier(spark):
    rows = [(k, 0.0, 0.0, 1e-4 * k) for k in range(6)] + [(6, 0.0, 0.0, 1e6)]
    df = spark.createDataFrame(rows, "id long, z double, y double, x double")
    got = neighbours.knn_join(df, df, 2, skip_self=True).collect()
    assert len(got) == 14
    assert [r["b"] for r in sorted((r for r in got if r["a"] == 6), key=lambda r: r["rank"])] == [5, 4]


def test_matching_stops_with_an_error(spark):
    chain = spark.createDataFrame([(k // 2 + k % 2, 100 + k // 2, 1.0 + k) for k in range(8)], "a long, b long, d double")
    n = spatial.injective_match(chain).count()
    assert n == spatial.injective_match(chain, max_rounds=n).count() == 4
    with pytest.raises(RuntimeError, match="left after 1 rounds"):
        spatial.injective_match(chain, max_rounds=1)


def test_paths_stop_with_an_error(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(5)], "a long, b long").withColumn("w", F.lit(1.0))
    assert graph.shortest_paths(spark.range(6), links, spark.range(1), max_rounds=5).count() == 6
    with pytest.raises(RuntimeError, match="after 4 rounds"):
        graph.shortest_paths(spark.range(6), links, spark.range(1), max_rounds=4)


def test_rounds_of_neighbours_follow_the_tree(spark, monkeypatch):
    """61 points, one of them far away: the tree is gone down once, whatever the distance."""
    rows = [(k, 0.0, 1e-3 * (k % 7), 1e-4 * k) for k in range(60)] + [(60, 0.0, 0.0, 1e6)]
    df = spark.createDataFrame(rows, "id long, z double, y double, x double")
    tables = []
    put = neighbours.Scratch.put
    monkeypatch.setattr(neighbours.Scratch, "put", lambda self, frame, name: tables.append(name) or put(self, frame, name))
    got = neighbours.knn_join(df, df, 3, skip_self=True).collect()
    assert len(got) == 183 and sum(t.startswith("open") for t in tables) <= neighbours.LEVELS + 1
