"""Object tables, voxels, networks and series made from the test tables, in Spark and in SQL.

The volumes that the operators were made for aren't at hand, so relations of the same shape are derived from
``lineitem``, ``embeddings`` and ``events``. Both versions use the same arithmetic, so doubles agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.operators.series import running_total
from voxloom.scratch import Scratch

#: Grey levels between the phases of the voxels made from lineitem, and edge of the blocks that label their bodies.
AIR_ICE, ICE_GRAIN = 25_000.0, 45_000.0
BLOCK = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with radius, displacement and label; even ids are scan 0, odd ones scan 1."""
    e = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), e(0).alias("z"), e(1).alias("y"), e(2).alias("x"), (F.abs(e(3)) * 0.05 + 0.02).alias("r"), (e(4) * 0.01).alias("uz"), (e(5) * 0.01).alias("uy"), (e(6) * 0.01).alias("ux"), "label", (F.col("vec_id") % 2).alias("scan"))


GRAINS = "grains AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS z, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS x, abs(embedding[4]::DOUBLE) * 0.05::DOUBLE + 0.02::DOUBLE AS r, embedding[5]::DOUBLE * 0.01::DOUBLE AS uz, embedding[6]::DOUBLE * 0.01::DOUBLE AS uy, embedding[7]::DOUBLE * 0.01::DOUBLE AS ux, label, vec_id % 2 AS scan FROM embeddings)"


def throats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between pairs of bodies; a missing q where no crack was measured."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("S"), (F.col("l_orderkey") % 9).cast("string")).alias("specimen"), (F.col("l_linenumber") % 2 + 1).alias("scan"), F.col("l_partkey").alias("bead_a"), (F.col("l_suppkey") + 1_000_000).alias("bead_b"),
        (F.col("l_quantity") / 3.0).alias("gap_vox"), (F.col("l_quantity") / 4.0).alias("dsum_min"), (F.col("l_extendedprice") / 100.0).alias("crack_vox"), (F.col("l_discount") * 10.0).alias("crack_frac"),
        (F.col("l_tax") * 12.5).alias("cover_a"), (F.col("l_discount") * 10.0).alias("cover_b"), F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 6.0).alias("q_crack"), (F.col("l_linestatus") == "O").alias("connected"),
        "l_orderkey", "l_linenumber",
    )


THROATS = "throats AS (SELECT 'S' || (l_orderkey % 9) AS specimen, l_linenumber % 2 + 1 AS scan, l_partkey AS bead_a, l_suppkey + 1000000 AS bead_b, l_quantity / 3.0::DOUBLE AS gap_vox, l_quantity / 4.0::DOUBLE AS dsum_min, l_extendedprice / 100.0::DOUBLE AS crack_vox, l_discount * 10.0::DOUBLE AS crack_frac, l_tax * 12.5::DOUBLE AS cover_a, l_discount * 10.0::DOUBLE AS cover_b, CASE WHEN l_returnflag <> 'N' THEN l_tax * 6.0::DOUBLE END AS q_crack, l_linestatus = 'O' AS connected, l_orderkey, l_linenumber FROM lineitem)"


def voxels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(scan, z, y, x, grey, phase, label) with a voxel for each row of lineitem, in the rows' order, and the edge of its two cubes, which
    grows with the number of rows; the last slices may be cut short. Grains are labelled by blocks. Written once: operators read it several times."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_extendedprice").alias("tie"), F.col("l_extendedprice").alias("grey"))
    n, edge = li.count(), 1
    while 2 * edge**3 < n:
        edge += 1
    k = F.col("n") - 1
    at = F.floor(k / 2)
    axes = [F.floor(at / edge**2), F.floor(at / edge) % edge, at % edge]
    vox = running_total(li, "l_orderkey", "tie", F.lit(1), "n").select((k % 2).cast("int").alias("scan"), *[v.cast("int").alias(a) for v, a in zip(axes, "zyx", strict=True)], "grey")
    wide = -(-edge // BLOCK)
    block = ((F.floor(F.col("z") / BLOCK) * wide + F.floor(F.col("y") / BLOCK)) * wide + F.floor(F.col("x") / BLOCK) + 1).cast("int")
    vox = vox.withColumn("phase", F.when(F.col("grey") < AIR_ICE, 1).when(F.col("grey") < ICE_GRAIN, 2).otherwise(3))
    vox = vox.withColumn("label", F.when(F.col("phase") == 3, block).otherwise(0))
    return Scratch(spark, "voxels").put(vox, "voxels"), edge


VOXELS = "size AS (SELECT min(e) AS edge FROM range(1, 5000) t(e) WHERE 2 * e * e * e >= (SELECT count(*) FROM lineitem)), placed AS (SELECT k % 2 AS scan, k // 2 AS pos, grey FROM (SELECT l_extendedprice AS grey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS k FROM lineitem)), voxels AS MATERIALIZED (SELECT *, CASE WHEN phase = 3 THEN (((z // 8) * ((edge + 7) // 8) + y // 8) * ((edge + 7) // 8) + x // 8 + 1)::INTEGER ELSE 0 END AS label FROM (SELECT scan::INTEGER AS scan, (pos // (edge * edge))::INTEGER AS z, (pos // edge % edge)::INTEGER AS y, (pos % edge)::INTEGER AS x, edge, grey, CASE WHEN grey < 25000 THEN 1 WHEN grey < 45000 THEN 2 ELSE 3 END AS phase FROM placed, size))"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan, a, b, thick): two networks over the same kinds of nodes."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 2).alias("scan"), F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000).alias("b")).agg(F.max(F.col("l_extendedprice") / 100.0).alias("thick"))


EDGES = "edges AS (SELECT l_orderkey % 2 AS scan, l_partkey AS a, l_suppkey + 1000000 AS b, max(l_extendedprice / 100.0::DOUBLE) AS thick FROM lineitem GROUP BY 1, 2, 3)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, pos, value): a user's events in order, as a profile along an axis."""
    ev = table(spark, sf_dir, "events")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(F.col("user_id").alias("key"), (F.row_number().over(by) - 1).alias("pos"), "value")


SERIES = "series AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value FROM events)"
