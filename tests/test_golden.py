"""Published rows and identities, transcribed: what the operators have to give back."""

import json

import pytest
from pyspark.sql import functions as F

from voxloom.functions import geometry as g
from voxloom.operators import series
from voxloom.sources import tables

#: Largest-cluster p by specimen and its adjusted value.
ADJUSTED = [("G1", 0.6875, 1.0), ("G2", 0.8925, 1.0), ("G3", 0.0, 0.0), ("G4", 0.9225, 1.0), ("G5", 0.4025, 1.0), ("A1", 0.8575, 1.0), ("A2", 0.995, 1.0), ("A3", 0.78, 1.0), ("A4", 1.0, 1.0)]
#: Specimen, stage, porosity, specific surface per mm, permeability in square metres.
CORE = [
    ("A1", 1, 0.09280559027246296, 1.9474125944023883, 1.1709381561994622e-12), ("A1", 2, 0.09470297006812463, 2.353050060863732, 8.522283158242308e-13), ("A1", 3, 0.15062118413792527, 3.176569362463548, 1.8813473319631833e-12),
    ("A2", 1, 0.10440514116197774, 1.9158064448929688, 1.7226216048683518e-12), ("A2", 2, 0.16054504820869195, 2.867317727478447, 2.7961894964601053e-12), ("A3", 1, 0.08013994590295931, 1.9564435665605497, 7.470333305071254e-13),
]
#: Specimen, scan, gaps, and its classes void, surface, body and separation in cubic mm.
VOLUMES = [("A1", 1, 120.02, 55.74, 12.17, 26.79, 25.32), ("A1", 2, 109.2, 61.71, 9.65, 20.33, 17.51), ("A1", 3, 149.27, 45.69, 33.2, 36.79, 33.59), ("A2", 1, 145.14, 46.46, 21.73, 39.79, 37.16), ("A2", 2, 284.89, 22.65, 103.04, 75.46, 83.75)]
#: Specimen, scan, grains, bonds, coordination.
BONDS = [("G1", "last", 355, 976, 5.5), ("G1", "first", 365, 1364, 7.47), ("G2", "last", 252, 706, 5.6), ("G2", "first", 302, 1023, 6.77), ("G3", "last", 351, 910, 5.19), ("G3", "first", 375, 1367, 7.29)]
#: Specimen, answerable, then cohesive and adhesive at 0.5, 0.7, 0.8 and 0.9.
MODES = [
    ("G1", 60, 53, 7, 30, 30, 16, 44, 8, 52), ("G2", 14, 7, 7, 4, 10, 2, 12, 0, 14), ("G3", 30, 2, 28, 0, 30, 0, 30, 0, 30), ("G4", 12, 6, 6, 4, 8, 2, 10, 0, 12), ("G5", 28, 8, 20, 2, 26, 1, 27, 1, 27),
    ("A1", 27, 20, 7, 15, 12, 12, 15, 9, 18), ("A2", 50, 27, 23, 19, 31, 17, 33, 10, 40), ("A3", 178, 80, 98, 20, 158, 5, 173, 0, 178), ("A4", 32, 19, 13, 12, 20, 8, 24, 3, 29),
]
MODES_ALL = (431, 222, 209, 106, 325, 63, 368, 31, 400)
#: One scan's cubes: height, share, axial tau, diffusivities.
CUBES = [(0.27871621621621623, 0.37328290939331055, 1.7343589426735284, [7.034053012431032e-05, -0.0039852529406041405, 0.21522817463488378]), (0.5, 0.3635106086730957, 1.8069967912412566, [0.004990464885361903, 0.0021156171969974446, 0.20116837530375145]), (0.7195945945945946, 0.3642730712890625, 1.7433167367252724, [-0.0013837392551987336, -0.0010155690513060107, 0.20895403779196778])]


def test_adjusted_p(spark):
    df = spark.createDataFrame([(i, p) for i, p, _ in ADJUSTED], "id string, p double")
    got = {r["id"]: round(r["p_bh"], 3) for r in series.benjamini_hochberg(df, "p", "id").collect()}
    assert got == {i: v for i, _, v in ADJUSTED}


def test_permeability(spark):
    """The published column has the constant 180 of the grain-diameter form; with 5 every value is 36 times as large."""
    df = spark.createDataFrame(CORE, "id string, stage int, eps double, sv double, k double")
    for r in df.select("k", g.kozeny_carman(F.col("eps"), F.col("sv") * 1000, 180.0).alias("mine")).collect():
        assert r["mine"] == pytest.approx(r["k"], rel=1e-12, abs=0)


def test_gap_classes_add_up(spark):
    df = spark.createDataFrame(VOLUMES, "id string, scan int, gaps double, v double, s double, b double, p double")
    assert df.where(F.abs(F.col("gaps") - (F.col("v") + F.col("s") + F.col("b") + F.col("p"))) > 0.0101).count() == 0


def test_coordination(spark):
    df = spark.createDataFrame(BONDS, "id string, which string, grains int, bonded int, z double")
    assert all(r["mine"] == r["z"] for r in df.select("z", F.bround(2 * F.col("bonded") / F.col("grains"), 2).alias("mine")).collect())


def test_modes_total(spark):
    names = ["n", "c5", "a5", "c7", "a7", "c8", "a8", "c9", "a9"]
    df = spark.createDataFrame(MODES, "id string, " + ", ".join(f"{n} int" for n in names))
    total = df.rollup("id").agg(*[F.sum(n).alias(n) for n in names]).where("id is null").first()
    assert tuple(total[n] for n in names) == MODES_ALL


def test_cubes(spark, tmp_path):
    cubes = [{"z_frac": z, "phi_ice": p, "tau_z": t, "Deff": d, "tau": [0.0, 0.0, t], "ok": True, "error": None} for z, p, t, d in CUBES]
    (tmp_path / "c.json").write_text(json.dumps({"tag": "A1_1", "cubes": cubes}))
    r = tables.accepted_cubes(tables.read_cubes(spark, f"file://{tmp_path}/c.json")).first()
    assert (r["n_ok"], r["tau"], r["tau_sd"]) == (3, pytest.approx(1.7615574902133524, rel=1e-12), pytest.approx(0.032337883635108526, rel=1e-9))
