"""Round trips of readers and writers, and scans as a stream."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.sources import sinks, tables, volumes
from voxloom.sources.volume_source import open_volumes
from voxloom.streaming import scans


def test_correlation_and_delimited(spark, tmp_path):
    names = "NodeNumber Zpos Ypos Xpos Fzz Fzy Fzx Zdisp Fyz Fyy Fyx Ydisp Fxz Fxy Fxx Xdisp error iterations returnStatus deltaPhiNorm".split()
    rows = [[1, 1, 2, 3, 1, 0, 0, 0.5, 0, 1, 0, 0.25, 0, 0, 1, 0.125, 10, 3, 2, 0.001], [2, 1, 2, 3, 1, 0, 0, "NaN", 0, 1, 0, 0, 0, 0, 1, 0, 10, 3, 2, 0], [3, 1, 2, 3, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 10, 3, -1, 0], [4, 1, 2, 3, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 9e4, 3, 2, 0]]
    p = tmp_path / "a.tsv"
    p.write_text("\n".join("\t".join(map(str, r)) for r in [names, *rows]))
    assert [r["id"] for r in tables.read_correlation(spark, f"file://{p}", 25_000).collect()] == [1]
    q = tmp_path / "b_03.csv"
    q.write_text("id;v\n1;2.5\nx;y\n3;\n")
    got = tables.read_csv(spark, f"file://{q}", "id int, v double", ";", strict=False).collect()
    assert [tuple(r) for r in got] == [(1, 2.5), (3, None)]
    keyed = tables.read_glob(spark, f"file://{tmp_path}/b_*.csv", "id string, v string", "scan", r"_(\d+)\.csv", ";").collect()
    assert {r["scan"] for r in keyed} == {"03"}


def test_nested_records_reports_archives(spark, tmp_path):
    cube = lambda t, d: {"z_frac": 0.5, "phi_ice": 0.4, "tau_z": t, "Deff": [-1.0, 0.0, d], "tau": [0.0, 0.0, t], "ok": True, "error": None}
    (tmp_path / "c.json").write_text(json.dumps({"tag": "A", "cube_vox": 8, "cubes": [cube(1.5, 0.2), cube(0.5, 0.2), cube(2.5, 0.1)]}, indent=1))
    r = tables.accepted_cubes(tables.read_cubes(spark, f"file://{tmp_path}/c.json")).first()
    assert (r["n_cubes"], r["n_ok"], r["tau"], r["tau_sd"]) == (3, 2, 2.0, 0.5)
    (tmp_path / "s.prm").write_bytes("kV=80\nName= éx \r\nBAD\n".encode("latin-1"))
    assert tuple(tables.read_keyvalues(spark, f"file://{tmp_path}/s.prm", ["kV", "Name", "mA"]).select("kV", "Name", "mA").first()) == ("80", "éx", None)
    (tmp_path / "r.txt").write_text("scan vol\n---\n 1  2.5\n 2  3.5 x\n 3 4\n")
    assert [(r["scan"], r["vol"]) for r in tables.read_report(spark, f"file://{tmp_path}/r.txt", ["scan", "vol"], {"scan": "int"}).collect()] == [(1, 2.5), (3, 4.0)]
    np.savez(tmp_path / "n.npz", id=np.arange(3), com=np.arange(9.0).reshape(3, 3))
    got = tables.read_npz(spark, f"file://{tmp_path}/n.npz", {"id": "long", "com": "array<double>"}).orderBy("row").collect()
    assert [(r["id"], r["com"]) for r in got] == [(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0]), (2, [6.0, 7.0, 8.0])]


def test_size_classes(spark, tmp_path):
    for k, extra in ((1, 0.0), (2, 10.0)):
        (tmp_path / f"s{k}.xle").write_bytes(f"head\nSize class [mm]\nmn\tmx\tp3\n0\t1\t{40 + extra}\n1\t2\t{60 - extra}\n\nend".encode("utf-16"))
    got = tables.read_size_classes(spark, f"file://{tmp_path}/*.xle")
    assert sorted((r["mx"], r["q3"]) for r in got.collect()) == [(1.0, 40.0), (1.0, 50.0), (2.0, 100.0), (2.0, 100.0)]
    grid = spark.createDataFrame([(1.0,), (1.5,), (3.0,)], "mx double")
    assert sorted((r["mx"], r["q3"]) for r in tables.averaged_replicates(got, grid).collect()) == [(1.0, 45.0), (1.5, 72.5), (3.0, 100.0)]


def test_registry(spark):
    reg = tables.registry(spark, {"A": {"folder": "a", "scans": (3, 1), "thresholds": {3: 0.5}}, "B": {"scans": (1,)}})
    assert [(r["specimen"], r["scan"], r["next_scan"]) for r in tables.transitions(reg).orderBy("specimen", "step").collect()] == [("A", 3, 1), ("A", 1, None), ("B", 1, None)]
    with pytest.raises(KeyError):
        tables.registry(spark, {"A": {}}, "C")


@pytest.mark.parametrize("deflate", [True, False])
def test_tiff(spark, tmp_path, deflate):
    v = np.arange(4 * 5 * 6, dtype=np.uint16).reshape(4, 5, 6)
    (tmp_path / "v.tif").write_bytes(volumes.tiff_encode(v, deflate))
    pages = open_volumes(spark, f"file://{tmp_path}/v.tif")
    got = {(r["z"], r["y"], r["x"]): r["value"] for r in pages.collect()}
    assert got == {at: float(v[at]) for at in np.ndindex(v.shape)}
    assert volumes.cropped(pages, z=(1, 2), x=(0, 0)).count() == 10
    for z in range(4):
        (tmp_path / f"sl_{z:04d}.tif").write_bytes(volumes.tiff_encode(v[z : z + 1], deflate))
    some = volumes.read_slices(spark, f"file://{tmp_path}/sl_*.tif", step=2)
    assert sorted(r["z"] for r in some.collect()) == [0, 2]
    volumes.write_volume(some, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
    assert volumes.label_type(65_534) == "u2" and volumes.label_type(65_535) == "u4"


def test_sinks(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    a = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 3.0)], "specimen string, scan int, v double")
    sinks.write_upsert(spark, a, at, ["specimen", "scan"], "specimen")
    sinks.write_upsert(spark, spark.createDataFrame([("A", 2, 9.0), ("A", 3, 4.0)], a.schema), at, ["specimen", "scan"], "specimen")
    assert sorted((r["specimen"], r["scan"], r["v"]) for r in spark.read.parquet(at).collect()) == [("A", 1, 1.0), ("A", 2, 9.0), ("A", 3, 4.0), ("B", 1, 3.0)]
    calls = []
    for _ in range(2):
        assert sinks.cached(spark, f"file://{tmp_path}/c", lambda: calls.append(1) or a).count() == 3
    assert calls == [1]
    text = sinks.latex_table(a.withColumn("v", F.when(F.col("scan") == 1, F.col("v"))), ["id", "v"], [F.col("specimen"), F.col("v")], [F.col("specimen"), F.col("scan")])
    assert "A & 1.0 \\\\\nA & -- \\\\\nB & 3.0 \\\\" in text
    sinks.write_report(a.coalesce(1), f"file://{tmp_path}/r", [8, 10], [F.col("scan"), F.col("v")], 1)
    assert spark.read.text(f"file://{tmp_path}/r").orderBy("value").first()["value"] == "     1.0       1.0"
    sinks.write_sheets({"one": a}, f"file://{tmp_path}/s")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/s/one").count() == 3
    vox = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 1)], "scan int, z int, y int, x int")
    r = sinks.write_stl(sinks.face_triangles(vox), f"file://{tmp_path}/m").first()
    raw = open(r["path"], "rb").read()
    assert r["triangles"] == 20 and struct.unpack("<I", raw[80:84])[0] == 20 and len(raw) == 84 + 50 * 20
    assert tables.first_existing(spark, [f"file://{tmp_path}/no", at]) == at


def test_stream(spark, tmp_path):
    ddl = "specimen string, scan int, cover_a double, cover_b double, gap_vox double"
    rows = [("A", 1, 0.9, 0.9, 1.0), ("A", 1, 0.1, 0.9, 3.0), ("B", 1, 0.9, 0.8, 2.0)]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"file://{tmp_path}/in/1")
    spark.createDataFrame([("A", 2, 0.9, 0.9, 5.0)], ddl).coalesce(1).write.parquet(f"file://{tmp_path}/in/2")
    stream = scans.object_stream(spark, f"file://{tmp_path}/in/*", ddl)
    scans.keep_summary(scans.running_census(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination(120)
    got = {(r["specimen"], r["scan"]): (r["n"], r["cohesive"], r["gap_mean"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {("A", 1): (2, 1, 2.0), ("B", 1): (1, 1, 2.0), ("A", 2): (1, 1, 5.0)}


def test_changes_with_state(spark, tmp_path):
    ddl = "specimen string, scan int, value double"
    spark.createDataFrame([("A", 1, 1.0), ("A", 2, 4.0), ("B", 1, 2.0)], ddl).coalesce(1).write.parquet(f"file://{tmp_path}/in/1")
    q = scans.scan_changes(scans.object_stream(spark, f"file://{tmp_path}/in/*", ddl)).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    q.processAllAvailable()
    spark.createDataFrame([("A", 3, 2.0), ("A", 2, 9.0)], ddl).coalesce(1).write.parquet(f"file://{tmp_path}/in/2")
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("select specimen, scan, step, change from changes").collect() if r["step"] is not None)
    assert got == [("A", 2, 3.0, 3.0), ("A", 3, -2.0, 1.0)]
