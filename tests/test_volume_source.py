"""Random access to volumes: what a box doesn't touch may be missing or spoilt."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringContains

from voxloom.sources import volumes
from voxloom.sources.volume_source import Box, VolumeReader, index_pages, open_volumes


def cells(df):
    return {(r["scan"], r["z"], r["y"], r["x"]): r["value"] for r in df.collect()}


def of(v, scan, z=slice(None), y=slice(None), x=slice(None)):
    inside = np.zeros(v.shape, bool)
    inside[z, y, x] = True
    return {(scan, *map(int, at)): float(v[tuple(at)]) for at in np.argwhere(inside)}


@pytest.fixture
def volume():
    return np.random.default_rng(5).integers(1, 60_000, (6, 9, 7)).astype(np.uint16)


def test_a_box_of_one_chunk_opens_one(spark, tmp_path, volume):
    folder = f"file://{tmp_path}/stores"
    rows = [(s, *map(int, at), float(volume[tuple(at)]) + s - 3) for s in (3, 4) for at in np.ndindex(volume.shape)]
    vox = spark.createDataFrame(rows, "scan int, z int, y int, x int, v double")
    assert volumes.write_zarr(vox, "v", volume.shape, folder, 3) == 2 * 2 * 3 * 3
    assert cells(open_volumes(spark, folder, "zarr")) == of(volume, 3) | {k: v + 1 for k, v in of(volume, 4).items()}
    for path in (tmp_path / "stores").glob("*/*"):
        if str(path.relative_to(tmp_path / "stores")) != "scan0003/1.0.2" and path.name != ".zarray":
            path.write_bytes(b"spoilt")
    box = open_volumes(spark, folder, "zarr").where("scan = 3 and z > 2 and z <= 5 and y in (0, 1, 2) and x >= 6")
    assert cells(box) == of(volume, 3, slice(3, 6), slice(0, 3), slice(6, 7))
    box = open_volumes(spark, folder, "zarr", scan="3:3", z="4:4", y="1:2", x="6:99")
    assert cells(box) == of(volume, 3, slice(4, 5), slice(1, 3), slice(6, 7))
    reader = VolumeReader({"path": folder, "layout": "zarr"})
    assert reader.pushFilters([EqualTo(("scan",), 3), EqualTo(("z",), 4), EqualTo(("y",), 1), GreaterThan(("x",), 5)]) == []
    assert [[i["at"] for i in p.items] for p in reader.partitions()] == [[(1, 0, 2)]]
    with pytest.raises(Exception, match="(?i)decompress|incorrect header"):
        open_volumes(spark, folder, "zarr").count()


@pytest.mark.parametrize("indexed", [False, True])
def test_a_box_reads_its_strips(spark, tmp_path, volume, indexed):
    """Pages, and strips of a page, outside of the box are spoilt after their places are known."""
    for scan in (1, 2):
        (tmp_path / f"scan{scan:04d}.tif").write_bytes(volumes.tiff_encode(volume + scan, strip=4))
    options = {"index": f"file://{tmp_path}/index"} if indexed else {}
    if indexed:
        assert index_pages(spark, f"file://{tmp_path}", options["index"]).count() == 12
    assert cells(open_volumes(spark, f"file://{tmp_path}", **options)) == of(volume + 1, 1) | of(volume + 2, 2)
    data = bytearray((tmp_path / "scan0002.tif").read_bytes())
    pages = list(volumes.tiff_pages(lambda o, n: bytes(data[o : o + n]), len(data)))
    assert [len(p["offsets"]) for p in pages] == [3] * 6
    for z, p in enumerate(pages):
        for k, (o, n) in enumerate(zip(p["offsets"], p["counts"], strict=True)):
            if (z, k) != (3, 1):
                data[o : o + n] = b"x" * n
    (tmp_path / "scan0002.tif").write_bytes(data)
    (tmp_path / "scan0001.tif").write_bytes(b"spoilt")
    box = open_volumes(spark, f"file://{tmp_path}", **options).where("scan = 2 and z = 3 and y >= 4 and y < 8 and x between 2 and 4")
    assert cells(box) == of(volume + 2, 2, slice(3, 4), slice(4, 8), slice(2, 5))
    assert open_volumes(spark, f"file://{tmp_path}", **options).where("scan = 2 and z = 77").count() == 0
    assert open_volumes(spark, f"file://{tmp_path}", **options).where("scan = 9").count() == 0


def test_slices(spark, tmp_path, volume):
    for z in (0, 2, 5):
        (tmp_path / "s07").mkdir(exist_ok=True)
        (tmp_path / "s07" / f"a_{z:03d}.tif").write_bytes(volumes.tiff_encode(volume[z : z + 1]) if z < 5 else b"spoilt")
    got = open_volumes(spark, f"file://{tmp_path}", "slices").where(F.col("z") < 5)
    assert cells(got) == of(volume, 7, [0, 2])


def test_pushdown():
    box = Box()
    assert box.take(IsNotNull(("z",))) and box.take(In(("z",), (4, 2, 3))) and box.bounds["z"] == (2, 4)
    assert not box.take(In(("y",), (1, 5))) and box.bounds["y"] == (1, 5)
    assert box.take(LessThanOrEqual(("y",), 3)) and box.bounds["y"] == (1, 3)
    assert not box.take(GreaterThan(("value",), 3)) and not box.take(StringContains(("z",), "3")) and not box.take(EqualTo(("x",), None))
    with pytest.raises(ValueError, match="layout"):
        VolumeReader({"path": "x", "layout": "other"})


def test_explained(spark, tmp_path, volume):
    """Filters on the box are the source's work, others stay in the plan."""
    (tmp_path / "1.tif").write_bytes(volumes.tiff_encode(volume))
    df = open_volumes(spark, f"file://{tmp_path}").where("z = 1 and value > 30000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "value" in plan.split("Filter", 1)[1].split("\n")[0] and "z#" not in plan.split("Filter", 1)[1].split("\n")[0].replace("isnotnull(z", "")
    assert cells(df) == {k: v for k, v in of(volume, 1, slice(1, 2)).items() if v > 30_000}
