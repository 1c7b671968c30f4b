"""Sources and sinks over whole tables: rows are written in each format into the shared folder, read back, and held against SQL on the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import bricks, grid, stats
from voxloom.plans.registry import query
from voxloom.plans.standins import VOXELS, table, voxels
from voxloom.scratch import Scratch
from voxloom.sources import sinks, tables, volumes
from voxloom.sources.volume_source import index_pages, open_volumes

_PART = "SELECT p_partkey AS id, p_retailprice AS v FROM part"


def _folder(spark: SparkSession, name: str) -> str:
    return Scratch(spark, name).path


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """(scan, z, ny, nx, payload): the voxels as whole slices of 16-bit greys; places without a voxel are 0."""
    vox, edge = voxels(spark, d)
    grey = F.least(F.floor(F.col("grey") / 2), F.lit(65_535)).cast("double")
    return volumes.paged(vox.withColumn("g", grey), "g", edge, edge), edge


_SLICES = f"WITH {VOXELS}, g AS (SELECT scan, z, floor(grey / 2) AS g FROM voxels) SELECT scan, z, sum(g)::DOUBLE AS total FROM g GROUP BY 1, 2"


def _totals(vox: DataFrame) -> DataFrame:
    return vox.groupBy("scan", "z").agg(F.sum("grey").alias("total"))


@query(_SLICES)
def tiff_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each scan as one multi-page file in strips; pages are indexed, and tasks read a few each."""
    folder = _folder(spark, "tiff")
    volumes.write_tiff(_pages(spark, d)[0], f"{folder}/scans", strip=8).count()
    index_pages(spark, f"{folder}/scans", f"{folder}/index")
    return _totals(open_volumes(spark, f"{folder}/scans", "tiff", index=f"{folder}/index").withColumnRenamed("value", "grey"))


@query(_SLICES + " HAVING scan = 1 AND z % 2 = 0")
def tiff_slices(spark: SparkSession, d: str) -> DataFrame:
    """A folder of one-page files; every second slice is read, and the others leave gaps."""
    folder = _folder(spark, "slices")
    volumes.write_slices(_pages(spark, d)[0], folder)
    return _totals(volumes.sparse(volumes.read_slices(spark, f"{folder}/0001/*.tif", scan=1, step=2)))


@query(f"WITH {VOXELS}, c AS (SELECT * FROM voxels WHERE z BETWEEN 1 AND 5 AND x BETWEEN 2 AND 4) SELECT scan, count(*) AS n, min(y) AS y0, max(y) AS y1, sum(phase)::BIGINT AS phases FROM c GROUP BY 1")
def cropped_box(spark: SparkSession, d: str) -> DataFrame:
    """A box, ends included, of chunked stores: the chunks that it touches are read, and coordinates keep their meaning."""
    folder, (vox, edge) = _folder(spark, "crop"), voxels(spark, d)
    volumes.write_zarr(vox, "phase", (edge,) * 3, folder, 16)
    box = volumes.cropped(open_volumes(spark, folder, "zarr"), z=(1, 5), x=(2, 4)).where("value > 0")
    return box.groupBy("scan").agg(F.count("*").alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum("value").cast("long").alias("phases"))


@query(f"WITH {VOXELS} SELECT scan, (z // 16)::INTEGER AS bz, (y // 16)::INTEGER AS by_, (x // 16)::INTEGER AS bx, sum(phase)::BIGINT AS total FROM voxels GROUP BY 1, 2, 3, 4")
def brick_sums(spark: SparkSession, d: str) -> DataFrame:
    """Halo bricks, written and read, with the halo cut off again."""
    vox = voxels(spark, d)[0]
    own = Scratch(spark, "bricks").put(volumes.bricked(vox, "phase", 16, 2), "bricks")
    inner = own.select("scan", "bz", "by", "bx", F.posexplode("payload").alias("i", "v")).withColumn("x", F.col("i") % 20).withColumn("y", F.floor(F.col("i") / 20) % 20).withColumn("z", F.floor(F.col("i") / 400))
    for a in "zyx":
        inner = inner.where(F.col(a).between(2, 17))
    return inner.groupBy("scan", "bz", F.col("by").alias("by_"), "bx").agg(F.sum("v").cast("long").alias("total"))


_RIMS = "spread AS (SELECT scan, grey, z // 8 AS bz, y // 8 AS by_, x // 8 AS bx, true AS core FROM voxels UNION ALL SELECT scan, grey, bz, by_, bx, false FROM (SELECT *, unnest(range((z - 2) // 8, (z + 2) // 8 + 1)) AS bz FROM (SELECT *, unnest(range((y - 2) // 8, (y + 2) // 8 + 1)) AS by_ FROM (SELECT *, unnest(range((x - 2) // 8, (x + 2) // 8 + 1)) AS bx FROM voxels))) WHERE bz >= 0 AND by_ >= 0 AND bx >= 0)"


@query(f"WITH {VOXELS}, {_RIMS.replace('(z - 2) // 8', 'floor((z - 2) / 8.0)::INTEGER').replace('(y - 2) // 8', 'floor((y - 2) / 8.0)::INTEGER').replace('(x - 2) // 8', 'floor((x - 2) / 8.0)::INTEGER')}, m AS (SELECT scan, bz, by_, bx, sum(grey) / 1728 AS mean FROM spread WHERE NOT core GROUP BY 1, 2, 3, 4) SELECT scan, bz::INTEGER AS bz, by_::INTEGER AS by_, bx::INTEGER AS bx, 512 AS cells, count(*) FILTER (grey > mean) AS solid FROM spread JOIN m USING (scan, bz, by_, bx) WHERE core GROUP BY 1, 2, 3, 4")
def brick_model(spark: SparkSession, d: str) -> DataFrame:
    """A model over halo bricks: here a threshold on the standardised grey; a class for every cell of a brick."""

    def model(v):
        import numpy as np

        return np.stack([(v <= 0).astype(float), (v > 0).astype(float)])

    halo = volumes.bricked(voxels(spark, d)[0], "grey", 8, 2, "double")
    got = bricks.predict_bricks(halo, model, 2)
    return got.select("scan", "bz", F.col("by").alias("by_"), "bx", F.size("classes").alias("cells"), F.size(F.filter("classes", lambda c: c == 1)).cast("long").alias("solid"))


@query("WITH s AS (SELECT l_linenumber AS scan, count(DISTINCT l_returnflag) AS nz, count(DISTINCT l_linestatus) AS ny, count(DISTINCT l_orderkey % 5) AS nx FROM lineitem GROUP BY 1) SELECT 'a' AS frame, count(*) AS scans, min(nz) AS nz, max(ny) AS ny, sum(nx)::BIGINT AS nx FROM s")
def frame_guard(spark: SparkSession, d: str) -> DataFrame:
    """Scans of one frame and shape pass; others raise an error."""
    shapes = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("scan")).agg(F.count_distinct("l_returnflag").alias("nz"), F.count_distinct("l_linestatus").alias("ny"), F.count_distinct(F.col("l_orderkey") % 5).alias("nx"))
    return grid.checked_frames(shapes.withColumn("frame", F.lit("a"))).groupBy("frame").agg(F.count("*").alias("scans"), F.min("nz").alias("nz"), F.max("ny").alias("ny"), F.sum("nx").alias("nx"))


@query(f"WITH {VOXELS} SELECT scan, z, count(*) AS n, sum(phase)::BIGINT AS phases, sum(phase * (1 + (y * edge + x) % 97))::BIGINT AS places FROM voxels GROUP BY 1, 2")
def volume_files(spark: SparkSession, d: str) -> DataFrame:
    """Whole slices as a table by scan, written and read; every cell's value and place count."""
    folder, (vox, edge) = _folder(spark, "volume"), voxels(spark, d)
    volumes.write_volume(volumes.paged(vox, "phase", edge, edge), folder)
    back = spark.read.parquet(folder).select(F.col("scan").cast("int").alias("scan"), "z", F.posexplode("payload").alias("at", "v")).where("v > 0")
    return back.groupBy("scan", "z").agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("phases"), F.sum(F.col("v") * (1 + F.col("at") % 97)).cast("long").alias("places"))


def _deformation(spark: SparkSession, d: str) -> DataFrame:
    """Rows in the format of correlation results, from points; some didn't converge and some have no displacement."""
    e = lambda k: F.col("embedding")[k].cast("double")
    own = {"NodeNumber": F.col("vec_id").cast("int"), "Zpos": e(0), "Ypos": e(1), "Xpos": e(2), "Zdisp": F.when(F.col("vec_id") % 7 == 0, F.lit("NaN")).otherwise(e(4).cast("string")), "Ydisp": e(5), "Xdisp": e(6), "error": F.col("label") * 5000.0, "iterations": F.lit(3), "returnStatus": F.when(F.col("vec_id") % 5 == 0, -1).otherwise(2)}
    names = [x.split()[0] for x in tables.CORRELATION.split(", ")]
    return table(spark, d, "embeddings").select(*[own.get(n, F.lit(0.0)).alias(n) for n in names])


@query("SELECT count(*) AS n, count(*) FILTER (WHERE label * 5000.0 < 25000) AS good FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 5 <> 0")
def correlation_file(spark: SparkSession, d: str) -> DataFrame:
    """Correlation results: converged rows with a finite displacement, and those with an error below the cap."""
    folder = _folder(spark, "correlation")
    _deformation(spark, d).write.mode("overwrite").option("header", True).option("sep", "\t").csv(folder)
    own = tables.read_correlation(spark, folder)
    return own.agg(F.count("*").alias("n"), F.count_if(F.col("error") < 25_000).alias("good"))


@query(_PART)
def comma_file(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "comma")
    _parts(spark, d).write.mode("overwrite").option("header", True).csv(folder)
    return tables.read_csv(spark, folder, "id long, v double")


@query(_PART)
def semicolon_file(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "semicolon")
    _parts(spark, d).write.mode("overwrite").option("header", True).option("sep", ";").csv(folder)
    return tables.read_csv(spark, folder, "id long, v double", ";")


@query("SELECT p_partkey % 5 AS scan, count(*) AS n FROM part GROUP BY 1")
def glob_union(spark: SparkSession, d: str) -> DataFrame:
    """Many folders as one relation, with a key from each path."""
    folder = _folder(spark, "glob")
    _parts(spark, d).withColumn("scan", F.col("id") % 5).write.mode("overwrite").partitionBy("scan").option("header", True).csv(folder)
    return tables.read_glob(spark, f"{folder}/scan=*/*.csv", "id long, v double", "scan", r"scan=(\d+)/").groupBy(F.col("scan").cast("long").alias("scan")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey % 10 AS file, count(*) AS n, round(sum(p_retailprice), 4) AS total, round(sum(p_size * 2.0::DOUBLE), 4) AS second FROM part GROUP BY 1")
def npz_archives(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of equal length in archives, a file per group, one of them a matrix."""
    folder = _folder(spark, "npz")
    own = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("file"), F.col("p_partkey").alias("id"), F.array("p_retailprice", F.col("p_size") * 2.0).alias("pair"))
    tables.write_npz(own, folder, "file", {"id": "long", "pair": "array<double>"}).count()
    back = tables.read_npz(spark, f"{folder}/*.npz", {"id": "long", "pair": "array<double>"})
    return back.groupBy((F.col("id") % 10).alias("file")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("pair")[0]), 4).alias("total"), F.round(F.sum(F.col("pair")[1]), 4).alias("second"))


@query("SELECT 'brands' AS sheet, p_brand AS name, count(*) AS n, round(sum(p_retailprice), 4) AS v FROM part GROUP BY 2 UNION ALL SELECT 'nations', n_name, n_nationkey, CASE WHEN n_regionkey > 0 THEN n_regionkey / 4.0 END FROM nation")
def workbook(spark: SparkSession, d: str) -> DataFrame:
    """A workbook of two published tables, written and read."""
    path = f"{_folder(spark, 'workbook')}/tables.xlsx"
    a = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 4).alias("v"))
    b = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("n"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey") / 4.0).alias("v"))
    sinks.write_workbook({"brands": a, "nations": b}, path)
    back = [tables.read_workbook(spark, path, n, "name string, n long, v double").select(F.lit(n).alias("sheet"), "name", "n", "v") for n in ("brands", "nations")]
    return back[0].unionByName(back[1])


@query("SELECT p_partkey AS id, round(p_retailprice, 3) AS v FROM part")
def report_file(spark: SparkSession, d: str) -> DataFrame:
    """A fixed-width text report, written and read; its other lines are passed over."""
    folder = _folder(spark, "report")
    sinks.write_report(_parts(spark, d), folder, [12, 16], [F.col("id"), F.col("v")], [0, 3])
    return tables.read_report(spark, folder, ["id", "v"], {"id": "long"}).select("id", "v")


@query("SELECT p_partkey % 4 AS k, round(sum(p_size) FILTER (WHERE p_size <= 10) * 100.0 / sum(p_size), 6) AS q3 FROM part GROUP BY 1")
def size_class_files(spark: SparkSession, d: str) -> DataFrame:
    """Instrument files in UTF-16: the percentage of volume up to a size."""
    folder = _folder(spark, "sizes")
    own = table(spark, d, "part").groupBy((F.col("p_partkey") % 4).alias("k"), F.col("p_size").alias("mx")).agg(F.sum("p_size").alias("p3"))
    tables.write_size_classes(own.select("k", (F.col("mx") - 1).alias("mn"), "mx", "p3"), folder, "k").count()
    back = tables.read_size_classes(spark, f"{folder}/*.xle").where("mx <= 10")
    return back.groupBy(F.regexp_extract("path", r"(\d+)\.xle", 1).cast("long").alias("k")).agg(F.round(F.max("q3"), 6).alias("q3"))


@query("SELECT 'b' AS found, count(*) AS n FROM part")
def candidate_paths(spark: SparkSession, d: str) -> DataFrame:
    """The first candidate that exists is read."""
    folder = _folder(spark, "candidates")
    _parts(spark, d).write.mode("overwrite").parquet(f"{folder}/b")
    _parts(spark, d).limit(0).write.mode("overwrite").parquet(f"{folder}/c")
    found = tables.first_existing(spark, [f"{folder}/{k}" for k in "abc"])
    return spark.read.parquet(found).agg(F.count("*").alias("n")).select(F.lit(found[-1]).alias("found"), "n")


@query("SELECT count(*) AS n, 1 AS made FROM part")
def cached_result(spark: SparkSession, d: str) -> DataFrame:
    """A result is made once; the second time its table is read."""
    path, made = f"{_folder(spark, 'cached')}/table", []
    for _ in range(2):
        got = sinks.cached(spark, path, lambda: made.append(1) or _parts(spark, d))
    return got.agg(F.count("*").alias("n")).select("n", F.lit(len(made)).alias("made"))


@query("SELECT p_partkey AS id, p_retailprice + 1 AS v, p_partkey % 3 AS k FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_retailprice, p_partkey % 3 FROM part WHERE p_partkey % 2 = 1")
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows of touched partitions replaced by key."""
    path = f"{_folder(spark, 'upsert')}/table"
    own = _parts(spark, d).withColumn("k", F.col("id") % 3)
    sinks.write_upsert(spark, own, path, ["id"], "k")
    sinks.write_upsert(spark, own.where("id % 2 = 0").withColumn("v", F.col("v") + 1), path, ["id"], "k")
    return spark.read.parquet(path).select("id", "v", F.col("k").cast("long").alias("k"))


@query("SELECT n_nationkey + 1 AS row, n_name || ' & ' || n_regionkey || ' " + "\\" * 2 + "' AS line FROM nation")
def latex_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a published table; the table itself comes to the driver by design."""
    text = sinks.latex_table(table(spark, d, "nation"), ["name", "region"], [F.col("n_name"), F.col("n_regionkey")], [F.col("n_nationkey")])
    body = text.split("\\midrule\n")[1].split("\\bottomrule")[0].strip().split("\n")
    return spark.createDataFrame([(k + 1, x) for k, x in enumerate(body)], "row int, line string")


@query(f"WITH {VOXELS}, m AS (SELECT scan, z, y, x FROM voxels WHERE phase = 3), o(dz, dy, dx) AS (VALUES (0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)), i AS (SELECT a.scan, count(*) AS c FROM m a, o, m b WHERE b.scan = a.scan AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1) SELECT scan, 2 * (6 * n - c) AS triangles FROM (SELECT scan, count(*) AS n FROM m GROUP BY 1) JOIN i USING (scan)")
def stl_meshes(spark: SparkSession, d: str) -> DataFrame:
    """Outer faces as binary meshes, a file per scan, written in parts."""
    mesh = sinks.face_triangles(voxels(spark, d)[0].where("phase = 3"))
    return sinks.write_stl(mesh, _folder(spark, "stl")).select("scan", "triangles")


@query("SELECT n_name AS specimen, (row_number() OVER (PARTITION BY n_name ORDER BY k) - 1)::INTEGER AS step, s::INTEGER AS scan, lead(s) OVER (PARTITION BY n_name ORDER BY k)::INTEGER AS next_scan FROM (SELECT n_name, unnest([n_nationkey + 2, n_nationkey, n_nationkey + 1]) AS s, unnest([0, 1, 2]) AS k FROM nation)")
def registry_steps(spark: SparkSession, d: str) -> DataFrame:
    """Scans of a registry in their listed order, which isn't that of their numbers."""
    rows = table(spark, d, "nation").collect()  # a registry of specimens is a small table
    reg = tables.registry(spark, {r["n_name"]: {"folder": "f", "scans": (r["n_nationkey"] + 2, r["n_nationkey"], r["n_nationkey"] + 1)} for r in rows})
    return tables.transitions(reg).select("specimen", "step", "scan", "next_scan")


@query("SELECT k, id FROM (SELECT p_brand AS k, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY md5('3:' || p_partkey), p_partkey) AS r FROM part) WHERE r <= 5")
def random_subsample(spark: SparkSession, d: str) -> DataFrame:
    """Five rows of each class, the same in every run: the sampling operator itself, by its md5 order."""
    own = table(spark, d, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("id"))
    return stats.exact_sample(own, 5, "id", 3, ["k"]).select("k", "id")


@query(f"WITH {VOXELS} SELECT scan, label, count(*) AS n, sum(z * 1000000 + y * 1000 + x)::BIGINT AS places FROM voxels WHERE label > 0 GROUP BY 1, 2")
def zarr_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels in chunked array stores, where they are floats; read as the nearest whole numbers."""
    folder, (vox, edge) = _folder(spark, "zarr"), voxels(spark, d)
    volumes.write_zarr(vox, "label", (edge,) * 3, folder, 16)
    back = open_volumes(spark, folder, "zarr").withColumn("label", F.rint("value").cast("int")).where("label > 0")
    return back.groupBy("scan", "label").agg(F.count("*").alias("n"), F.sum(F.col("z") * 1_000_000 + F.col("y") * 1000 + F.col("x")).cast("long").alias("places"))
