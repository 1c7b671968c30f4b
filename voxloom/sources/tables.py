"""Readers of object tables and records. Schemas are stated, never inferred; missing values become NULL at once."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.series import interpolate
from voxloom.schema import CORRELATION, CUBES, ingest


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", strict: bool = True) -> DataFrame:
    """Delimited text with a header; not strict: rows that don't fit the schema are dropped."""
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("nullValue", "")
    return ingest(reader.schema(schema).csv(path))


def read_glob(spark: SparkSession, path: str, schema: str, key: str, pattern: str, sep: str = ",") -> DataFrame:
    """Many files as one relation, with a key taken from each file's name by the pattern's first group."""
    raw = spark.read.option("header", True).option("sep", sep).schema(schema).csv(path)
    return ingest(raw.withColumn(key, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)))


def read_correlation(spark: SparkSession, path: str, max_error: float | None = None, least_status: int = 1, sep: str = "\t") -> DataFrame:
    """Correlation results: finite displacements with a status of at least ``least_status`` and, if given, an error below the cap."""
    df = read_csv(spark, path, CORRELATION, sep)
    keep = (F.col("returnStatus") >= least_status) & F.col("Zdisp").isNotNull() & F.col("Ydisp").isNotNull() & F.col("Xdisp").isNotNull()
    if max_error is not None:
        keep = keep & (F.col("error") < max_error)
    return df.where(keep).select(F.col("NodeNumber").cast("long").alias("id"), F.col("Zpos").alias("z"), F.col("Ypos").alias("y"), F.col("Xpos").alias("x"), F.col("Zdisp").alias("uz"), F.col("Ydisp").alias("uy"), F.col("Xdisp").alias("ux"), "error", "returnStatus")


def read_cubes(spark: SparkSession, path: str) -> DataFrame:
    """Nested per-scan files of cubes."""
    return spark.read.schema(CUBES).option("multiLine", True).json(path)


def accepted_cubes(cubes: DataFrame, axis: int = 2) -> DataFrame:
    """(tag, n_cubes, n_ok, tau, tau_sd): mean and population deviation over axial tau of accepted cubes: finite, at least 1, with a positive diffusivity along ``axis``."""
    good = F.filter("cubes", lambda c: c["tau_z"].isNotNull() & ~F.isnan(c["tau_z"]) & (c["tau_z"] >= 1) & (c["tau_z"] < float("inf")) & (F.coalesce(F.get(c["Deff"], F.lit(axis)), F.lit(1.0)) > 0))
    tau = F.transform(good, lambda c: c["tau_z"])
    flat = cubes.select("tag", F.size("cubes").alias("n_cubes"), tau.alias("t"))
    mean = F.try_divide(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), F.size("t"))
    flat = flat.withColumn("tau", mean)
    return flat.select("tag", "n_cubes", F.size("t").alias("n_ok"), "tau", F.sqrt(F.try_divide(F.aggregate("t", F.lit(0.0), lambda a, x: a + (x - F.col("tau")) * (x - F.col("tau"))), F.size("t"))).alias("tau_sd"))


def read_keyvalues(spark: SparkSession, path: str, keys: Sequence[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """(path, key columns): records of KEY=value lines, one file each; absent keys are NULL."""
    text = spark.read.format("binaryFile").load(path).select("path", F.decode("content", encoding).alias("t"))
    found = [F.regexp_extract("t", rf"(?m)^{k}=\s*([^\r\n]*?)\s*$", 1) for k in keys]
    return text.select("path", *[F.when(v != "", v).alias(k) for v, k in zip(found, keys, strict=True)])


def read_report(spark: SparkSession, path: str, columns: Sequence[str], kinds: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of a text report: lines that begin with a digit and have as many fields as there are columns; others are passed over."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p"), F.col("_metadata.file_path").alias("path"))
    fits = (F.size("p") == len(columns)) & F.get("p", F.lit(0)).rlike(r"^[0-9]+$")
    return lines.where(fits).select("path", *[F.get("p", F.lit(k)).cast((kinds or {}).get(c, "double")).alias(c) for k, c in enumerate(columns)])


def read_size_classes(spark: SparkSession, path: str) -> DataFrame:
    """(path, mn, mx, p3, q3, d): size classes of instrument files in UTF-16, after a line that begins "Size class"; only-number files are weighted by the cube of size.

    q3 is the percentage at or below mx; d is the class's middle.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for path, content in zip(part.path, part.content, strict=True):
                lines = bytes(content).decode("utf-16").splitlines()
                at = next((k for k, x in enumerate(lines) if x.strip().lower().startswith("size class")), None)
                if at is None:
                    continue
                names = lines[at + 1].split("\t")
                got = []
                for line in lines[at + 2 :]:
                    cells = line.replace(",", ".").split("\t")
                    if len(cells) < len(names) or not cells[0].strip():
                        break
                    got.append(dict(zip((n.strip() for n in names), map(float, cells), strict=False)))
                mid = [(r["mn"] + r["mx"]) / 2 for r in got]
                p3 = [r["p3"] if "p3" in r else r["p0"] * m**3 for r, m in zip(got, mid, strict=True)]
                total = sum(p3) or 1.0
                run = np.cumsum(p3) / total * 100
                rows += [(path, r["mn"], r["mx"], 100 * p / total, float(q), m) for r, p, q, m in zip(got, p3, run, mid, strict=True)]
            yield pd.DataFrame(rows, columns=["path", "mn", "mx", "p3", "q3", "d"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, mn double, mx double, p3 double, q3 double, d double")


def averaged_replicates(classes: DataFrame, grid: DataFrame) -> DataFrame:
    """(mx, q3): curves of replicate files interpolated on one grid (mx) and averaged."""
    paths = classes.select("path").distinct()
    spread = grid.select("mx").crossJoin(F.broadcast(paths)) if classes.select("path").distinct().limit(1001).count() <= 1000 else grid.select("mx").join(paths)
    return interpolate(spread, classes.select("path", "mx", "q3"), "mx", "q3", ["path"]).groupBy("mx").agg(F.avg("q3").alias("q3"))


def read_npz(spark: SparkSession, path: str, arrays: Mapping[str, str]) -> DataFrame:
    """(path, row, columns): arrays of equal length out of archives; ``arrays`` maps names to Spark types (array types for matrices)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for path, content in zip(part.path, part.content, strict=True):
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as z:
                    cols = {n: (list(z[n]) if z[n].ndim > 1 else z[n]) for n in arrays}
                    out = pd.DataFrame(cols)
                out.insert(0, "row", range(len(out)))
                out.insert(0, "path", path)
                yield out

    ddl = "path string, row long, " + ", ".join(f"{n} {k}" for n, k in arrays.items())
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, ddl)


def _file_per_group(df: DataFrame, folder: str, key: str, suffix: str, encode: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """(path, rows): a file for each key. A group is one file."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/{part[key].iloc[0]}.{suffix}"
        with store.open_output_stream(path) as out:
            out.write(encode(part))
        return pd.DataFrame([(path, len(part))], columns=["path", "rows"])

    return df.groupBy(key).applyInPandas(one, "path string, rows long")


def write_npz(df: DataFrame, folder: str, key: str, arrays: Mapping[str, str]) -> DataFrame:
    """(path, rows): an archive of arrays for each key, as ``read_npz`` takes them; written when it is read."""

    def encode(part: pd.DataFrame) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: np.stack(part[n].to_numpy()) if k.startswith("array") else part[n].to_numpy() for n, k in arrays.items()})
        return out.getvalue()

    return _file_per_group(df, folder, key, "npz", encode)


def write_size_classes(df: DataFrame, folder: str, key: str) -> DataFrame:
    """(path, rows): an instrument file in UTF-16 for each key, from (key, mn, mx, p3); written when it is read."""
    line = lambda r: f"{float(r.mn)!r}\t{float(r.mx)!r}\t{float(r.p3)!r}"
    return _file_per_group(df, folder, key, "xle", lambda part: "\n".join(["Size class", "mn\tmx\tp3", *map(line, part.sort_values("mx").itertuples()), ""]).encode("utf-16"))


def workbook_rows(content: bytes, sheet: str) -> list[list]:
    """Rows of cells of a sheet, as text, numbers, truth values or None."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {s.get("name"): s.get(rel) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", space)}
        if sheet not in names:
            raise KeyError(f"no sheet {sheet!r}; there are {', '.join(map(str, names))}")
        target = next(r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == names[sheet])
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", space)) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", space)]
        rows = []
        for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iterfind("m:sheetData/m:row", space):
            cells: list = []
            for k, c in enumerate(row.iterfind("m:c", space)):
                at = 0
                for x in re.match("[A-Z]*", c.get("r", "")).group():
                    at = at * 26 + ord(x) - 64
                cells += [None] * ((at or k + 1) - 1 - len(cells))
                value, kind = c.findtext("m:v", None, space), c.get("t")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iterfind(".//m:t", space))
                elif value is not None:
                    value = shared[int(value)] if kind == "s" else value == "1" if kind == "b" else value if kind == "str" else float(value)
                cells.append(value)
            rows.append(cells)
    return rows


def read_workbook(spark: SparkSession, path: str, sheet: str, schema: str) -> DataFrame:
    """A sheet with a header row, by the names and types of ``schema``; other columns are passed over, missing cells are NULL. A workbook is one task's work."""
    kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for content in part.content:
                head, *rows = workbook_rows(bytes(content), sheet)
                at = {n: head.index(n) for n in kinds if n in head}
                text = lambda v: str(int(v)) if isinstance(v, float) and v.is_integer() else None if v is None else str(v)
                yield pd.DataFrame({n: [text(r[at[n]]) if n in at and at[n] < len(r) else None for r in rows] for n in kinds}, dtype=object)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, ", ".join(f"`{n}` string" for n in kinds))
    return ingest(raw.select(*[F.col(f"`{n}`").cast(k).alias(n) for n, k in kinds.items()]))


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """The first path that exists, in whatever store it is."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in candidates:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    return None


def registry(spark: SparkSession, specimens: Mapping[str, Mapping], chosen: str | None = None) -> DataFrame:
    """(specimen, folder, scans, thresholds) of a registry; an unknown choice fails."""
    if chosen is not None and chosen not in specimens:
        raise KeyError(f"unknown specimen {chosen!r}; known: {', '.join(sorted(specimens))}")
    rows = [(k, v.get("folder"), [int(s) for s in v.get("scans", ())], {int(a): float(b) for a, b in v.get("thresholds", {}).items()}) for k, v in specimens.items() if chosen in (None, k)]
    return spark.createDataFrame(rows, "specimen string, folder string, scans array<int>, thresholds map<int, double>")


def transitions(reg: DataFrame) -> DataFrame:
    """(specimen, step, scan, next_scan): scans in their listed order, which isn't that of their numbers."""
    flat = reg.select("specimen", "scans", F.posexplode("scans").alias("step", "scan"))
    return flat.select("specimen", "step", "scan", F.get("scans", F.col("step") + 1).alias("next_scan"))
