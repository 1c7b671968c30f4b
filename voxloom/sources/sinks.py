"""Writers: tables with upsert and resume, text reports, LaTeX rows, sheets, meshes."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.stats import upsert
from voxloom.scratch import Scratch
from voxloom.sources.tables import first_existing

#: Bytes of a part that are copied at once.
COPIED = 1 << 22


def write_upsert(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str], partition: str) -> None:
    """Replace the rows of ``new``'s keys: only partitions that ``new`` touches are rewritten."""
    if first_existing(spark, [path]):
        touched = new.select(partition).distinct()
        old = spark.read.parquet(path).join(F.broadcast(touched) if touched.limit(1001).count() <= 1000 else touched, partition, "left_semi")
        new = Scratch(spark, "upsert").put(upsert(old.select(*new.columns), new, keys), "rows")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it was written whole, else what ``make`` gives, written there."""
    if not first_existing(spark, [f"{path}/_SUCCESS"]):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def latex_row(cells: Sequence[Column]) -> Column:
    """One table row; missing cells are dashes."""
    return F.concat(F.array_join(F.array(*[F.coalesce(c.cast("string"), F.lit("--")) for c in cells]), " & "), F.lit(" \\\\"))


def latex_table(df: DataFrame, header: Sequence[str], cells: Sequence[Column], order: Sequence[Column]) -> str:
    """A LaTeX table. For published tables: the rows come to the driver."""
    rows = [r[0] for r in df.orderBy(*order).select(latex_row(cells)).collect()]
    return "\n".join([f"\\begin{{tabular}}{{{'l' * len(header)}}}", "\\toprule", " & ".join(header) + " \\\\", "\\midrule", *rows, "\\bottomrule", "\\end{tabular}"]) + "\n"


def report_line(widths: Sequence[int], cells: Sequence[Column], decimals: int | Sequence[int] = 3) -> Column:
    """Right-aligned fixed-width columns; ``decimals`` are one number for all or one for each, and 0 leaves a cell as it is."""
    each = [decimals] * len(cells) if isinstance(decimals, int) else decimals
    text = [F.format_string(f"%.{d}f", c.cast("double")) if d else c.cast("string") for c, d in zip(cells, each, strict=True)]
    return F.concat(*[F.lpad(F.coalesce(t, F.lit("-")), w, " ") for t, w in zip(text, widths, strict=True)])


def write_report(df: DataFrame, path: str, widths: Sequence[int], cells: Sequence[Column], decimals: int | Sequence[int] = 3) -> None:
    df.select(report_line(widths, cells, decimals).alias("value")).write.mode("overwrite").text(path)


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per sheet."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


#: Rows that a sheet holds: fixed value of the format.
SHEET_ROWS = 1_048_576


def _cell(at: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _letters(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook of one sheet for each relation, with a header row. For published tables: rows come to the driver, sheet by sheet, and more than a
    sheet holds are an error."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head, out = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(len(sheets)))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k + 1}" r:id="r{k + 1}"/>' for k, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, df in enumerate(sheets.values()):
            rows = df.limit(SHEET_ROWS).collect()
            if len(rows) >= SHEET_ROWS:
                raise ValueError(f"a sheet holds {SHEET_ROWS - 1} rows beside its header")
            lines = (f'<row r="{i + 1}">{"".join(_cell(f"{_letters(j)}{i + 1}", v) for j, v in enumerate(r))}</row>' for i, r in enumerate([df.columns, *rows]))
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(base) as f:
        f.write(out.getvalue())


def stl_body(triangles: np.ndarray) -> bytes:
    """(n, 3, 3) triangles with their normals as a binary STL has them after its head."""
    t = np.asarray(triangles, "<f4").reshape(-1, 3, 3)
    n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    n = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-30)
    body = np.zeros(len(t), np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]))
    body["n"], body["v"] = n, t
    return body.tobytes()


def stl_head(n: int) -> bytes:
    return b"voxloom".ljust(80, b" ") + struct.pack("<I", n)


def stl_bytes(triangles: np.ndarray) -> bytes:
    """Binary STL of (n, 3, 3) triangles with their normals."""
    return stl_head(np.asarray(triangles).reshape(-1, 3, 3).shape[0]) + stl_body(triangles)


def face_triangles(vox: DataFrame) -> DataFrame:
    """(scan, tri): two triangles per outer face of the voxels (scan, z, y, x), as arrays of nine coordinates."""
    from voxloom.operators.grid import KEY, shifted

    moves = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    own = vox.select(*KEY)
    open_faces = shifted(own, moves).join(own, [*KEY], "left_anti")
    rows = []
    for m in moves:
        axis = next(k for k in range(3) if m[k])
        u, v = [np.eye(3, dtype=int)[k] for k in range(3) if k != axis]
        base = np.array([0 if m[k] > 0 else max(0, -m[k]) for k in range(3)])
        corners = [base, base + u, base + u + v, base + v]
        if m[axis] < 0:
            corners = corners[::-1]
        rows.append([[c.tolist() for c in (corners[0], corners[a], corners[a + 1])] for a in (1, 2)])
    at = [F.col("z"), F.col("y"), F.col("x")]
    out = F.lit(None).cast("array<array<double>>")
    for k, pair in enumerate(rows):
        tris = F.array(*[F.array(*[(at[i] + c[i]).cast("double") for c in tri for i in range(3)]) for tri in pair])
        out = F.when(F.col("move") == k, tris).otherwise(out)
    return open_faces.select("scan", F.explode(out).alias("tri"))


def write_stl(triangles: DataFrame, folder: str) -> DataFrame:
    """One binary STL per scan: (scan, path, triangles). Every task writes its triangles of a scan as a part, a batch at a time; then a task a scan copies the parts
    after the head, which says how many there are, by blocks. So no task holds a mesh."""
    parts = f"{folder}/parts-{uuid.uuid4().hex}"
    #: Both steps are written: parts are made once, and are gone when the meshes are there.
    scratch = Scratch(triangles.sparkSession, "stl")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(parts)
        store.create_dir(base, recursive=True)
        name, held, opened = uuid.uuid4().hex, {}, {}
        try:
            for batch in batches:
                scans, tri = batch.column("scan").to_numpy(zero_copy_only=False), batch.column("tri").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
                for scan in np.unique(scans).tolist():
                    if scan not in opened:
                        held[scan], opened[scan] = 0, store.open_output_stream(f"{base}/{scan:02d}-{name}")
                    own = tri[scans == scan]
                    opened[scan].write(stl_body(own))
                    held[scan] += len(own)
        finally:
            for out in opened.values():
                out.close()
        yield pa.RecordBatch.from_pydict({"scan": pa.array(list(held), pa.int32()), "part": pa.array([f"{base}/{k:02d}-{name}" for k in held], pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    def one(found: pd.DataFrame) -> pd.DataFrame:
        store, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/scan{int(found.scan.iloc[0]):02d}.stl"
        with store.open_output_stream(path) as out:
            out.write(stl_head(int(found.n.sum())))
            for name in sorted(found.part):
                with store.open_input_stream(name) as rows:
                    while block := rows.read(COPIED):
                        out.write(block)
        return pd.DataFrame([(found.scan.iloc[0], path, found.n.sum())], columns=["scan", "path", "triangles"])

    found = scratch.put(triangles.select(F.col("scan").cast("int").alias("scan"), "tri").mapInArrow(part, "scan int, part string, n long"), "parts")
    out = scratch.put(found.groupBy("scan").applyInPandas(one, "scan int, path string, triangles long"), "meshes")
    if not found.isEmpty():
        store, base = fs.FileSystem.from_uri(parts)
        store.delete_dir(base)
    return out
