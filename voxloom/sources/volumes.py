"""Volumes: TIFF pages and slice stacks to rows, rows to bricks and sparse voxels, and back.

A page is one z-slice. Tasks read pages, never whole volumes: the page table holds byte offsets, so the planner's
filters on z and scan leave pages unread.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
_DTYPES = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 3): "f4", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (64, 3): "f8"}


def tiff_pages(read, size: int) -> Iterator[dict]:
    """The image directories of a TIFF (classic or big), one after the other, by a ``read(offset, n)``; only headers are read."""
    head = read(0, 16)
    end = {b"II": "<", b"MM": ">"}[head[:2]]
    big = struct.unpack(end + "H", head[2:4])[0] == 43
    at = struct.unpack(end + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    while at:
        n = struct.unpack(end + ("Q" if big else "H"), read(at, 8 if big else 2))[0]
        width, first = (20, at + 8) if big else (12, at + 2)
        raw = read(first, n * width + (8 if big else 4))
        tags = {}
        for k in range(n):
            e = raw[k * width : (k + 1) * width]
            tag, kind = struct.unpack(end + "HH", e[:4])
            count = struct.unpack(end + ("Q" if big else "I"), e[4:12] if big else e[4:8])[0]
            code = {1: "B", 3: "H", 4: "I", 16: "Q"}.get(kind)
            if not code:
                continue
            length, slot = _SIZES[kind] * count, e[12:20] if big else e[8:12]
            data = slot[:length] if length <= len(slot) else read(struct.unpack(end + ("Q" if big else "I"), slot)[0], length)
            tags[tag] = list(struct.unpack(f"{end}{count}{code}", data))
        bits, fmt = tags.get(258, [1])[0], tags.get(339, [1])[0]
        yield {"nx": tags[256][0], "ny": tags[257][0], "dtype": end + _DTYPES[bits, fmt], "compression": tags.get(259, [1])[0], "rows": min(tags.get(278, [tags[257][0]])[0], tags[257][0]), "offsets": tags[273], "counts": tags[279]}
        at = struct.unpack(end + ("Q" if big else "I"), raw[n * width :])[0]


def tiff_decode(page: dict, read, first: int = 0, last: int | None = None) -> np.ndarray:
    """One page's array, or of it the rows from ``first`` to ``last``: strips without such rows aren't read. Strips are plain or deflated."""
    last = page["ny"] - 1 if last is None else min(last, page["ny"] - 1)
    low, high = first // page["rows"], last // page["rows"] + 1
    parts = [read(int(o), int(c)) for o, c in zip(page["offsets"][low:high], page["counts"][low:high], strict=True)]
    if page["compression"] in (8, 32946):
        parts = [zlib.decompress(p) for p in parts]
    elif page["compression"] != 1:
        raise ValueError(f"compression {page['compression']} isn't read")
    rows = np.frombuffer(b"".join(parts), page["dtype"]).reshape(-1, page["nx"])
    return rows[first - low * page["rows"] : last + 1 - low * page["rows"]]


def tiff_encode(volume: np.ndarray, deflate: bool = True, strip: int | None = None) -> bytes:
    """A multi-page TIFF of a (z, y, x) array of unsigned whole numbers, in strips of so many rows, or one a page."""
    bits = volume.dtype.itemsize * 8
    out, where = bytearray(b"II*\x00\x00\x00\x00\x00"), 4
    for page in volume:
        step = strip or max(1, page.shape[0])
        places = []
        for y in range(0, page.shape[0], step):
            raw = page[y : y + step].astype(f"<u{bits // 8}").tobytes()
            raw = zlib.compress(raw) if deflate else raw
            places.append((len(out), len(raw)))
            out += raw + b"\x00" * (len(raw) % 2)
        slots = []
        for values in zip(*places, strict=True):
            slots.append(values[0] if len(values) == 1 else len(out))
            out += struct.pack(f"<{len(values)}I", *values) if len(values) > 1 else b""
        n = len(places)
        entries = [(256, 4, 1, page.shape[1]), (257, 4, 1, page.shape[0]), (258, 3, 1, bits), (259, 3, 1, 8 if deflate else 1), (262, 3, 1, 1), (273, 4, n, slots[0]), (277, 3, 1, 1), (278, 4, 1, step), (279, 4, n, slots[1]), (339, 3, 1, 1)]
        out[where : where + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries)
        where = len(out)
        out += b"\x00\x00\x00\x00"
    return bytes(out)


def read_slices(spark: SparkSession, path: str, pattern: str = r"(\d+)\.tiff?$", scan: int = 0, step: int = 1) -> DataFrame:
    """(scan, z, ny, nx, payload): a folder of one-page files, z from the name. Every ``step``-th slice can be taken; missing slices leave gaps in z."""
    files = spark.read.format("binaryFile").load(path).withColumn("z", F.regexp_extract("path", pattern, 1).cast("int")).where(F.col("z").isNotNull() & (F.col("z") % step == 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for z, content in zip(part.z, part.content, strict=True):
                data = bytes(content)
                read = lambda o, n, data=data: data[o : o + n]
                got = tiff_decode(next(tiff_pages(read, len(data))), read)
                rows.append((scan, z, got.shape[0], got.shape[1], got.ravel().astype(float).tolist()))
            yield pd.DataFrame(rows, columns=["scan", "z", "ny", "nx", "payload"])

    return files.select("z", "content").mapInPandas(run, "scan int, z int, ny int, nx int, payload array<double>")


def paged(vox: DataFrame, value: str, ny: int, nx: int) -> DataFrame:
    """(scan, z, ny, nx, payload): voxels as whole slices; places without a voxel are 0, slices without voxels are left out. A group is one slice, filled as an array."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        page = np.zeros(ny * nx)
        page[part.y.to_numpy() * nx + part.x.to_numpy()] = part.v
        return pd.DataFrame({"scan": part.scan.iloc[:1], "z": part.z.iloc[:1], "ny": ny, "nx": nx, "payload": [page]})

    cells = vox.select("scan", "z", "y", "x", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    return cells.groupBy("scan", "z").applyInPandas(one, "scan int, z int, ny int, nx int, payload array<double>")


def _put(uri: str, data: bytes) -> None:
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)


def write_tiff(pages: DataFrame, folder: str, strip: int | None = None) -> DataFrame:
    """(scan, uri, pages): a multi-page file of 16-bit slices for each scan. A file is written from its start, so a scan is one task's work."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("z")
        uri = f"{folder}/scan{int(part.scan.iloc[0]):04d}.tif"
        _put(uri, tiff_encode(np.stack([np.asarray(p).reshape(ny, nx) for p, ny, nx in zip(part.payload, part.ny, part.nx, strict=True)]).astype(np.uint16), strip=strip))
        return pd.DataFrame([(int(part.scan.iloc[0]), uri, len(part))], columns=["scan", "uri", "pages"])

    return pages.groupBy("scan").applyInPandas(one, "scan int, uri string, pages int")


def write_slices(pages: DataFrame, folder: str) -> int:
    """A one-page file of 16 bits for every slice, in a folder for each scan; the number of files. A task that runs twice writes the same files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for r in part.itertuples():
                _put(f"{folder}/{r.scan:04d}/slice_{r.z:06d}.tif", tiff_encode(np.asarray(r.payload).reshape(1, r.ny, r.nx).astype(np.uint16)))
            yield pd.DataFrame({"files": [len(part)]})

    return pages.mapInPandas(run, "files long").agg(F.sum("files")).first()[0] or 0


def write_zarr(vox: DataFrame, value: str, shape: tuple[int, int, int], folder: str, chunk: int = 64) -> int:
    """Voxels (scan, z, y, x) as chunked array stores of doubles (format 2, zlib), a folder ``scanNNNN`` each; the number of chunks. A group is one
    chunk; what has no voxel is 0. Chunks without voxels aren't written."""
    head = json.dumps({"zarr_format": 2, "shape": list(shape), "chunks": [chunk] * 3, "dtype": "<f8", "compressor": {"id": "zlib", "level": 1}, "fill_value": 0, "order": "C", "filters": None}).encode()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((chunk,) * 3)
        v[tuple((part[a] % chunk).to_numpy() for a in ("z", "y", "x"))] = part.v
        at = [int(part[a].iloc[0]) // chunk for a in ("z", "y", "x")]
        store = f"{folder}/scan{int(part.scan.iloc[0]):04d}"
        _put(f"{store}/{'.'.join(map(str, at))}", zlib.compress(v.tobytes(), 1))
        _put(f"{store}/.zarray", head)
        return pd.DataFrame({"n": [1]})

    own = vox.select("scan", "z", "y", "x", F.col(value).cast("double").alias("v"), *[F.floor(F.col(a) / chunk).alias(f"b{a}") for a in ("z", "y", "x")])
    return own.groupBy("scan", "bz", "by", "bx").applyInPandas(one, "n long").agg(F.sum("n")).first()[0] or 0


def sparse(pages: DataFrame) -> DataFrame:
    """(scan, z, y, x, grey): one row a voxel, JVM-side."""
    flat = pages.select("scan", "z", "nx", F.posexplode("payload").alias("i", "grey"))
    return flat.select("scan", "z", F.floor(F.col("i") / F.col("nx")).cast("int").alias("y"), (F.col("i") % F.col("nx")).cast("int").alias("x"), "grey")


def cropped(vox: DataFrame, z: tuple[int, int] | None = None, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None) -> DataFrame:
    """Voxels inside a box, ends included; coordinates keep their meaning."""
    for name, ends in (("z", z), ("y", y), ("x", x)):
        if ends:
            vox = vox.where(F.col(name).between(*ends))
    return vox


def bricked(vox: DataFrame, value: str, edge: int, halo: int = 0, kind: str = "float") -> DataFrame:
    """(scan, bz, by, bx, nz, ny, nx, payload): cubes of ``edge`` with a halo, as arrays of ``kind`` (float or double); voxels that don't exist are 0. Each voxel goes to
    the bricks whose halo it is in."""
    spread = vox.select("scan", "z", "y", "x", F.col(value).cast(kind).alias("v"))
    for a in ("z", "y", "x"):
        first, last = F.floor((F.col(a) - halo) / edge).cast("int"), F.floor((F.col(a) + halo) / edge).cast("int")
        spread = spread.withColumn(f"b{a}", F.explode(F.sequence(first, last)))
    own = vox.select("scan", *[F.floor(F.col(a) / edge).cast("int").alias(f"b{a}") for a in ("z", "y", "x")]).distinct()
    spread = spread.join(own, ["scan", "bz", "by", "bx"], "left_semi")
    n = edge + 2 * halo

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        v = np.zeros((n, n, n), part.v.dtype)
        v[tuple((part[a] - first[f"b{a}"] * edge + halo).astype(int) for a in ("z", "y", "x"))] = part.v
        return pd.DataFrame([(int(first.scan), int(first.bz), int(first.by), int(first.bx), n, n, n, v.ravel().tolist())], columns=["scan", "bz", "by", "bx", "nz", "ny", "nx", "payload"])

    return spread.groupBy("scan", "bz", "by", "bx").applyInPandas(pack, "scan int, bz int, by int, bx int, nz int, ny int, nx int, payload array<" + kind + ">")


def write_volume(pages: DataFrame, path: str) -> None:
    """Slices as Parquet by scan; what was there before is cleared."""
    pages.write.mode("overwrite").partitionBy("scan").parquet(path)


def label_type(top: int) -> str:
    """The narrowest type that labels fit."""
    return "u2" if top < 65_535 else "u4"
