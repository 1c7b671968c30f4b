"""Volumes as a data source with random access: a box is read from the pages, strips or chunks that it touches.

``spark.read.format("volume")`` gives a row per voxel, (scan, z, y, x, value). Comparisons with whole numbers on scan, z, y
and x are pushed down; what lies outside of the box that they leave isn't planned, opened or decoded. Options:

* ``layout``: ``tiff`` (multi-page files, a page is a slice), ``slices`` (a file is a slice) or ``zarr`` (chunked array stores of format 2).
* ``path``: a file or store, or a folder of them. ``pattern`` finds the scan in a path (``slices``: ``z_pattern`` the slice); without a match it is 0.
* ``index``: for ``tiff``, a table that ``index_pages`` has made, so that neither planning nor tasks walk through a file's directories.
* ``z``, ``y``, ``x``, ``scan``: ``low:high``, ends included, for a box without filters.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as dataset
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from voxloom.sources.volumes import tiff_decode, tiff_pages

NAMES = ("scan", "z", "y", "x")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: No bound; tasks of one read at most, and indexed pages of one task.
_ANY, MOST_TASKS, PAGES_A_TASK = (-(1 << 31), (1 << 31) - 1), 10_000, 8
_SCHEMA = pa.schema([*[(n, pa.int32()) for n in NAMES], ("value", pa.float64())])
_PAGE = "uri string, scan int, z int, ny int, nx int, dtype string, compression int, rows int, offsets array<long>, counts array<long>"


@dataclass
class Box:
    """Bounds of every axis, ends included."""

    bounds: dict[str, tuple[int, int]] = field(default_factory=lambda: dict.fromkeys(NAMES, _ANY))

    def narrow(self, name: str, low: int = _ANY[0], high: int = _ANY[1]) -> None:
        a, b = self.bounds[name]
        self.bounds[name] = (max(a, low), min(b, high))

    def take(self, f: Filter) -> bool:
        """Whether the filter is done with, once the box is narrowed by it."""
        name = ".".join(getattr(f, "attribute", ()))
        if name not in NAMES:
            return False
        if isinstance(f, IsNotNull):
            return True
        values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
        if not values or not all(isinstance(v, int) and not isinstance(v, bool) for v in values):
            return False
        low, high = min(values), max(values)
        if isinstance(f, EqualTo | In):
            self.narrow(name, low, high)
            return len(set(values)) == high - low + 1
        if isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.narrow(name, low + isinstance(f, GreaterThan))
            return True
        if isinstance(f, LessThan | LessThanOrEqual):
            self.narrow(name, high=high - isinstance(f, LessThan))
            return True
        return False

    def meets(self, name: str, low: int, high: int) -> bool:
        a, b = self.bounds[name]
        return a <= high and low <= b

    def part(self, name: str, first: int, n: int) -> slice:
        """Of n places from ``first`` on, those inside."""
        a, b = self.bounds[name]
        return slice(max(0, a - first), max(0, min(n, b - first + 1)))


@dataclass
class Piece(InputPartition):
    """What one task reads: pages or files as dictionaries, or chunks of a store."""

    items: list


def _files(path: str) -> list[tuple[str, str]]:
    """(URI, path in its store) of a file, or of all files below a folder."""
    store, base = fs.FileSystem.from_uri(path)
    info = store.get_file_info(base)
    head = path[: len(path) - len(base)] if path.endswith(base) else f"{store.type_name}://"
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((head + i.path, i.path) for i in found if i.is_file)


def _number(pattern: str, path: str) -> int:
    found = re.search(pattern, path)
    return int(found.group(1)) if found else 0


def _reading(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _cells(box: Box, scan: int, first: Sequence[int], values: np.ndarray) -> pa.RecordBatch:
    """Rows of the array's cells inside the box; its first cell lies at ``first``."""
    inside = [box.part(a, f, n) for a, f, n in zip(NAMES[1:], first, values.shape, strict=True)]
    v = values[tuple(inside)]
    axes = [np.arange(s.start, s.start + n, dtype=np.int32) + f for s, n, f in zip(inside, v.shape, first, strict=True)]
    grid = [g.ravel() for g in np.meshgrid(*axes, indexing="ij")]
    return pa.RecordBatch.from_arrays([pa.array(np.full(v.size, scan, np.int32)), *[pa.array(g.astype(np.int32)) for g in grid], pa.array(v.ravel().astype(np.float64))], schema=_SCHEMA)


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.box = options, Box()
        self.layout, self.path = options.get("layout", "tiff"), options["path"].rstrip("/")
        if self.layout not in ("tiff", "slices", "zarr"):
            raise ValueError(f"no layout is called {self.layout}")
        self.pattern, self.z_pattern = options.get("pattern", r"(\d+)[^/\d]*$"), options.get("z_pattern", options.get("zpattern", r"(\d+)\.tiff?$"))
        for name in NAMES:
            if name in options:
                low, high = options[name].split(":")
                self.box.narrow(name, int(low), int(high))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        return [f for f in filters if not self.box.take(f)]

    def partitions(self) -> Sequence[Piece]:
        items = {"tiff": self._tiffs, "slices": self._slices, "zarr": self._chunks}[self.layout]()
        step = max(-(-len(items) // MOST_TASKS), PAGES_A_TASK if self.layout == "tiff" and "index" in self.options else 1)
        return [Piece(items[at : at + step]) for at in range(0, len(items), step)] or [Piece([])]

    def _tiffs(self) -> list[dict]:
        """A page each, if an index or the box names them; else a file each, whose directories the task reads."""
        z0, z1 = self.box.bounds["z"]
        if "index" in self.options:
            store, base = fs.FileSystem.from_uri(self.options["index"])
            test = pc.scalar(True)
            for name in ("scan", "z"):
                low, high = self.box.bounds[name]
                test = test & (pc.field(name) >= low) & (pc.field(name) <= high)
            return dataset.dataset(base, filesystem=store).to_table(filter=test).sort_by([("scan", "ascending"), ("z", "ascending")]).to_pylist()
        found = [(uri, _number(self.pattern, uri.rsplit(".", 1)[0])) for uri, path in _files(self.path) if re.search(r"\.tiff?$", path)]
        found = [(uri, scan) for uri, scan in found if self.box.meets("scan", scan, scan)]
        if max(z0, 0) > z1:
            return []
        known = range(max(z0, 0), z1 + 1) if z1 - max(z0, 0) < MOST_TASKS else [None]
        return [{"uri": uri, "scan": scan, "z": z} for uri, scan in found for z in known]

    def _slices(self) -> list[dict]:
        found = [{"uri": uri, "scan": _number(self.pattern, uri.rsplit("/", 1)[0]), "z": _number(self.z_pattern, uri), "first": True} for uri, path in _files(self.path) if re.search(self.z_pattern, path)]
        return [f for f in found if all(self.box.meets(a, f[a], f[a]) for a in ("scan", "z"))]

    def _chunks(self) -> list[dict]:
        """The chunks that the box touches, by the shape in each store's header."""
        out = []
        store, base = fs.FileSystem.from_uri(self.path)
        alone = store.get_file_info(f"{base}/.zarray").is_file
        folders = [""] if alone else sorted(i.path[len(base) :] for i in store.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory)
        for folder in folders:
            scan = _number(self.pattern, folder)
            if not self.box.meets("scan", scan, scan) or not store.get_file_info(f"{base}{folder}/.zarray").is_file:
                continue
            with store.open_input_file(f"{base}{folder}/.zarray") as f:
                head = json.loads(f.read())
            packer = (head["compressor"] or {}).get("id")
            if head["zarr_format"] != 2 or packer not in (None, "zlib", "gzip") or head.get("filters") or len(head["shape"]) != 3:
                raise ValueError(f"{folder or self.path}: format {head['zarr_format']} with {packer} of {len(head['shape'])} axes isn't read")
            ranges = []
            for a, n, c in zip(NAMES[1:], head["shape"], head["chunks"], strict=True):
                s = self.box.part(a, 0, n)
                ranges.append(range(s.start // c, -(-s.stop // c)) if s.stop > s.start else range(0))
            out += [{"uri": self.path + folder, "scan": scan, "at": at, "head": head} for at in itertools.product(*ranges)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for item in partition.items:
            yield from self._chunk(item) if self.layout == "zarr" else self._pages(item)

    def _pages(self, item: dict) -> Iterator[pa.RecordBatch]:
        with _reading(item["uri"]) as f:
            read = lambda o, n: f.read_at(n, o)
            if "offsets" in item:
                pages = [(item["z"], item)]
            elif item.get("first"):
                pages = [(item["z"], next(tiff_pages(read, f.size())))]
            else:
                pages = ((z, p) for z, p in enumerate(tiff_pages(read, f.size())) if self.box.meets("z", z, z) and item["z"] in (None, z))
            for z, page in pages:
                y0, y1 = self.box.bounds["y"]
                first, last = max(0, y0), min(page["ny"] - 1, y1)
                if first <= last:
                    yield _cells(self.box, item["scan"], (z, first, 0), tiff_decode(page, read, first, last)[None])
                if item["z"] == z:
                    return

    def _chunk(self, item: dict) -> Iterator[pa.RecordBatch]:
        head, at = item["head"], item["at"]
        chunks, kind = head["chunks"], np.dtype(head["dtype"])
        store, base = fs.FileSystem.from_uri(f"{item['uri']}/{head.get('dimension_separator', '.').join(map(str, at))}")
        if store.get_file_info(base).is_file:
            with store.open_input_file(base) as f:
                raw = f.read()
            raw = zlib.decompress(raw, 47) if head["compressor"] else raw
            v = np.frombuffer(raw, kind).reshape(chunks, order=head["order"])
        else:
            v = np.full(chunks, head["fill_value"] or 0, kind)
        v = v[tuple(slice(0, min(c, n - i * c)) for i, c, n in zip(at, chunks, head["shape"], strict=True))]
        yield _cells(self.box, item["scan"], [i * c for i, c in zip(at, chunks, strict=True)], v)


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return "scan int, z int, y int, x int, value double"

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(dict(self.options))


def open_volumes(spark: SparkSession, path: str, layout: str = "tiff", **options: str) -> DataFrame:
    """(scan, z, y, x, value) of the volumes at ``path``. Registers the source and turns Spark's pushdown for such sources on."""
    spark.dataSource.register(VolumeSource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("volume").option("layout", layout).options(**options).load(path)


def index_pages(spark: SparkSession, path: str, index: str, pattern: str = r"(\d+)[^/\d]*$") -> DataFrame:
    """The pages of multi-page files below ``path``, written to ``index`` as a table: where each page's strips lie. Tasks read directories, one
    file each."""
    files = spark.createDataFrame([(uri, _number(pattern, uri.rsplit(".", 1)[0])) for uri, p in _files(path) if re.search(r"\.tiff?$", p)], "uri string, scan int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for uri, scan in zip(part.uri, part.scan, strict=True):
                with _reading(uri) as f:
                    pages = tiff_pages(lambda o, n, f=f: f.read_at(n, o), f.size())
                    rows = [(uri, scan, z, p["ny"], p["nx"], p["dtype"], p["compression"], p["rows"], p["offsets"], p["counts"]) for z, p in enumerate(pages)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PAGE.split(", ")])

    n = max(1, min(files.count(), MOST_TASKS))
    files.repartition(n, "uri").mapInPandas(run, _PAGE).repartitionByRange(n, "scan", "z").sortWithinPartitions("scan", "z").write.mode("overwrite").parquet(index)
    return spark.read.parquet(index)
