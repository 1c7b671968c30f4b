"""WARC archives: a writer with revisit records, and a splittable reader.

Archives have one gzip member per record. A reading task gets a byte range, looks for gzip magic in it, takes a place
for a member if it can be decoded whole and begins with a WARC version line, and reads the records that start inside,
the last one past the end. A payload can itself hold such members, stored as they are. A task can't tell them from the
archive's own, so all are read, and those that begin inside of another are taken out by their places: the result is that of
reading each archive from its start, whatever the splits. Files are opened through ``pyarrow.fs`` by the URI of the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.scratch import Scratch, shared_dir

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a split, of an archive before the next is begun, and of a read.
SPLIT_BYTES, FILE_BYTES, READ_BYTES = 8 << 20, 256 << 20, 1 << 18
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: object) -> str:
    """A header value: line ends and % become %XX, so any string comes back as it was."""
    return "".join(f"%{ord(c):02X}" if c in "%\r\n\x00" else c for c in str(value))


def _unline(value: str) -> str:
    for code in ("0D", "0A", "00", "25"):
        value = value.replace(f"%{code}", chr(int(code, 16)))
    return value


def encode_record(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str, level: int = 1) -> bytes:
    """One gzip member with a response record, or a revisit record without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def decode_record(raw: bytes) -> dict | None:
    """The record's fields; None if it isn't one."""
    if not raw.startswith(b"WARC/"):
        return None
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields.get("Content-Length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("WARC-Type", "")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    return {
        "page_id": number(fields.get("WARC-Record-ID", "")),
        "url": _unline(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To", "")),
        "payload_bytes": length if kind == "revisit" else len(payload),
        "payload_digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") if kind == "revisit" else base32_sha1(payload),
        "payload": None if kind == "revisit" else payload,
    }


def with_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, sha1, first): first is the least id of equal payloads of several rows, or null where there is one row or it's too short to be revisited."""
    flat = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    flat = flat.select("*", F.sha1("payload").alias("sha1"))
    least = flat.select("page_id", "sha1", F.octet_length("payload").alias("n")).where(F.col("n") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("m"))
    #: Only payloads that repeat are joined, so that this side stays small.
    return flat.join(least.where("m > 1").drop("m"), "sha1", "left")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, level: int = 1) -> DataFrame:
    """Write a record per row of ``pages`` and return the table of archives written: (path, bytes, records).

    Of equal payloads of ``min_bytes`` or more, the row with the smallest id is a response and the others revisit it;
    rows that repeat the smallest id are all responses. Null payloads are empty; null ids come last and stay null.
    Other columns are ignored; no rows give no archive. File names hold the task's attempt, so a task that runs twice
    never writes into what a reader has been told of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        stem = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        done, out, path, size, records = [], None, "", 0, 0
        for batch in batches:
            cols = batch.to_pydict()
            for page, url, payload, sha1, first in zip(*(cols[c] for c in ("page_id", "url", "payload", "sha1", "first")), strict=True):
                if out is None:
                    path = f"{base}/{stem}-{len(done):04d}.warc.gz"
                    out, size, records = store.open_output_stream(path, compression=None), 0, 0
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                raw = encode_record(page, url, payload, first, first is not None and page != first, digest, level)
                out.write(raw)
                size += len(raw)
                records += 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, records))
        yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "bytes": [x[1] for x in done], "records": [x[2] for x in done]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    rows = with_revisits(pages, id_col, url_col, payload_col, min_bytes)
    return rows.select("page_id", "url", "payload", "sha1", "first").mapInArrow(run, "path string, bytes long, records long")


class _Window:
    """The file's bytes from a moving place on."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if at < self.base or at + n > self.base + len(self.data):
            self.base, self.data = at, self.file.read_at(max(n, min(READ_BYTES, self.size - at)), at)
        return self.data[at - self.base : at - self.base + n]


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The member at a place, decoded whole and checked, and where it ends; None if there is none or it isn't a record."""
    unpack, parts, place = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            raw = window.get(place, 1 << 14)
            if not raw:
                return None
            place += len(raw)
            parts.append(unpack.decompress(raw))
            if sum(map(len, parts[:2])) >= 5 and not b"".join(parts[:2]).startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    whole = b"".join(parts)
    return (whole, place - len(unpack.unused_data)) if whole.startswith(b"WARC/") else None


def records_in_range(file, size: int, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(place, end, record) of every member that starts in [start, end), also of those inside of others."""
    window, at = _Window(file, size), start
    while at < end:
        if window.get(at, 3) == MAGIC and (found := _member(window, at)):
            yield at, found[1], found[0]
        chunk = window.get(at + 1, min(READ_BYTES, end - at + 1))
        k = chunk.find(MAGIC)
        at = at + 1 + k if k >= 0 else at + max(1, len(chunk) - 1)


def nested(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of members in the order of their places, those that reading from the start doesn't meet: each begins before the end of the last that was met."""
    out, open_until = np.zeros(len(starts), bool), 0
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        out[k] = a < open_until
        if a >= open_until:
            open_until = b
    return out


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_archives(archives: DataFrame, scheme_of: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of archives (path, bytes): (page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]).

    ``scheme_of`` is a URI in the store that holds them. Splits of all archives are dealt to tasks evenly. A revisit
    has its payload's length and digest from its headers. Members that aren't records are passed over. What was read is
    written once, as the members to leave out are known when all of an archive's are: per archive, from two numbers a member.
    """
    spark = archives.sparkSession
    names = ["path", "place", "end", *[f.name for f in _RECORD if payloads or f.name != "payload"]]
    schema = pa.schema([("path", pa.string()), ("place", pa.int64()), ("end", pa.int64()), *[_RECORD.field(n) for n in names[3:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(scheme_of)
        rows, held = [], 0
        for batch in batches:
            for path, start, end, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as file:
                    for place, stop, raw in records_in_range(file, size, start, end):
                        if record := decode_record(raw):
                            rows.append({n: record[n] for n in names[3:]} | {"path": path, "place": place, "end": stop})
                            held += len(raw) if payloads else 200
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def inside(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        return table.select(["path", "place"]).filter(pa.array(nested(table["place"].to_numpy(), table["end"].to_numpy())))

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = archives.where("bytes > 0").select("path", starts.alias("start"), "bytes").select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"), "bytes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ddl = "path string, place long, end long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    scratch = Scratch(spark, "records")
    found = scratch.put(splits.repartition(parts).mapInArrow(run, ddl), "found")
    #: Only archives in which members overlap are walked.
    by = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    places = found.select("path", "place", "end")
    mixed = places.withColumn("before", F.max("end").over(by)).where("before > place").select("path").distinct()
    extra = scratch.put(places.join(mixed, "path", "left_semi").groupBy("path").applyInArrow(inside, "path string, place long"), "inside")
    own = found if extra.isEmpty() else found.join(extra, ["path", "place"], "left_anti")
    return own.select(*names[3:])


def warc_round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write ``pages`` as archives into the shared folder, and read them back."""
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.path}/archives"
    archives = scratch.put(write_archives(pages, folder, id_col, url_col, payload_col, min_bytes), "manifest")
    return read_archives(archives, shared_dir(spark), payloads=payloads)


def warc_oracle() -> str:
    return """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
d AS (SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (k // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
