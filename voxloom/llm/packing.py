"""Best-fit packing with large-item matching, planned on the histogram of piece lengths.

Lengths are whole numbers up to the capacity, so a plan needs one count per length, whatever the corpus: runs of equal
sequences are filled at once. Pieces above a third of the capacity go at most two to a sequence, each taken with the
largest that still fits beside it; smaller ones, the largest first, go where the least room is left. The plan maps
(length, rank among the pieces of that length) to a place, and ranks come from counts of hashed buckets.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.scratch import Scratch

from .columns import packed, unpacked

#: Pieces of a bucket.
BUCKET_ROWS = 1 << 20
#: (length, first rank, pieces, pieces to a sequence, first sequence, offset of the first piece)
Placement = tuple[int, int, int, int, int, int]


def plan_packing(counts: dict[int, int], capacity: int) -> list[Placement]:
    """Where the pieces of each length go. Its size depends on the capacity alone."""
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)  # ranks given out, by length
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: runs of (first sequence, sequences)
    out: list[Placement] = []
    top = 0

    def put(n: int, pieces: int, each: int, first: int, offset: int) -> None:
        out.append((n, used[n], pieces, each, first, offset))
        used[n] += pieces
        left[n] -= pieces

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= min(n, capacity - n) and left[m] > (m == n)), None)
            if mate == n:
                pairs = left[n] // 2
                put(n, 2 * pairs, 2, top, 0)
                rooms[capacity - 2 * n].append((top, pairs))
            elif mate:
                pairs = min(left[n], left[mate])
                put(n, pairs, 1, top, 0)
                put(mate, pairs, 1, top, n)
                rooms[capacity - n - mate].append((top, pairs))
            else:
                pairs = left[n]
                put(n, pairs, 1, top, 0)
                rooms[capacity - n].append((top, pairs))
            top += pairs
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for room in range(n, capacity + 1):
            while left[n] and rooms[room]:
                first, many = rooms[room].pop()
                each = room // n
                full, rest = min(many, left[n] // each), 0
                if full:
                    put(n, full * each, each, first, capacity - room)
                    rooms[room - each * n].append((first, full))
                if full < many and left[n]:
                    rest = left[n]
                    put(n, rest, rest, first + full, capacity - room)
                    rooms[room - rest * n].append((first + full, 1))
                if (over := many - full - (rest > 0)) > 0:
                    rooms[room].append((first + full + (rest > 0), over))
                    break
            if not left[n]:
                break
        if left[n]:
            each = capacity // n
            full, rest = divmod(left[n], each)
            if full:
                put(n, full * each, each, top, 0)
                rooms[capacity - each * n].append((top, full))
                top += full
            if rest:
                put(n, rest, rest, top, 0)
                rooms[capacity - rest * n].append((top, 1))
                top += 1
    return out


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length): longer ones are cut into pieces of the capacity, the first of which takes what is over."""
    first = len(ids) % capacity or min(capacity, len(ids))
    at = 0
    for k in range(-(-len(ids) // capacity)):
        n = first if not k else capacity
        yield k, at, n
        at += n


def tokenize_pieces(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[int]]]], id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, in the order of the rows. ``encoder`` is called once per task."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    whole = np.array([*ids, end_id], "<u4")
                    for k, start, n in cut(whole, capacity):
                        own = whole[start : start + n]
                        rows.append((doc, k, start, n, zlib.crc32(own.tobytes()), own.tolist() if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True))[: len(schema)], schema, strict=True)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ddl)


def byte_bpe_encoder(tokenizer_json: str, ranks_file: str | None = None, pattern: str | None = None) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """Encoder for the tokenizer file, without added special tokens.

    With a ranks file of the same vocabulary, texts go through tiktoken, which gives the same ids about five times as
    fast; those that hold one of the tokenizer's special strings, and those it fails on, go through tokenizers itself.
    """

    def make() -> Callable[[list[str]], list[list[int]]]:
        import base64

        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer_json)
        if not ranks_file:
            return lambda texts: [own.encode(t, add_special_tokens=False).ids for t in texts]
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        special = [x.content for x in own.get_added_tokens_decoder().values()]

        def one(text: str) -> list[int]:
            if not any(s in text for s in special):
                try:
                    return fast.encode_ordinary(text)
                except (KeyboardInterrupt, SystemExit, MemoryError, GeneratorExit):
                    raise
                except BaseException as e:  # a Rust panic isn't an Exception
                    if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                        raise
            return own.encode(text, add_special_tokens=False).ids

        return lambda texts: [one(t) for t in texts]

    return make


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with doc_id, piece, start, length, ids_crc32) with sequence_id and offset beside its columns; columns of these two names are replaced, others may have any.
    A piece above the capacity is an error. Pieces of one length are ranked in buckets whose number follows that of all pieces."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "pack")
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    order = ["doc_id", "piece", "ids_crc32"]
    marked = scratch.put(pieces.select(packed(names).alias("row"), "length", *order, F.xxhash64(*order).alias("h")), "pieces")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-marked.count() // BUCKET_ROWS))
    marked = marked.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")).drop("h")
    counts = scratch.put(marked.groupBy("length", "bucket").agg(F.count("*").alias("m")), "counts")
    #: At most one row per length.
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("m").alias("n")).collect()}
    if max(total, default=0) > capacity:
        raise ValueError(f"a piece of {max(total)} doesn't fit a sequence of {capacity}")
    plan = sorted(plan_packing(total, capacity))
    table = spark.sparkContext.broadcast(np.array(plan, np.int64).reshape(-1, 6))

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = table.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = p[np.searchsorted((p[:, 0] << 48) + p[:, 1], (n << 48) + r, side="right") - 1]
        k = r - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 4] + k // row[:, 3], "offset": row[:, 5] + k % row[:, 3] * n})

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = marked.withColumn("rank", F.row_number().over(own)).join(offsets, ["length", "bucket"])
    placed = ranked.select("row", place("length", (F.col("before") + F.col("rank") - 1).cast("long")).alias("at"))
    return placed.select(*unpacked("row", names), "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[int]]]], id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """A row per piece: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Every document is its ids and ``end_id``, so null and empty texts are one piece of length 1. Only documents
    above ``capacity`` are cut. A sequence's pieces fill it from 0 without gaps. Repeated rows and ids are packed as
    often as they occur, null ids as well; equal pieces take either place. Other columns are ignored. An empty table
    gives an empty result. Texts are tokenized once; what is planned and ranked are lengths.
    """
    return place_pieces(tokenize_pieces(docs, encoder, id_col, text_col, capacity, end_id, with_ids), capacity)
