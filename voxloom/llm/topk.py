"""Exact top-k inner-product search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt into groups, one task's work each, and shuffled once. A group cuts its vectors into blocks and sorts, for every
dimension, a block's vectors by that component; lists are built once. Queries lie in a table in the shared folder, and every
group streams it in batches, so queries aren't shuffled and none is held longer than its batch.

For a query the lists are read from the end that its component's sign favours. An object that is seen in any list is scored once.
No unseen one can score above the sum of the query's products with the values that the lists have come to, the bound; the next lists to
be read are those that lower it most for a row. Reading stops when the bound is below the kth score, or when all objects have been seen. The kth score goes from block to block of a
group, and a block whose first bound can't beat it isn't read at all. A first few groups are searched before the others, whose
results then need only beat the kth score of those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.scratch import Scratch

#: Vectors of a group and of a block, bytes of a group, and queries of a batch.
GROUP_ROWS, BLOCK_ROWS, GROUP_BYTES, BATCH_QUERIES = 131_072, 8192, 64 << 20, 2048
#: Rows of a list up to which it is read first; each further step doubles them. Lists that are read between two looks at the bound.
FIRST_DEPTH, LISTS_READ = 16, 16
#: Groups that are all searched at once; of more, some come first.
FEW_GROUPS = 64
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
#: Stands for no score and no id; below and above all others.
_NONE, _NO_ID = 1 - 2**63, 2**63 - 1


def _unique(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One vector per id, the least in lexicographic order, by id."""
    order = np.lexsort((*rows.T[::-1], ids))
    ids, rows = ids[order], rows[order]
    first = np.concatenate(([True], ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
    return ids[first], rows[first]


class Best:
    """The k best of each query of a batch, ties to the smaller id."""

    def __init__(self, queries: int, k: int, dtype: np.dtype) -> None:
        self.scores, self.ids = np.full((queries, k), _NONE, dtype), np.full((queries, k), _NO_ID, np.int64)

    @property
    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def take(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        fit = scores >= self.scores[query, -1]
        scores, ids = scores[fit], ids[fit]
        if len(scores) > 4 * k:
            enough = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, ids = scores[enough], ids[enough]
        scores, ids = np.concatenate((self.scores[query], scores)), np.concatenate((self.ids[query], ids))
        order = np.lexsort((ids, -scores))[:k]
        self.scores[query], self.ids[query] = scores[order], ids[order]


class SortedLists:
    """A block of vectors, by id, with its lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows, (self.n, dims) = ids, rows, rows.shape
        #: A list in a row, from the smallest component to the largest.
        self.lists = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T.astype(np.int32))
        self.depths = [0]
        while self.depths[-1] < self.n:
            self.depths.append(min(self.n, max(FIRST_DEPTH, 2 * self.depths[-1])))
        at = lambda place: rows[self.lists[:, place], np.arange(dims)]
        #: The values that a list has come to at each depth, from above and from below; at depth 0 its extremes.
        self.tops = np.array([at(self.n - max(d, 1)) for d in self.depths])
        self.lows = np.array([at(max(d, 1) - 1) for d in self.depths])
        self.steps = np.diff(self.depths)

    def search(self, query: np.ndarray, own: int, best: Best, q: int) -> tuple[int, int]:
        """Put this block's vectors into the q-th row of ``best``; the result is how many rows of lists were read and how many objects scored."""
        products = np.maximum(query, 0) * self.tops + np.minimum(query, 0) * self.lows
        if products[0].sum() < best.kth[q]:
            return 0, 0
        seen, read, scored = np.zeros(self.n, bool), 0, 0
        place = np.searchsorted(self.ids, own)
        if place < self.n and self.ids[place] == own:
            seen[place] = True
        at, every = np.zeros(len(query), np.int64), np.arange(len(query))
        last = len(self.depths) - 1
        fall = (products[:-1] - products[1:]) / self.steps[:, None]
        chosen = np.flatnonzero(query)
        while True:
            fresh = np.zeros(self.n, bool)
            for d in chosen.tolist():
                low, high = self.depths[at[d]], self.depths[at[d] + 1]
                fresh[self.lists[d, self.n - high : self.n - low] if query[d] > 0 else self.lists[d, low:high]] = True
                read += high - low
            at[chosen] += 1
            rows = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            scored += len(rows)
            best.take(q, self.rows[rows] @ query, self.ids[rows])
            #: An unseen object's score is at most the bound; strictly below the kth score it can't tie either.
            if products[at, every].sum() < best.kth[q] or seen.all():
                return read, scored
            open_ = np.flatnonzero((at < last) & (query != 0))
            if not len(open_):
                #: Where no component decides, all that is unseen scores alike.
                rows = np.flatnonzero(~seen)
                best.take(q, self.rows[rows] @ query, self.ids[rows])
                return read, scored + len(rows)
            gains = fall[at[open_], open_]
            chosen = open_[np.argsort(-gains, kind="stable")[:LISTS_READ]]


def _matrix(ids: pa.ChunkedArray, vectors: pa.ChunkedArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = ids.to_numpy()
    return _unique(found, np.floor(flat * scale).reshape(len(found), -1) if len(found) else np.zeros((0, 0)))


def _by_whole_numbers(ids: np.ndarray, rows: np.ndarray, own: np.ndarray, asked: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """The k best of vectors whose products may not fit 64 bits, by Python's whole numbers, one query after the other."""
    exact = [[int(x) for x in row] for row in rows.tolist()]
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for q, query in zip(own.tolist(), asked.tolist(), strict=True):
        whole = [int(x) for x in query]
        scores = sorted((-sum(a * b for a, b in zip(row, whole, strict=True)), i) for i, row in zip(ids.tolist(), exact, strict=True) if i != q)[:k]
        for score, i in scores:
            if not -(2**63) <= -score < 2**63:
                raise OverflowError(f"the score of vectors {q} and {i} doesn't fit 64 bits")
            for column, value in zip(out, (q, i, -score), strict=True):
                column.append(value)
    return out


def _batches(folder: str, dims: int) -> Iterator[pa.Table]:
    """The queries of so many dimensions, from the files of their table."""
    store, base = fs.FileSystem.from_uri(folder)
    for info in sorted(store.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda i: i.path):
        if info.is_file and info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(BATCH_QUERIES, columns=["vec_id", "dim", "embedding", "kth"]):
                    table = pa.Table.from_batches([batch])
                    if len(table := table.filter(pa.array(table["dim"].to_numpy() == dims))):
                        yield table


def search_group(vectors: pa.Table, queries: Iterator[pa.Table], k: int, scale: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Kernel of one group: the k best of its vectors for every query, a batch of queries at a time; those below the query's kth aren't given."""
    ids, rows = _matrix(vectors["vec_id"], vectors["embedding"], scale)
    cut = lambda r: [SortedLists(ids[at : at + block_rows], r[at : at + block_rows]) for at in range(0, len(ids), block_rows)]
    blocks: dict[type, list[SortedLists]] = {}
    top = float(np.abs(rows).max(initial=0))
    for batch in queries:
        if not len(batch):
            continue
        own, asked = _matrix(batch["vec_id"], batch["embedding"], 1)
        most = top * float(np.abs(asked).max(initial=0)) * max(1, rows.shape[1])
        if most >= 2.0**62:
            found = _by_whole_numbers(ids, rows, own, asked, k)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], schema=_OUT)
            continue
        kind = np.float64 if most < 2.0**53 else np.int64  # sums that doubles can't hold
        if kind not in blocks:
            blocks[kind] = cut(rows.astype(kind))
        asked = asked.astype(kind)
        floor = dict(zip(batch["vec_id"].to_pylist(), batch["kth"].to_pylist(), strict=True))
        best = Best(len(own), k, asked.dtype)
        for q, query in enumerate(own.tolist()):
            if floor[query] is not None:
                best.scores[q] = floor[query]
        for block in blocks[kind]:
            for q, query in enumerate(own.tolist()):
                block.search(asked[q], query, best, q)
        found = best.ids != _NO_ID
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, found.sum(axis=1))), pa.array(best.ids[found]), pa.array(best.scores[found].astype(np.int64))], schema=_OUT)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k best rows of ``vectors`` with another id.

    Components become floor(scale * x); the score is their inner product, ties go to the smaller id. Vectors that are
    null or hold null or non-finite components, and rows without an id, take no part. Rows that repeat an id count once,
    with the vector that is least in lexicographic order. Vectors are only compared with vectors of the same length.
    A query gets fewer rows where there are fewer others; an empty table gives an empty result. A score among the best that
    doesn't fit 64 bits is an error. Queries are read from ``spark.checkpoint.dir`` through ``pyarrow.fs``. Vectors are shuffled
    once, whatever the number of queries; about the root of the groups' number is searched first, and the others pass on only what beats those.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    fit = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, least: int) -> tuple[DataFrame, int]:
        """Groups of group_rows at most, on the whole, and of so many bytes; for small tables as many as there are tasks, of ``least`` rows or more."""
        n, dims = df.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
        most = max(1, min(group_rows, GROUP_BYTES // (8 * max(1, dims))))
        groups = max(-(-n // most), min(tasks, n // least), 1)
        return df.select("*", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part")), groups

    def clean(table: pa.Table) -> pa.Table:
        ids, rows = _matrix(table["vec_id"], table["embedding"], scale)
        return pa.table([pa.array(ids), pa.array(np.full(len(ids), rows.shape[1]), pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], names=["vec_id", "dim", "embedding"])

    asked = scratch.put(dealt(fit(queries), 4096)[0].groupBy("dim", "part").applyInArrow(clean, "vec_id long, dim int, embedding array<double>"), "asked")

    def search(vectors: DataFrame, name: str) -> DataFrame:
        folder = f"{scratch.path}/{name}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches))
            dims = len(table["embedding"][0])
            yield from search_group(table.select(["vec_id", "embedding"]), _batches(folder, dims), k, scale, block_rows)

        return vectors.groupBy("dim", "part").applyInArrow(run, "query_id long, vec_id long, score long")

    placed, groups = dealt(fit(vectors), 1024)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = math.isqrt(groups - 1) + 1 if groups > FEW_GROUPS else groups
    scratch.put(asked.withColumn("kth", F.lit(None).cast("long")), "queries")
    found = ranked(search(placed.where(F.col("part") < first), "queries"))
    if first < groups:
        found = scratch.put(found, "first")
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
        scratch.put(asked.join(kth, "vec_id", "left"), "bounded")
        found = ranked(found.drop("rank").unionByName(search(placed.where(F.col("part") >= first), "bounded")))
    return found.select("query_id", "rank", "vec_id", "score")


def top_k_oracle() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
