"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel, so a linear fit on them separates along curved borders. Every partition sums
its normal equations; a sum is of fixed size, whatever the rows, there are at most ``MAX_SUMS`` of them, and they are added in two levels, in
the order of partitions. Scores of rows kept aside from the fit are calibrated by pooling adjacent violators over a bounded number of bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.scratch import Scratch

from .ngram_join import _SPACE, _blocks, word_hashes

#: Fourier features, the ridge's weight to a row, the seed of the features, and score bins of the calibration.
FEATURES, RIDGE, SEED, BINS = 256, 1e-3, 11, 512
#: Partitions of training rows that give a sum at most, and sums that are added by one task.
MAX_SUMS, ADDED = 4096, 64
STATISTICS = ("log_words", "word_length", "word_spread", "upper", "digits", "marks", "symbols", "pipes", "stops", "wide", "distinct", "pairs", "top", "dup_lines", "line_words")

_CLASSES = np.zeros((256, 7), np.int64)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", "#*$%&<>@^~=+_\\/{}[]", "|", ".,;:")):
    _CLASSES[[ord(c) for c in _chars], _k] = 1
_CLASSES[128:, 6] = 1


def document_statistics(texts: list[bytes]) -> np.ndarray:
    """A row of ``STATISTICS`` per whole text; texts without words have zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    words, counts = word_hashes(texts)
    with np.errstate(over="ignore"):
        pairs = words[:-1] * np.uint64(3) + words[1:] if len(words) else words
    at = 0
    for k, (text, n) in enumerate(zip(texts, counts.tolist(), strict=True)):
        if not n:
            continue
        data = np.frombuffer(text, np.uint8)
        of = np.bincount(data, minlength=256) @ _CLASSES
        inside = np.concatenate(([False], ~_SPACE[data], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        lengths = edge[1::2] - edge[::2]
        chars = int(lengths.sum())
        own = words[at : at + n]
        _, often = np.unique(own, return_counts=True)
        two = len(np.unique(pairs[at : at + n - 1])) / (n - 1) if n > 1 else 1.0
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[k] = (np.log1p(n), chars / n, lengths.std(), of[0] / chars, of[1] / chars, of[2] / n, of[3] / n, of[4] / n, of[5] / n, of[6] / chars, len(often) / n, two, often.max() / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)))
        at += n
    return out


def statistics_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, s) per row."""
    schema = pa.schema([("doc_id", pa.int64()), ("s", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(document_statistics(texts)), schema.field(1).type)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, s array<double>")


class FourierFeatures:
    """cos(x W + b) of standardised statistics, with a constant; W and b follow from the seed."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-12, spread, 1.0)
        self.w = draw.normal(size=(len(mean), features)) / np.sqrt(len(mean))
        self.b = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        x = np.clip((s - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b), np.ones((len(x), 1))])


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("s").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(batch), -1) if len(batch) else np.zeros((0, len(STATISTICS)))


def fit_ridge(train: DataFrame, phi: FourierFeatures, ridge: float = RIDGE) -> np.ndarray:
    """Weights from rows (s, y): each partition gives one matrix, in rows; rows of a number are added by ``ADDED``, then these sums."""
    size = len(phi.b) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size + 1)), 0
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                z = phi(_rows(part))
                total += z.T @ np.hstack([z, part.column("y").to_numpy(zero_copy_only=False)[:, None]])
                n += len(part)
        if n:
            yield pa.RecordBatch.from_pydict({"i": range(size), "part": [TaskContext.get().partitionId()] * size, "v": list(total)}, schema=pa.schema([("i", pa.int32()), ("part", pa.int32()), ("v", pa.list_(pa.float64()))]))

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table["part"].to_numpy(), kind="stable")
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)[order]
        first = lambda c: pa.array([table[c][0].as_py()], pa.int32())
        return pa.table({"i": first("i"), "part": first("level"), "level": first("level"), "v": pa.array([v.sum(axis=0)], pa.list_(pa.float64()))})

    ddl = "i int, part int, level int, v array<double>"
    rows = train.select("s", F.col("y").cast("double").alias("y")).coalesce(MAX_SUMS)
    parts = rows.mapInArrow(sums, "i int, part int, v array<double>").withColumn("level", F.floor(F.col("part") / ADDED).cast("int"))
    parts = parts.groupBy("i", "level").applyInArrow(add, ddl)
    got = {r["i"]: r["v"] for r in parts.groupBy("i").applyInArrow(add, ddl).collect()}
    if not got:
        return np.zeros(size)
    whole = np.array([got[i] for i in range(size)])
    penalty = np.eye(size) * ridge * max(1.0, whole[-1, -2])
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(whole[:, :-1] + penalty, whole[:, -1])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        blocks.append([b * w, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w2, _, high = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w2
            blocks[-1][3] = high
    xs = [v for b in blocks for v in (b[2], b[3])]
    return np.array(xs), np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, keep_label: int = 1) -> DataFrame:
    """(doc_id, held_out, score) per row of ``docs``: the calibrated chance that the label is ``keep_label``.

    A row is held out if crc32 of its id as text, modulo ``folds``, is 0; labels of these are never read. Remainder 1
    calibrates, the others fit, with all their labelled rows. Inputs are counts over the whole text alone. Null and
    empty texts are scored like others. A null id isn't held out and has no label. Of repeated labels the least
    counts, null ones don't. Repeated rows are scored each; other columns are ignored; an empty table gives an empty
    result. Without labelled rows every score is 0.5.
    """
    scratch = Scratch(docs.sparkSession, "classifier")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    table = scratch.put(statistics_table(docs, id_col, text_col), "statistics").withColumn("fold", fold)
    marked = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.min("quality") == keep_label).cast("double").alias("y"))
    known = scratch.put(table.where(F.col("fold") != 0).join(marked, "doc_id").select("fold", "s", "y"), "known")
    moments = known.agg(*[f(F.get("s", F.lit(k))) for f in (F.avg, F.stddev_pop) for k in range(len(STATISTICS))]).first()
    mean, spread = (np.array([v or 0.0 for v in moments[k : k + len(STATISTICS)]]) for k in (0, len(STATISTICS)))
    phi = FourierFeatures(mean, spread)
    weights = fit_ridge(known.where("fold <> 1"), phi)

    def scorer(knots: tuple[np.ndarray, np.ndarray] | None, extra: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    part = batch.slice(at, 4096)
                    raw = phi(_rows(part)) @ weights
                    if knots is not None:
                        raw = np.interp(raw, *knots) if len(knots[0]) else np.full(len(part), 0.5)
                    yield pa.RecordBatch.from_arrays([part.column(extra), pa.array(raw)], names=[extra, "score"])

        return run

    calibrating = known.where("fold = 1").select("y", "s").mapInArrow(scorer(None, "y"), "y double, score double")
    place = F.floor(F.least(F.greatest(F.col("score"), F.lit(-0.5)), F.lit(1.5)) * (BINS // 2)).cast("int")
    bins = sorted(calibrating.groupBy(place.alias("bin")).agg(F.avg("score").alias("x"), F.avg("y").alias("p"), F.count("*").alias("n")).collect(), key=lambda r: r["bin"])
    knots = isotonic(*(np.array([r[c] for r in bins], float) for c in ("x", "p", "n")))
    named: Column = F.struct("doc_id", "fold")
    scored = table.select(named.alias("row"), "s").mapInArrow(scorer(knots, "row"), "row struct<doc_id: long, fold: long>, score double")
    return scored.select("row.doc_id", F.coalesce(F.col("row.fold") == 0, F.lit(False)).alias("held_out"), "score")
