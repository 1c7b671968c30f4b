"""Interactions of filters in every order, from a packed bitmap index.

Each partition packs, for each part of the table, one bitset per filter (its failures) and per mark. What an order keeps
after some filters is the part AND NOT the union of their failures, whatever their order, so one popcount for each subset
of filters, and one for each mark within it, gives every step of every order. The partitions' counts are summed; nothing
else leaves them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Limits of the text filters, and characters that one of them looks for: fixed values of the contract.
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
SYMBOLS, UPPER = b"#$%&*|", bytes(range(ord("A"), ord("Z") + 1))
#: Parts that a partition holds counts of before it passes them on.
HELD_PARTS = 4096


def _text_bits(text: bytes) -> int:
    """Failures of the four filters that a text decides alone, lowest bit first. ``split`` parts at the white space of ``[\\x20\\x09-\\x0D]``."""
    words = text.split()
    points = len(text) if text.isascii() else int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())
    upper = len(text) - len(text.translate(None, UPPER))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * upper > UPPER_PERCENT * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def text_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row per row of ``docs``: (part, A, B, C, D, E, good, toxic), booleans: which filters it fails, and what it is labelled.

    A: fewer than 200 words; B: fewer than half of its words are distinct; C: more than 3 % of its code points are A to Z; D: one of
    ``#$%&*|``; E: the text of a smaller id, wherever in the table, by SHA-256. Null texts count as empty, a null part as an empty string. Null ids
    are never smaller than another and never fail E; rows that repeat an id don't fail E for each other. A document without a label is
    neither good nor toxic; of labels that repeat an id any counts. Other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, keys = [], []
            for value in batch.column(2):
                text = value.as_py() or b""
                bits.append(_text_bits(text))
                keys.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), pa.array(keys, pa.binary())], names=["id", "part", "bits", "text_key"])

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    judged = own.mapInArrow(run, "id long, part string, bits int, text_key binary")
    #: Only texts of more than one id; most rows find no partner here.
    first = judged.groupBy("text_key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("text_key", "first")
    mark = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(mark("quality"), mark("toxic"))
    joined = judged.join(first, "text_key", "left").join(known, "id", "left")
    fails = [(F.col("bits").bitwiseAND(1 << i) != 0).alias(name) for i, name in enumerate("ABCD")]
    return joined.select("part", *fails, F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E"), F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def subset_counts(failures: DataFrame, filters: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """(part, subset, counts): counts of the rows that fail none of a subset of the filters, a number whose bit i is the i-th; first of all
    such rows, then of those with each mark."""
    n, width = len(filters), 1 + len(marks)

    def index(columns: list[np.ndarray]) -> np.ndarray:
        """Popcounts of one part's rows, by subset and mark."""
        rows = len(columns[0])
        whole = np.packbits(np.ones(rows, bool))
        fail = [np.packbits(c) for c in columns[:n]]
        marked = [np.packbits(c) for c in columns[n:]]
        union, out = [np.zeros_like(whole)], np.zeros((1 << n, width), np.int64)
        for subset in range(1 << n):
            if subset:
                low = (subset & -subset).bit_length() - 1
                union.append(union[subset & (subset - 1)] | fail[low])
            kept = whole & ~union[subset]
            out[subset] = [np.bitwise_count(kept & m).sum(dtype=np.int64) for m in [whole, *marked]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def counted() -> pa.RecordBatch:
            parts = list(held)
            flat = [row.tolist() for p in parts for row in held[p]]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(parts, object), 1 << n).tolist(), pa.string()), pa.array(list(range(1 << n)) * len(parts), pa.int32()), pa.array(flat, pa.list_(pa.int64()))], names=["part", "subset", "counts"])

        for batch in batches:
            if not len(batch):
                continue
            codes = batch.column(0).dictionary_encode()
            names, of = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            order = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[order], np.arange(len(names) + 1))
            columns = [c.to_numpy(zero_copy_only=False).astype(bool)[order] for c in batch.columns[1:]]
            for i, name in enumerate(names):
                found = index([c[edges[i] : edges[i + 1]] for c in columns])
                held[name] = held[name] + found if name in held else found
            if len(held) >= HELD_PARTS:
                yield counted()
                held = {}
        if held:
            yield counted()

    flags = [F.coalesce(F.col(f"`{c}`"), F.lit(False)).alias(f"c{i}") for i, c in enumerate([*filters, *marks])]
    found = failures.select("part", *flags).mapInArrow(run, "part string, subset int, counts array<long>")
    return found.groupBy("part", "subset").agg(F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(width)]).alias("counts"))


def audit_filters(failures: DataFrame, filters: Sequence[str], marks: Sequence[str] = ()) -> DataFrame:
    """A row per part, order of the filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails, <marks>, shapley).

    ``failures`` has part, a boolean column per filter (true: it fails; null: it doesn't) and one per mark. The step's filter is that letter of
    filter_order. kept: rows after this step; removed: rows that go here; redundant: rows that fail the filter but went earlier; unique_fails: rows that
    fail it alone; a mark's column counts the marked rows that go here; shapley: what the filter removes, summed over all orders. Filters are single
    letters, at most seven, for there are as many orders as their factorial. Parts come from the rows: an empty table gives an empty result.
    """
    n = len(filters)
    if not 1 <= n <= 7:
        raise ValueError("from one to seven filters")
    whole = (1 << n) - 1
    counts = F.map_from_entries(F.collect_list(F.struct("subset", "counts"))).alias("of")
    parts = subset_counts(failures, filters, marks).groupBy("part").agg(counts)
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in itertools.permutations(filters)])).alias("filter_order")
    steps = parts.select("part", "of", orders).select("part", "of", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bit = lambda letter: F.pow(F.lit(2), F.instr(F.lit("".join(filters)), letter) - 1).cast("int")
    nth = lambda i: F.substring(F.col("filter_order"), i, F.lit(1))
    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda acc, i: acc + F.when(i > 0, bit(nth(i))).otherwise(0))
    placed = steps.select("part", "of", "filter_order", "step", nth(F.col("step")).alias("letter"), bit(nth(F.col("step"))).alias("own"), before.alias("before"))
    at = lambda subset, i=0: F.get(F.element_at("of", subset), F.lit(i))
    then = F.col("before") + F.col("own")
    removed = at(F.col("before")) - at(then)
    rows = placed.select(
        "part", "filter_order", "step", "letter", at(then).alias("kept"), removed.alias("removed"), (at(F.lit(0)) - at(F.col("own")) - removed).alias("redundant"),
        (at(F.lit(whole) - F.col("own")) - at(F.lit(whole))).alias("unique_fails"), *[(at(F.col("before"), i) - at(then, i)).alias(m) for i, m in enumerate(marks, 1)],
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit_oracle() -> str:
    return r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x) JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, s::INT AS step, filter_order[s:s] AS letter, 1 << (ascii(filter_order[s:s]) - 65) AS own,
    list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(filter_order[i:i]) - 65))) AS earlier FROM orders, range(1, 6) r(s)),
r AS (SELECT part, filter_order, step, letter,
    sum(n) FILTER (fails & (coalesce(earlier, 0) | own)::INT = 0) AS kept,
    sum(n) FILTER (fails & coalesce(earlier, 0)::INT = 0 AND fails & own <> 0) AS removed,
    sum(n) FILTER (fails & coalesce(earlier, 0)::INT <> 0 AND fails & own <> 0) AS redundant,
    sum(n) FILTER (fails = own) AS unique_fails,
    sum(good) FILTER (fails & coalesce(earlier, 0)::INT = 0 AND fails & own <> 0) AS good_lost,
    sum(toxic) FILTER (fails & coalesce(earlier, 0)::INT = 0 AND fails & own <> 0) AS toxic_lost
  FROM c, steps GROUP BY ALL),
z AS (SELECT part, filter_order, step, letter, COLUMNS(lambda x: x IN ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))::BIGINT FROM r)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
  coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM z"""
