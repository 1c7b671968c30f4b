"""Repair of conversations by weighted finite-state composition.

Three machines are composed, lazily: the acceptor of a conversation's rows in order, the transducer of edits (keep, give
another role, delete, insert) and the acceptor of the role grammar, ``(s?(ua)+)?`` over the roles' initials. What is
wanted is the shortest path in topological order, row by row, whose weights are pairs (cost, labels) in lexicographic
order: the least cost, and of equal costs the labels that come first.

Rows are sorted over the whole table by ranges, so a conversation may lie in many tasks, and are numbered within pieces
of a bounded number of rows. A piece is solved alone, from each grammar state to each other: inserts come before a row, so no labels of
one piece begin with those of another path through it, and the order of whole paths is decided piece by piece. What the
pieces of a conversation pass on is a table of numbers each: costs, and the order of their labels.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.scratch import Scratch

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after s, after u, after a. The role that a row or an insert may be given in each, and the state it leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: What is wrong with a row, in the order in which faults count.
FINE, BLANK, DUPLICATE, TRUNCATION = range(4)
#: Rows of a piece, and edits of a result batch.
PIECE_ROWS, BATCH_ROWS = 512, 4096

Weight = tuple[int, str]


def _insertions(state: int) -> dict[int, Weight]:
    """The least weight of inserts alone from a state to each."""
    found, last = {state: (0, "")}, [state]
    while last:
        reached = [(found[s][0] + INSERT, found[s][1] + "I", GRAMMAR[s][r]) for s in last for r in ROLES if r in GRAMMAR[s]]
        last = [s for _, _, s in reached if s not in found]
        found |= {s: (c, labels) for c, labels, s in reached if s not in found}
    return found


@functools.cache
def arcs(initial: str, fault: int, state: int) -> tuple[tuple[int, str, int], ...]:
    """(cost, labels, next state) of the composed machines for one row in one state: inserts, then the row's own edit."""
    out = []
    stays = TRUNCATED * (fault == TRUNCATION)
    for between, (cost, labels) in _insertions(state).items():
        out.append((cost + DELETE, labels + "D", between))
        if fault in (BLANK, DUPLICATE):
            continue
        for role, to in GRAMMAR[between].items():
            if role == initial:
                out.append((cost + KEEP + stays, labels + "K", to))
            if role in ROLES:
                out.append((cost + REROLE + stays, labels + "R", to))
    return tuple(out)


def shortest(rows: str, start: int) -> dict[int, Weight]:
    """The least weight from a state through rows, two characters each (initial, fault), to every state that can be reached."""
    best: dict[int, Weight] = {start: (0, "")}
    for at in range(0, len(rows), 2):
        initial, fault = rows[at], int(rows[at + 1])
        reached: dict[int, Weight] = {}
        for state, (cost, labels) in best.items():
            for more, label, to in arcs(initial, fault, state):
                weight = (cost + more, labels + label)
                if to not in reached or weight < reached[to]:
                    reached[to] = weight
        best = reached
    return best


def endings() -> dict[int, Weight]:
    """The least weight from each state to a final one behind the last row."""
    return {s: min(w for to, w in _insertions(s).items() if to in FINAL) for s in GRAMMAR}


def walk(labels: str, initials: str, state: int) -> Iterator[tuple[int | None, str, str | None]]:
    """(row, edit, role given) of each label: row None for an insert, role None where a row keeps its own or goes."""
    row = 0
    for label in labels:
        if label in "DK":
            yield row, label, None
            state = GRAMMAR[state][initials[row]] if label == "K" else state
        else:
            role = next(r for r in GRAMMAR[state] if r in ROLES)
            yield (row if label == "R" else None), label, ROLES[role]
            state = GRAMMAR[state][role]
        row += label != "I"


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults planted by ``crc32('conv_id:turn') % 20``: 0 leaves the row out, 1 empties its text, 2 takes
    ``.``, ``!`` and ``?`` from it, 3 has the row twice, 4 makes the role user. For nulls in the hash, the role and the text a space stands."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def _fault(text: Column, duplicate: Column) -> Column:
    bare = F.rtrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(bare) == 0, BLANK).when(duplicate, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATION).otherwise(FINE)


class Repair:
    """Tables of one call: ``rows`` in pieces (piece, k, conv_id, turn, role, text, initial, fault), ``summary`` a row per conversation, ``edits`` of every piece."""

    def __init__(self, turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, piece_rows: int) -> None:
        spark = turns.sparkSession
        self.scratch = Scratch(spark, "repair")
        said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
        flat = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
        given = self.scratch.put(flat.select("*", F.monotonically_increasing_id().alias("id"), F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")).alias("same")), "given")
        #: All but the first of the rows that share conversation, role and text.
        place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "id")
        again = given.groupBy("same").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("same", "first")
        repeated = given.select("same", "id", place.alias("place")).join(again, "same").where(F.col("place") > F.col("first")).select("id", F.lit(True).alias("repeated"))
        fault = _fault(F.col("text"), F.coalesce("repeated", F.lit(False)))
        #: An initial that is no letter of the grammar is as good as any other such.
        initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("-")
        flagged = given.join(repeated, "id", "left").select("conv_id", "turn", "role", "text", "id", initial.alias("initial"), fault.alias("fault"))
        #: In order: turns, null first; rows of one turn by role, then by the beginning of the text, a hash, and their place.
        order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "lead", "hash", "id")]
        keyed = flagged.withColumns({"lead": F.left("text", F.lit(32)), "hash": F.xxhash64("text")})
        ranged = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "initial", "fault")
        self.rows = self.scratch.put(ranged.mapInArrow(_numbered(piece_rows), "conv_id long, turn long, role string, text string, initial string, fault int, piece long, k int"), "rows")
        self.scratch.drop("given")
        pieces = self.rows.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("k", F.concat("initial", F.col("fault").cast("string")).alias("code")))).alias("rows")).select("conv_id", "piece", F.array_join(F.col("rows.code"), "").alias("rows"))
        solved = self.scratch.put(pieces.mapInArrow(_solved, "conv_id long, piece long, rows string, cost array<int>, rank array<int>, labels array<string>, illegal long"), "solved")
        tables = solved.select("conv_id", "piece", "cost", "rank", "illegal", F.left("rows", F.lit(1)), F.left(F.right("rows", F.lit(2)), F.lit(1)))
        path = tables.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_path, "conv_id long, piece long, state int, pick int, ending string, cost long, illegal long")
        self.path = self.scratch.put(path, "path")
        chosen = solved.join(self.path.select("piece", "state", "pick", "ending"), "piece").select("conv_id", "piece", "rows", "state", F.concat(F.get("labels", F.col("pick")), "ending").alias("labels"))
        self.chosen = self.scratch.put(chosen, "chosen")
        self.scratch.drop("solved")


def _numbered(piece_rows: int):
    """Kernel: sorted rows with the piece they belong to, of one conversation and so many rows at most, and their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, k, last = TaskContext.get().partitionId() << 40, 0, None
        for batch in batches:
            pieces, places = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int32)
            for i, conv in enumerate(batch.column(0).to_pylist()):
                if last is None or (conv,) != last or k == piece_rows:
                    piece, k, last = piece + 1, 0, (conv,)
                pieces[i], places[i] = piece, k
                k += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces), pa.array(places)], names=["conv_id", "turn", "role", "text", "initial", "fault", "piece", "k"])

    return run


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: of each piece, by state before and after (index 4 * before + after), cost (-1: none), the labels and their order."""
    for batch in batches:
        costs, ranks, labels = [], [], []
        for rows in batch.column(2).to_pylist():
            cost, text = [-1] * 16, [None] * 16
            for start in GRAMMAR:
                for end, (c, own) in shortest(rows, start).items():
                    cost[4 * start + end], text[4 * start + end] = c, own
            at = {t: i for i, t in enumerate(sorted({t for t in text if t is not None}))}
            costs.append(cost)
            ranks.append([at.get(t, -1) for t in text])
            labels.append(text)
        illegal = [sum(a + b not in LEGAL for a, b in zip(r[::2], r[2::2], strict=False)) for r in batch.column(2).to_pylist()]
        own = [pa.array(costs, pa.list_(pa.int32())), pa.array(ranks, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.string())), pa.array(illegal, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=["conv_id", "piece", "rows", "cost", "rank", "labels", "illegal"])


def _through(cost: np.ndarray, rank: np.ndarray) -> tuple[list[int], list[int], str, int]:
    """The best path through a conversation's pieces by their tables: the state before each, the entry of the table that is taken, what is
    inserted behind the last, and the cost."""
    last = endings()
    left = np.zeros((len(cost) + 1, 4), np.int64)
    left[-1] = [last[s][0] for s in GRAMMAR]
    for p in range(len(cost) - 1, -1, -1):
        left[p] = (np.where(cost[p] < 0, 1 << 40, cost[p]) + left[p + 1]).min(axis=1)
    state, states, picks = START, [], []
    for p in range(len(cost)):
        total = np.where(cost[p, state] < 0, 1 << 40, cost[p, state]) + left[p + 1]
        best = np.flatnonzero(total == left[p, state])
        to = int(best[np.argmin(rank[p, state, best])])
        states.append(state)
        picks.append(4 * state + to)
        state = to
    return states, picks, last[state][1], int(left[0, START])


def _path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: of pieces in order, conversation after conversation, the path through each; of a piece its table and edges are held, no rows."""
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("state", pa.int32()), ("pick", pa.int32()), ("ending", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])
    open_: list[tuple] = []

    def closed() -> list[tuple]:
        states, picks, ending, cost = _through(np.array([o[2] for o in open_], np.int64).reshape(-1, 4, 4), np.array([o[3] for o in open_]).reshape(-1, 4, 4))
        before = [""] + [o[6] for o in open_[:-1]]
        n = len(open_)
        return [(o[0], o[1], states[i], picks[i], ending if i == n - 1 else "", cost if not i else 0, o[4] + (i > 0 and before[i] + o[5] not in LEGAL)) for i, o in enumerate(open_)]

    for batch in batches:
        out: list[tuple] = []
        tables = [batch.column(c).flatten().to_numpy().reshape(-1, 16).astype(np.int32) for c in (2, 3)]
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *tables, *[batch.column(c).to_pylist() for c in (4, 5, 6)], strict=True):
            if open_ and open_[0][0] != row[0]:
                out += closed()
                open_ = []
            open_.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if open_:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*closed(), strict=True), schema, strict=True)], schema=schema)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: a row per label of each piece."""
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("step", pa.int32()), ("k", pa.int32()), ("edit", pa.string()), ("given_role", pa.string())])
    for batch in batches:
        out: list[tuple] = []
        for conv, piece, rows, state, labels in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            out += [(conv, piece, step, *what) for step, what in enumerate(walk(labels, rows[::2], state))]
            if len(out) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _tables(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, piece_rows: int) -> tuple[Repair, DataFrame]:
    own = Repair(turns, conv_col, turn_col, role_col, text_col, piece_rows)
    edits = own.chosen.mapInArrow(_edited, "conv_id long, piece long, step int, k int, edit string, given_role string")
    said = own.rows.select(F.col("piece").alias("at_piece"), F.col("k").alias("at_k"), "turn", "role", "text")
    joined = edits.join(said, (F.col("piece") == F.col("at_piece")) & (F.col("k") == F.col("at_k")), "left")
    return own, joined.select("conv_id", "piece", "step", "edit", "turn", F.coalesce("given_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """A row per edit of the cheapest repair: (conv_id, piece, step, edit, turn, role, text), in order by piece and step within a conversation.

    edit is K, R, D or I; role is what it is afterwards, of a deleted row its own; inserted rows have an empty text and no turn. Without the
    deleted rows a conversation's roles read ``(s?(ua)+)?``. Rows without words and rows whose role and text stand earlier in the
    conversation are deleted. Turns are in order with nulls first; rows of one turn by role, the first 32 characters of the text and a
    hash of it, so equal rows are neighbours. Null roles and texts count as one space; a null conv_id is a conversation; other roles than the
    grammar's, also empty ones, can't be kept. Other columns are ignored. An empty table gives an empty result.
    """
    return _tables(turns, conv_col, turn_col, role_col, text_col, piece_rows)[1]


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: of rows in order, SHA-256 of each conversation's lines. Texts pass by; none is kept."""
    names, last, sha, any_line = ["conv_id", "repaired_sha256"], None, hashlib.sha256(), False
    for batch in batches:
        done: list[tuple] = []
        for conv, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if last != (conv,):
                if last is not None:
                    done.append((*last, sha.hexdigest()))
                last, sha, any_line = (conv,), hashlib.sha256(), False
            sha.update(f"\n{role}:{text}".encode()[not any_line :])
            any_line = True
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([sha.hexdigest()])], names=names)


def audit_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """A row per conversation that has rows: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Counts are of rows by their first fault; illegal counts neighbours whose roles' initials aren't su, ua or au; audit holds the
    edits of ``repair_conversations``, and the digest is of its rows as ``role:text``, joined by newlines. Only the digest reads a conversation's
    texts one after the other, as it has to, in one task that keeps none of them; all else is done piece by piece.
    """
    own, repaired = _tables(turns, conv_col, turn_col, role_col, text_col, piece_rows)
    kind = lambda f: F.count(F.when(F.col("fault") == f, True)).alias({BLANK: "blank", DUPLICATE: "duplicate", TRUNCATION: "truncated"}[f])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    faults = own.rows.groupBy("conv_id").agg(kind(BLANK), kind(DUPLICATE), kind(TRUNCATION))
    spread = own.rows.groupBy("conv_id").agg(gaps)
    costs = own.path.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    labels = own.chosen.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("piece", "labels")))["labels"], "").alias("audit"))
    lines = repaired.where("edit <> 'D'").repartition("conv_id").sortWithinPartitions("conv_id", "piece", "step").select("conv_id", "role", "text")
    digests = lines.mapInArrow(_digested, "conv_id long, repaired_sha256 string")
    out = faults
    for part in (spread, costs, labels, digests):
        names = [c for c in part.columns if c != "conv_id"]
        part = part.select(F.col("conv_id").alias("own_id"), *names)
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("own_id")), "left").drop("own_id")
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def repair_oracle() -> str:
    """The path by states, row after row; of rows that share a turn and a role the order is that of their texts."""
    return r"""
WITH RECURSIVE said AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(s[i:i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384::BIGINT)), 4294967295::BIGINT) % 20 AS kind FROM said),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE r END AS r, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS t
  FROM (SELECT *, unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS k FROM damaged),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(t, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, r, t ORDER BY k) > 1 THEN 2
    WHEN NOT regexp_matches(t, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault, lead(r) OVER (PARTITION BY conv_id ORDER BY k) AS after FROM ranked),
grammar(state, role, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
added(state, till, c, a) AS (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
edits AS (SELECT i.state, i.c + 4 AS c, i.a || 'D' AS a, i.till AS next, NULL AS needs, 0 AS bare FROM added i
  UNION ALL SELECT i.state, i.c, i.a || 'K', g.next, g.role, 1 FROM added i JOIN grammar g ON g.state = i.till
  UNION ALL SELECT i.state, i.c + 3, i.a || 'R', g.next, NULL, 1 FROM added i JOIN grammar g ON g.state = i.till AND g.role <> 's'),
path AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS state, {'c': 0, 'a': ''} AS w FROM judged
  UNION ALL SELECT p.conv_id, n.k, e.next, min({'c': p.w.c + e.c + CASE WHEN n.fault = 3 THEN 3 * e.bare ELSE 0 END, 'a': p.w.a || e.a})
  FROM path p JOIN judged n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.k = p.k + 1 JOIN edits e ON e.state = p.state
    AND (e.needs IS NULL OR e.needs = left(n.r, 1)) AND (e.bare = 0 OR n.fault NOT IN (1, 2)) GROUP BY p.conv_id, n.k, e.next),
counts AS (SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (k < m AND left(r, 1) || left(after, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, max(k) OVER (PARTITION BY conv_id) AS m FROM judged) GROUP BY conv_id),
ended AS (SELECT p.conv_id, min({'c': p.w.c + i.c, 'a': p.w.a || i.a}) AS w FROM path p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.k JOIN added i ON i.state = p.state AND i.till IN (0, 3) GROUP BY p.conv_id),
labels AS (SELECT conv_id, unnest(string_split(w.a, '')) AS x, generate_subscripts(string_split(w.a, ''), 1) AS pos FROM ended),
placed AS (SELECT *, count(*) FILTER (x <> 'I') OVER b AS k, count(*) FILTER (x <> 'D') OVER b AS m FROM labels WINDOW b AS (PARTITION BY conv_id ORDER BY pos)),
led AS (SELECT p.conv_id, bool_or(p.m = 1 AND p.x = 'K' AND left(n.r, 1) = 's') AS s FROM placed p JOIN judged n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.k = p.k GROUP BY p.conv_id),
lines AS (SELECT p.conv_id, p.pos, CASE WHEN p.x = 'K' THEN n.r WHEN (p.m + led.s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN p.x = 'I' THEN '' ELSE n.t END AS line
  FROM placed p JOIN led ON led.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN judged n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.k = p.k WHERE p.x <> 'D'),
digests AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY pos)) AS d FROM lines GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.w.c, 0)::BIGINT AS cost,
  coalesce(e.w.a, '') AS audit, coalesce(d, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN digests g ON g.conv_id IS NOT DISTINCT FROM a.conv_id"""
