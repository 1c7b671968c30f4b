"""N-gram Jaccard self-join by vertical partitioning.

The n-grams of all documents have one global order, their 64-bit hash. It is cut into equal fragments, and each
fragment is handled apart:

1. ``_postings`` puts the n-grams of a block of documents in order, cuts them into segments, one per fragment, and sends each
   n-gram of the block once, with the number of its documents there. Which documents these are isn't sent to the fragments.
2. A fragment adds the counts up to document frequencies, and sends back only the n-grams of two documents or more. Any other
   can't overlap with anything. An n-gram that every document has is one number from each block.
3. Back at the documents, n-grams are put in order of frequency. A link needs a common n-gram among the rarest
   ``n - ceil(t n) + 1``; a document whose prefix has n-grams of its own only has no partner and is done.
4. Documents with equal sets become one node. Nodes that share a prefix n-gram are candidates.
5. Candidate pairs get the partial overlap of each fragment apart, and these are summed per pair and held against t.

Candidates are found in rounds: first each list of nodes is compared with one hub, that whose n-grams are the most
frequent (the text that others were made from has the most in common with all), then with one by hash. Linked nodes
become components, and then only nodes of different components are compared, so a group of thousands of near copies costs
as many comparisons as it has members, and no link between components is lost. For that last round a list is dealt into
classes of like size: two classes meet only if their sizes and what they have left after the n-gram allow a link.

Fragments and the partitions that hold them follow the size of the input. A frequent n-gram's list is dealt by node into parts
of bounded length (``_dealt``), and the last round compares blocks of a list, so no n-gram is one task's work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.components import components
from voxloom.scratch import Scratch, plan_bytes

#: Bytes of text in a block, at least and at most, and of those that are hashed at once. They bound a task's memory.
CHUNK_BYTES, MAX_CHUNK_BYTES, HASH_BYTES = 4 << 20, 64 << 20, 1 << 20
#: Bytes of n-grams in a fragment and in a partition of fragments that are aimed at, and bits of a fragment's number.
FRAGMENT_BYTES, PARTITION_BYTES, FRAGMENT_BITS = 16 << 20, 16 << 20, (8, 20)
#: Bytes of text to a byte of compressed files, for the estimate of an input's size.
EXPANSION = 4
#: Rows of one key in a part, keys that may have more than one part at most (their table is broadcast), and nodes in a block of the last round.
PART_ROWS, MAX_HEAVY, BLOCK_NODES = 4096, 50_000, 1024
#: Ratio of sizes within a class of the last round.
CLASS_RATIO = 1.25
#: Fragments whose partial overlaps are counted apart when a pair is verified.
SEGMENTS = 8
HUB_ROUNDS = 2
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] += np.uint64(32)
_BYTE = _mix(_FOLD)
_P = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        x = np.full(max(n, HASH_BYTES + (1 << 18)), np.uint64(base))
        x[0] = 1
        _powers[name] = np.multiply.accumulate(x)
    return _powers[name][:n]


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """(number, text) in lists of about ``HASH_BYTES``; longer texts are cut at white space."""
    held, size = [], 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            stop = len(text)
            if stop - at > HASH_BYTES and (gap := _GAP.search(text, at + HASH_BYTES)):
                stop = gap.start()
            held.append((k, text[at:stop] if at or stop < len(text) else text))
            size += stop - at + 1
            at = stop
            if size >= HASH_BYTES:
                yield held
                held, size = [], 0
            if at >= len(text):
                break
    if held:
        yield held


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z folded, and each text's number of words; words are runs of other than ASCII white space."""
    found, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for part in _pieces(texts):
        data = np.frombuffer(b" ".join([*(t for _, t in part), b""]), np.uint8)
        inside = np.concatenate(([False], ~_SPACE[data], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            summed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power("p", _P, len(data)), dtype=np.uint64)))
            found.append(_mix((summed[end] - summed[start]) * _power("i", _P_INV, len(data))[start] + (end - start).astype(np.uint64) * _M2))
        bounds = np.cumsum([len(t) + 1 for _, t in part])
        np.add.at(counts, [k for k, _ in part], np.diff(np.searchsorted(start, bounds), prepend=0))
    return np.concatenate(found), counts


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, joined, and their number by text. Shorter texts have one n-gram of all their words; texts without words none."""
    words, n = word_hashes(texts)
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            acc = _mix(acc * _M3 + words[k : k + len(acc)]) if len(acc) else acc
        sets, at = [], 0
        for m in n.tolist():
            if m >= width:
                sets.append(np.unique(acc[at : at + m - width + 1]))
            elif m:
                one = np.full(1, np.uint64(m))
                for w in words[at : at + m]:
                    one = _mix(one * _M3 + w + _M1)
                sets.append(one)
            else:
                sets.append(words[:0])
            at += m
    return (np.concatenate(sets) if sets else words[:0]), np.array([len(s) for s in sets], np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Values of the first column and texts of the second, in lists of about ``chunk`` bytes."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc)
            texts.append(text or b"")
            size += len(texts[-1]) + 1
            if size >= chunk:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


#: A block's head has ids, tags, sizes, the document of each posting, and where each fragment's postings begin; its other rows are
#: n-grams of one fragment with their counts in the block, and on the way back which of them are shared, and their frequency.
_BLOCK = pa.schema([("frag", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("docs", pa.binary()), ("cuts", pa.binary()), ("grams", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("mask", pa.binary()), ("df", pa.binary())])
_BLOCK_DDL = "frag long, block long, ids array<long>, tags array<long>, sizes array<long>, docs binary, cuts binary, grams binary, counts binary, n long, mask binary, df binary"


def _block_rows(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(columns["frag"])
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in _BLOCK], schema=_BLOCK)


def _packed(grams: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each hash; what is above is the fragment's number."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(raw: bytes, width: int, top: int) -> np.ndarray:
    """Hashes of a fragment; top is its number in the bits above."""
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64) | np.uint64(top)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32 in as many bytes each as the largest needs."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // max(n, 1) or 1]).astype(np.int64)


def _postings(width: int, bits: int):
    """Map kernel: documents to one packed block per fragment; a fragment is what the top ``bits`` of hashes say."""
    frags, size, down = 1 << bits, 8 - bits // 8, np.uint64(64 - bits)
    chunk = min(MAX_CHUNK_BYTES, max(CHUNK_BYTES, frags * 448))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        for keys, texts in _blocks(batches, chunk):
            grams, n = shingle_sets(texts, width)
            order = np.argsort(grams, kind="stable")
            grams, doc = grams[order], np.repeat(np.arange(len(keys)), n)[order]
            first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))[: len(grams)])
            edges, own = np.append(first, len(grams)), grams[first]
            cut, counts = np.searchsorted(own >> down, np.arange(frags + 1, dtype=np.uint64)), np.diff(edges)
            some = np.flatnonzero(np.diff(cut)).tolist()
            parts = [slice(cut[f], cut[f + 1]) for f in some]
            yield _block_rows({"frag": some, "block": [seq] * len(some), "grams": [_packed(own[p], size) for p in parts], "counts": [_narrow(counts[p]) for p in parts]})
            yield _block_rows({"frag": [hash(seq) % frags], "block": [seq], "ids": [[k["id"] for k in keys]], "tags": [[k["tag"] for k in keys]], "sizes": [n.tolist()], "docs": [_narrow(doc)], "cuts": [edges[cut].astype("<u4").tobytes()]})
            seq += 1

    return run


def _shared(table: pa.Table, size: int) -> pa.Table:
    """Fragment kernel: of each block's n-grams those that two documents or more have, with their frequency."""
    blocks, raw, counts = table["block"].to_pylist(), table["grams"], table["counts"]
    heads = np.flatnonzero(raw.is_null().to_numpy(zero_copy_only=False)) if len(table) else np.zeros(0, np.int64)
    rows = np.setdiff1d(np.arange(len(table)), heads).tolist()
    frag = table["frag"][0].as_py()
    out: dict[str, list] = {f.name: [] for f in _BLOCK}
    if rows:
        parts = [_unpacked(raw[k].as_py(), size, 0) for k in rows]
        own = [_wide(counts[k].as_py(), len(p)) for k, p in zip(rows, parts, strict=True)]
        _, back = np.unique(np.concatenate(parts), return_inverse=True)
        df, at = np.minimum(np.bincount(back, weights=np.concatenate(own)), 0xFFFFFFFF).astype(np.uint32)[back], 0
        for k, part, count in zip(rows, parts, own, strict=True):
            all_, at = df[at : at + len(part)], at + len(part)
            if (keep := all_ > 1).any():
                row = {"frag": frag, "block": blocks[k], "grams": _packed(part[keep], size), "counts": _narrow(count[keep]), "n": len(part), "mask": np.packbits(keep).tobytes(), "df": _narrow(all_[keep])}
                for name, column in out.items():
                    column.append(row.get(name))
    return pa.concat_tables([table.take(heads).select(_BLOCK.names).cast(_BLOCK), pa.Table.from_batches([_block_rows(out)], schema=_BLOCK)])


_DOC = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("weight", pa.int64()), ("own", pa.int64()), ("prefix", pa.list_(pa.int64())), ("segments", pa.list_(pa.list_(pa.int64())))])
_DOC_DDL = "doc_id long, tag long, n long, node long, weight long, own long, prefix array<long>, segments array<array<long>>"


def _ordered(percent: int, bits: int):
    """Block kernel: each document's shared n-grams in the order of frequency; its prefix and its segments, or nulls where no partner is possible."""

    def run(table: pa.Table) -> pa.Table:
        head = next(k for k, ids in enumerate(table["ids"].to_pylist()) if ids is not None)
        ids, tags, n, block = table["ids"][head].as_py(), table["tags"][head].as_py(), np.array(table["sizes"][head].as_py()), table["block"][0].as_py()
        docs, cuts = _wide(table["docs"][head].as_py(), int(n.sum())), np.frombuffer(table["cuts"][head].as_py(), "<u4").astype(np.int64)
        grams, doc, df = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(table["grams"].is_valid().to_numpy(zero_copy_only=False)).tolist():
            row = table.slice(k, 1).to_pylist()[0]
            keep = np.unpackbits(np.frombuffer(row["mask"], np.uint8), count=row["n"]).astype(bool)
            shared = _unpacked(row["grams"], 8 - bits // 8, row["frag"] << (64 - bits))
            count = np.ones(row["n"], np.int64)
            count[keep] = _wide(row["counts"], len(shared))
            first, own = (np.cumsum(count) - count)[keep] + cuts[row["frag"]], count[keep]
            place = np.repeat(first - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            grams.append(np.repeat(shared, own))
            doc.append(docs[place])
            df.append(np.repeat(_wide(row["df"], len(shared)), own))
        grams, doc, df = np.concatenate(grams), np.concatenate(doc), np.concatenate(df)
        order = np.lexsort((grams, df, doc))
        grams, doc = grams[order], doc[order]
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        shared = np.diff(cut)
        own = n - shared
        first = n - (percent * n + 99) // 100 + 1
        live = (own < first) & (n > 0)
        summed = np.concatenate(([0], np.cumsum(df[order])))
        weight = ((summed[cut[1:]] - summed[cut[:-1]] + own) << 10) // np.maximum(n, 1)
        nodes, prefix, segments = [None] * len(ids), [None] * len(ids), [None] * len(ids)
        for k in np.flatnonzero(live).tolist():
            x = grams[cut[k] : cut[k + 1]]
            prefix[k] = x[: first[k] - own[k]].view(np.int64)
            with np.errstate(over="ignore"):
                salt = np.uint64(n[k]) if not own[k] else _mix(np.array([block, k, own[k]], np.int64).view(np.uint64)).sum(dtype=np.uint64) | np.uint64(1 << 40)
                nodes[k] = int(_mix(np.array([_mix(x).sum(dtype=np.uint64) + _mix(x ^ _M2).sum(dtype=np.uint64) * _M3 + _mix(np.array([salt]))[0]])).view(np.int64)[0])
            seg = x >> np.uint64(61)
            segments[k] = [np.sort(x[seg == s]).view(np.int64) for s in range(SEGMENTS)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((ids, tags, n, nodes, weight, own, prefix, segments), _DOC, strict=True)], schema=_DOC)

    return run


def fragments_for(size: int, partitions: int) -> tuple[int, int]:
    """(bits of a fragment's number, partitions of fragments) for so many bytes of n-grams."""
    low, high = FRAGMENT_BITS
    parts = max(partitions, min(1 << high - 2, -(-size // PARTITION_BYTES)))
    return min(high, max(low, (size // FRAGMENT_BYTES).bit_length(), partitions.bit_length() + 1)), parts


def shared_ngrams(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, tag_col: str | None = None) -> DataFrame:
    """Steps 1 to 3: a row per document, with (node, prefix, segments) only where a link is possible."""
    text = F.col(text_col).cast("binary")
    size = plan_bytes(docs)
    if size is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    else:
        size *= EXPANSION
    bits, parts = fragments_for(size, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tag = (F.lit(None) if tag_col is None else F.col(tag_col)).cast("long")
    texts = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), tag.alias("tag")).alias("key"), text.alias("text"))
    blocks = texts.mapInArrow(_postings(width, bits), _BLOCK_DDL)
    kept = blocks.repartition(parts, "frag").groupBy("frag").applyInArrow(lambda t: _shared(t, 8 - bits // 8), _BLOCK_DDL)
    return kept.repartition(parts, "block").groupBy("block").applyInArrow(_ordered(percent, bits), _DOC_DDL)


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Step 5: the pairs (a, b, na, nb) whose partial overlaps, one of each fragment, add up to the threshold."""
    of_b = pairs.join(segments.toDF("b", "frag", "grams_b"), "b")
    both = of_b.join(segments.toDF("a", "frag", "grams_a"), ["a", "frag"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("grams_a", "grams_b")).alias("part"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common"))
    return summed.where(F.col("common") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _dealt(df: DataFrame, key: str, by: list[str], counts: DataFrame) -> DataFrame:
    """``df`` with (parts, part): keys with many rows are dealt into parts by a hash of the columns ``by``; every other key is one part.

    ``counts`` has (key, m). The table of keys with several parts is broadcast: the bound on a part's rows rises with the
    table, so that it never has more than ``MAX_HEAVY`` rows.
    """
    total = counts.agg(F.sum("m")).first()[0] or 0
    most = max(PART_ROWS, -(-total // MAX_HEAVY))
    heavy = counts.where(F.col("m") > most).select(key, F.ceil(F.col("m") / most).cast("int").alias("parts"))
    marked = df.join(F.broadcast(heavy), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return marked.withColumn("part", F.pmod(F.xxhash64(*by, F.lit("part")), F.col("parts")).cast("int"))


def _to_all_parts(df: DataFrame) -> DataFrame:
    """Rows of ``df`` (with parts) once for each part of their key."""
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _block_pairs(scratch: Scratch, open_lists: DataFrame, percent: int) -> DataFrame:
    """Last round: pairs of nodes of one list and different components, block by block.

    A list's nodes are dealt into classes by size and by whether they are of the list's largest component. Classes meet if
    the smallest size and the largest rest in them allow a link, and hold more than one component between them. What meets
    are blocks of ``BLOCK_NODES`` nodes, each pair of blocks under its own key.
    """
    sizes = open_lists.groupBy("gram", "comp").agg(F.count("*").alias("m"), F.first("parts").alias("parts"))
    major = sizes.groupBy("gram").agg(F.max_by("comp", F.struct("m", "comp")).alias("major"), F.first("parts").alias("parts"))
    size_class = F.floor(F.log("n") / F.log(F.lit(CLASS_RATIO))).cast("int") * 2 + (F.col("comp") == F.col("major")).cast("int")
    nodes = scratch.put(open_lists.join(_to_all_parts(major), ["gram", "part"]).withColumn("k", size_class).drop("weight", "major"), "classed")
    classes = nodes.groupBy("gram", "k").agg(F.min("n").alias("n"), F.max("rest").alias("rest"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("blocks"), F.first("parts").alias("parts"))
    classes = scratch.put(classes, "classes")
    x, y = (classes.select("gram", *[F.col(c).alias(f"{s}{c}") for c in ("k", "n", "rest", "c0", "c1", "blocks")]) for s in "xy")
    allowed = (100 + percent) * F.least("xrest", "yrest") >= percent * (F.col("xn") + F.col("yn"))
    meet = x.join(y, "gram").where((F.col("xk") <= F.col("yk")) & allowed & (F.least("xc0", "yc0") != F.greatest("xc1", "yc1")))
    blocks = lambda s: F.explode(F.sequence(F.lit(0), F.col(f"{s}blocks") - 1)).alias(f"{s}b")
    meet = meet.select("gram", "xk", "yk", "xblocks", "yblocks", blocks("x")).select("*", blocks("y")).where((F.col("xk") < F.col("yk")) | (F.col("xb") <= F.col("yb")))
    meet = scratch.put(meet, "meet")
    of = nodes.drop("parts").join(_to_all_parts(classes.select("gram", "k", "blocks", "parts")), ["gram", "k", "part"]).withColumn("b", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    of = scratch.put(of.drop("part", "blocks"), "blocks")
    key = ["gram", "xk", "yk", "xb", "yb"]
    side = lambda s: meet.select(*key).join(of.select("gram", F.col("k").alias(f"{s}k"), F.col("b").alias(f"{s}b"), F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("rest").alias(f"r{s}"), F.col("comp").alias(f"c{s}")), ["gram", f"{s}k", f"{s}b"])
    return side("x").join(side("y"), key)


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold_percent: int = 75, tag_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, n_verified), and with ``tag_col`` also (tag, chosen).

    Two rows link when ``100 * |A & B| >= threshold_percent * |A | B|`` for their sets of ``width``-word shingles;
    component_id is the smallest id reachable by links. n_verified counts the links of the row's set that were verified; pairs
    inside a component that is already connected aren't compared, so it isn't the number of all its links.

    ``tag_col`` is a whole number that tells rows with one id (or none) apart, such as a hash of the text. chosen is true for
    rows that link with nothing, and of each component for the row with the least id, null last, and the least tag among
    those; rows that repeat both are all chosen or none.

    Null or blank texts have an empty set and stay alone. Texts below ``width`` words have one shingle of all their
    words. Rows with equal sets share a node, so repeats cost one row each. A repeated id is as many rows; a null
    id stays null if nothing with an id is linked. Other columns are ignored. An empty table gives an empty result.
    Sets hold 64-bit hashes: two different shingles of one pair are taken for one with a chance near 2**-64.
    ``docs`` has to give the same rows per partition when a lost task is run again, as a file scan does.
    """
    scratch = Scratch(docs.sparkSession, "ngram")
    rows = scratch.put(shared_ngrams(docs, id_col, text_col, width, threshold_percent, tag_col), "rows")
    live = rows.where("node is not null")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("tag").alias("tag"))).alias("best")
    nodes = scratch.put(live.groupBy("node").agg(F.min("doc_id").alias("least"), best, F.count("*").alias("m"), F.first("n").alias("n"), F.first("weight").alias("weight"), F.first("own").alias("own"), F.first("prefix").alias("prefix"), F.first("segments").alias("segments")), "nodes")
    listed = nodes.select("node", "n", "weight", "own", F.posexplode("prefix").alias("at", "gram")).withColumn("rest", F.col("n") - F.col("own") - F.col("at")).drop("own", "at")
    counts = scratch.put(listed.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    lists = scratch.put(_dealt(listed, "gram", ["node"], counts).join(_to_all_parts(_dealt(counts, "gram", ["gram"], counts).select("gram", "parts")), ["gram", "part"]), "lists")
    segments = nodes.select("node", F.posexplode("segments").alias("frag", "grams")).where(F.size("grams") > 0)
    #: In the order of n-grams nothing before the first common one is common, so what follows it has to be enough.
    fits = (100 + threshold_percent) * F.least("rx", "ry") >= threshold_percent * (F.col("nx") + F.col("ny"))

    edges = None
    roots: DataFrame | None = None
    tried: DataFrame | None = None
    open_lists = lists.withColumn("comp", F.col("node"))
    for turn in range(HUB_ROUNDS + 1):
        if roots is not None:
            named = scratch.put(lists.join(roots.toDF("node", "root"), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), f"named{turn}")
            mixed = named.groupBy("gram").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.first("parts").alias("parts")).where("c0 <> c1").select("gram", "parts")
            open_lists = scratch.put(named.join(_to_all_parts(mixed), ["gram", "part"], "left_semi"), f"open{turn}")
            scratch.drop(f"named{turn}")
        if open_lists.isEmpty():
            break
        if turn < HUB_ROUNDS:
            first = F.col("weight") if not turn else F.lit(0)
            hubs = open_lists.groupBy("gram").agg(F.max(F.struct(first, F.xxhash64("node", F.lit(turn)), "node", "n", "rest", "comp")).alias("hub"), F.first("parts").alias("parts"))
            pairs = open_lists.join(_to_all_parts(hubs), ["gram", "part"]).select(*[F.col(f"hub.{c}").alias(f"{a}x" if a else "x") for c, a in (("node", ""), ("n", "n"), ("rest", "r"), ("comp", "c"))], F.col("node").alias("y"), F.col("n").alias("ny"), F.col("rest").alias("ry"), F.col("comp").alias("cy"))
        else:
            pairs = _block_pairs(scratch, open_lists, threshold_percent)
        pairs = pairs.where((F.col("cx") != F.col("cy")) & fits)
        low = F.col("x") < F.col("y")
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(low, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(low, F.col("ny")).otherwise(F.col("nx")).alias("nb")).distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = scratch.put(pairs, f"pairs{turn}")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = scratch.put(_verified(pairs, segments, threshold_percent), f"edges{turn}")
        edges = found if edges is None else edges.unionByName(found)
        roots = components(scratch, edges, f"cc{turn}")
        scratch.drop(f"open{turn}")

    if roots is None:
        roots = nodes.select("node", F.col("node").alias("root")).limit(0)
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    named = nodes.select("node", "least", "best", "m").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component"), F.min("best").alias("best"))
    of_node = named.drop("best").join(least, "root").join(ends.groupBy("node").agg(F.count("*").alias("links")), "node", "left").select("node", "m", "component", "best", "links")
    of_node = scratch.put(of_node, "components")
    scratch.keep_only("rows", "components")

    extra = lambda chosen: [F.col("tag"), chosen.alias("chosen")] if tag_col is not None else []
    alone = rows.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_verified"), *extra(F.lit(True)))
    copies = of_node.select("node", "m")
    own = _dealt(rows.where("node is not null").select("doc_id", "tag", "n", "node"), "node", ["doc_id", "tag"], copies).drop("parts")
    named = own.join(_to_all_parts(_dealt(of_node, "node", ["node"], copies).drop("part")), ["node", "part"])
    is_best = F.col("doc_id").eqNullSafe(F.col("best.id")) & F.col("tag").eqNullSafe(F.col("best.tag"))
    linked = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_verified"), *extra(is_best))
    return alone.unionByName(linked)


def ngram_oracle() -> str:
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
flat AS (SELECT doc_id, unnest(g) AS g FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.g) + len(y.g) - n)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS seen FROM s UNION SELECT reach.id, ways.b FROM reach JOIN ways ON ways.a = reach.seen)
SELECT doc_id, len(g)::BIGINT AS n_shingles, min(seen) AS component_id FROM s JOIN reach ON reach.id = doc_id GROUP BY doc_id, g"""
