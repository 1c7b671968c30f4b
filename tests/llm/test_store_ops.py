"""op3, op6, op8, op9 and the pipeline: round trips, brute force and edge cases."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as fs
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.llm.common import rows, table
from voxloom.llm import chat
from voxloom.llm import queries as q
from voxloom.llm.packing import cut, pack_documents, plan_packing
from voxloom.llm import topk
from voxloom.llm.topk import Best, SortedLists, exact_top_k, search_group
from voxloom.llm.warc import base32_sha1, decode_record, encode_record, nested, read_archives, records_in_range, warc_round_trip, write_archives


def test_warc_matches_pages(spark, sf_dir):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    least = {}
    for i in sorted(pages):
        least.setdefault(pages[i], i)
    got = {r["page_id"]: r for r in q.op3_warc(spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for i, html in pages.items():
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if least[html] == i else ("revisit", least[html]))


def test_warc_edges(spark, tmp_path):
    odd = "a\r\n%0D\x00é"
    data = [(1, odd, "x", 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "x", 1), (4, "u", "x", 1), (5, "u", "y" * 300_000, 1), (None, "u", "y" * 300_000, 1), (None, "u", "z", 1), (6, "u", "\x1f\x8b\x08" * 50, 1)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, payload long")
    got = warc_round_trip(spark, pages, payloads=True).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == Counter([
        (1, "response", None, 1), (2, "response", None, 0), (3, "revisit", 2, 0), (4, "revisit", 1, 1), (4, "revisit", 1, 1), (5, "response", None, 300_000), (None, "revisit", 5, 300_000), (None, "response", None, 1), (6, "response", None, 200),
    ])
    assert {r["page_id"]: r["url"] for r in got}[1] == odd
    assert warc_round_trip(spark, pages.limit(0)).count() == 0
    big = Counter(r["record_type"] for r in warc_round_trip(spark, pages, min_bytes=2).collect())
    assert big == {"response": 8, "revisit": 1}


def test_splits_own_each_record_once(spark, tmp_path):
    """Whatever the size of splits, each record is read once; junk and magic inside payloads don't matter."""
    pages = spark.createDataFrame([(k, f"u{k}", f"{'<p>' * (k % 50)}{k}" + "\x1f" * (k % 3)) for k in range(400)], "page_id long, url string, html string")
    archives = write_archives(pages, f"file://{tmp_path}/a", level=0).cache()
    for size in (37, 1000, 1 << 20):
        assert sorted(r["page_id"] for r in read_archives(archives, f"file://{tmp_path}", split_bytes=size).collect()) == list(range(400))


def test_reader_passes_false_magic(tmp_path):
    inner = zlib.compressobj(9, zlib.DEFLATED, 31)
    fake = inner.compress(b"not a record") + inner.flush()
    parts = [encode_record(1, "u", fake * 3, None, False, base32_sha1(fake * 3), 0), b"\x1f\x8b\x08junk", fake, encode_record(2, None, b"", 1, True, base32_sha1(b""), 9)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(parts))
    total = sum(map(len, parts))
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        for split in (1, 7, 100, total):
            found = [decode_record(r) for at in range(0, total, split) for _, _, r in records_in_range(f, total, at, min(total, at + split))]
            assert [r["page_id"] for r in found] == [1, 2]
    assert found[0]["payload"] == fake * 3 and found[1]["refers_to"] == 1 and found[1]["record_type"] == "revisit"


@pytest.mark.parametrize("level", [0, 9])
def test_members_inside_of_others(spark, tmp_path, level):
    """Archives in a payload, and archives in these: whatever the split, the records are those of reading from the start."""
    page = lambda i, x, lvl=9: encode_record(i, f"u{i}", x, None, False, base32_sha1(x), lvl)
    deep = page(70, b"deep" * 30) + page(71, page(72, b"deeper"), 0)
    inner = page(60, b"x" * 50) + page(61, deep, 0) + page(62, b"tail")
    whole = page(1, b"first") + page(2, inner + b"\x1f\x8b\x08" + inner, level) + b"junk" + page(3, b"", level) + page(4, inner, level)
    (tmp_path / "x.warc.gz").write_bytes(whole)
    archives = spark.createDataFrame([(f"{tmp_path}/x.warc.gz", len(whole))], "path string, bytes long")
    for split in (29, 100, 333, 1000, len(whole)):
        got = read_archives(archives, f"file://{tmp_path}", split_bytes=split).collect()
        assert sorted(r["page_id"] for r in got) == [1, 2, 3, 4], split
    with fs.LocalFileSystem().open_input_file(f"{tmp_path}/x.warc.gz") as f:
        for split in (1, len(whole)):
            found = [x for at in range(0, len(whole), split) for x in records_in_range(f, len(whole), at, min(len(whole), at + split))]
            out = nested(np.array([x[0] for x in found]), np.array([x[1] for x in found]))
            assert [decode_record(x[2])["page_id"] for x, n in zip(found, out, strict=True) if not n] == [1, 2, 3, 4]


def brute_top(vectors, k):
    whole = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors.items()}
    out = []
    for i, v in whole.items():
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole.items() if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark, sf_dir):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    assert sorted(tuple(r) for r in q.op6_exact_top_k(spark, sf_dir).collect()) == brute_top(vectors, 5)


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [-1.0, -3.0], 1), (0, [1.0, 0.5], 1), (None, [9.0, 9.0], 1), (8, [1.0], 1), (9, [], 1), (50, [], 1), (100, [1e6, 1e7], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank int")
    clean = {i: v for i, v, _ in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for rows in (8192, 2):
        got = exact_top_k(df, df.where("vec_id % 50 = 0"), k=3, group_rows=2 * rows, block_rows=rows).collect()
        assert sorted(tuple(r) for r in got) == brute_top(clean, 3)
    assert exact_top_k(df.limit(0), df.limit(0)).count() == 0


def counted(rows, queries, block_rows=8192):
    """Rows of lists read, objects scored, and how many there are; results are held against all products."""
    ids, read, scored = np.arange(len(rows)), 0, 0
    blocks = [SortedLists(ids[at : at + block_rows], rows[at : at + block_rows]) for at in range(0, len(rows), block_rows)]
    best = Best(len(queries), 5, rows.dtype)
    for q, query in enumerate(queries):
        for block in blocks:
            r, s = block.search(query, -1, best, q)
            read, scored = read + r, scored + s
        assert best.ids[q].tolist() == np.lexsort((ids, -(rows @ query)))[:5].tolist()
    return read, scored, len(rows) * len(queries)


def test_threshold_stops_early():
    draw = np.random.default_rng(0)
    rows = np.floor(256 * draw.normal(size=(4000, 3)))
    read, scored, every = counted(rows, rows[:20])
    assert 0 < read and scored < every
    #: A block that can't beat the kth score isn't read.
    best, query = Best(1, 5, rows.dtype), rows[0]
    assert SortedLists(np.arange(4000), rows).search(query, -1, best, 0) > (0, 0)
    far = SortedLists(np.arange(4000) + 4000, rows - 1e4 * np.sign(query))
    assert far.search(query, -1, best, 0) == (0, 0)


def test_lists_in_many_dimensions():
    """64 dimensions: in clusters along few of them the bound stops most of the work; without clusters all is seen, but lists aren't read out."""
    draw = np.random.default_rng(1)
    centres = np.zeros((64, 64))
    for c in centres:
        c[draw.choice(64, 3, replace=False)] = 1
    tight = np.floor(256 * centres[draw.integers(0, 64, 9000)] * (1 + 0.05 * draw.normal(size=(9000, 64))))
    read, scored, every = counted(tight, tight[:30], 3000)
    assert scored < 0.1 * every and read < 0.02 * every * 64
    even = np.floor(256 * draw.normal(size=(3000, 64)))
    read, scored, every = counted(even, even[:10])
    assert scored <= every and read < 0.5 * every * 64


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_lists_are_read(spark, sf):
    data = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()
    rows = np.floor(256 * np.array([r[0] for r in data], float))
    read, scored, every = counted(rows, rows[::50])
    assert read >= len(rows[::50]) * 64 * 16 and scored <= every


def test_first_groups_bound_the_others(spark, sf_dir, monkeypatch):
    """Many groups: some are searched first, and the others pass on no more than what reaches the kth score of those."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = df.where("vec_id % 50 = 0")
    want = sorted(map(tuple, exact_top_k(df, asked).collect()))
    monkeypatch.setattr(topk, "FEW_GROUPS", 2)
    assert sorted(map(tuple, exact_top_k(df, asked, group_rows=20).collect())) == want
    monkeypatch.setattr(topk, "GROUP_BYTES", 8 * 64 * 30)
    assert sorted(map(tuple, exact_top_k(df, asked).collect())) == want


def test_scores_beyond_64_bits(spark):
    data = [(0, [1e300, 1.0]), (3, [2e17, 1.0]), (50, [1.0, 2.0]), (51, [3.0, -2e16])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        exact_top_k(df, df.where("vec_id = 0")).collect()
    small = df.where("vec_id > 0")
    got = [tuple(r) for r in exact_top_k(small, small.where("vec_id = 50"), scale=1).collect()]
    assert got == [(50, 1, 3, 2 * 10**17 + 2), (50, 2, 51, 3 - 4 * 10**16)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 5), st.sampled_from([3, 50, 1000]), st.sampled_from([3.0, 2.0**27]))
def test_search_group(seed, dims, n, width):
    """Blocks of one group, ties and sums that doubles can't hold, against all products."""
    draw = np.random.default_rng(seed)
    rows = np.floor(draw.normal(size=(n, dims)) * width)
    table = pa.table({"vec_id": pa.array(draw.permutation(n)), "embedding": pa.array(list(rows), pa.list_(pa.float64()))})
    queries = table.slice(0, 9).append_column("kth", pa.nulls(min(9, n), pa.int64()))
    got = pa.Table.from_batches(list(search_group(table, iter([queries.slice(0, 4), queries.slice(4)]), 3, 1, 200))).to_pydict()
    ids, whole = table["vec_id"].to_numpy(), rows.astype(np.int64)
    want = []
    for k in range(len(queries)):
        scores = [(-int(s), int(i)) for s, i in zip(whole @ whole[k], ids, strict=True) if i != ids[k]]
        want += [(int(ids[k]), i, -s) for s, i in sorted(scores)[:3]]
    assert sorted(zip(got["query_id"], got["vec_id"], got["score"], strict=True)) == sorted(want)


def test_chat(spark, sf_dir):
    got = {r["conv_id"]: r for r in q.op8_format_chats(spark, sf_dir).collect()}
    talks = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    talks[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert got.keys() == talks.keys()
    for i, turns in talks.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (got[i]["n_turns"], got[i]["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[i]["loss_chars"], got[i]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_pieces_beyond_the_capacity_are_an_error(spark, monkeypatch):
    from voxloom.llm import packing

    pieces = spark.createDataFrame([(i, 0, 0, 3 + i % 5, i) for i in range(40)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    with pytest.raises(ValueError, match="a piece of 7"):
        packing.place_pieces(pieces, 6)
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    placed = packing.place_pieces(pieces, 10).collect()
    rooms = {}
    for r in placed:
        rooms.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(placed) == 40
    for parts in rooms.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 10


def test_nothing_but_text_is_learned(spark):
    """Media between the texts of an assistant: the mask holds the texts alone."""
    part = "array<struct<type: string, text: string, ref: string, units: bigint>>"
    said = [("text", "a<", None, 0), ("image", None, "i.png", 1), ("text", "b", None, 0), (None, "c", None, 0), ("audio", None, "x", 1)]
    turns = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "assistant", said[1:2])], f"conv_id long, turn long, role string, parts {part}")
    out = chat.format_chats(turns).select("*", chat.loss_text(chat.F.col("formatted"), chat.F.col("loss_spans")).alias("loss")).first()
    assert [out["formatted"][s["start"] : s["start"] + s["length"]] for s in out["loss_spans"]] == ["a&lt;", "b", "c"]
    assert out["loss"] == "a<bc" and out["loss_spans"][0]["start"] > out["formatted"].index("assistant")


def test_chat_parts(spark):
    part = "array<struct<type: string, text: string, ref: string, units: bigint>>"
    data = [
        (1, 1, "assistant", [("text", "see <|image|> & &lt; 😀", None, 0), ("document", None, "d.pdf", 3)], "x"),
        (1, 0, "user", [("text", "look", None, 0), ("image", None, "i.png", 4), ("audio", None, "a.wav", None), (None, None, None, None)], "x"),
        (2, None, None, None, "x"), (2, 0, "assistant", [], "x"), (None, 0, "a<b", [("text", None, None, 0)], "x"),
    ]
    turns = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {part}, formatted string")
    out = {r["conv_id"]: r for r in chat.format_chats(turns).collect()}
    one = out[1]
    assert one["formatted"] == "<|turn|>user<|body|>look<|part:image|><|part:audio|><|end|><|turn|>assistant<|body|>see &lt;|image|> &amp; &amp;lt; 😀<|part:document|><|end|>"
    assert [(a["index"], a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(0, "image", "i.png", 1024), (1, "audio", "a.wav", 25), (2, "document", "d.pdf", 1536)]
    assert one["placeholder_tokens"] == 2585
    (s,) = one["loss_spans"]
    assert one["formatted"][s["start"] : s["start"] + s["length"]] == "see &lt;|image|> &amp; &amp;lt; 😀"
    assert out[2]["formatted"] == "<|turn|><|body|><|end|><|turn|>assistant<|body|><|end|>" and out[None]["formatted"].startswith("<|turn|>a&lt;b")
    read = chat.format_chats(turns).select(chat.read_turns(chat.F.col("formatted")).alias("t"), "conv_id").where("conv_id is null").first()
    assert [tuple(t) for t in read["t"]] == [("a<b", "", [])]
    assert chat.format_chats(turns.limit(0)).count() == 0


_WORDS = st.sampled_from(["turn", "body", "end", "part:image", "text", "image", "a|>b", "<|part:image|>", "<|turn|>", "|>", "", "&bar;", "&lt;|end|>", "<", "|", "&amp;", "user<|body|>x", "part", "é😀"])
_PARTS = st.lists(st.tuples(st.one_of(st.just("text"), _WORDS), st.lists(_WORDS, max_size=3).map("".join)), max_size=5)


@settings(max_examples=4, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(_WORDS, _PARTS), min_size=1, max_size=4), min_size=40, max_size=40))
def test_no_part_forms_a_turn(spark, talks):
    """Whatever types, roles and texts are, the reader gives back the turns and their typed parts, neighbouring texts as one."""
    part = "array<struct<type: string, text: string, ref: string, units: bigint>>"
    data = [(i, k, role, [(t, x, f"{i}-{k}-{j}", 1) for j, (t, x) in enumerate(parts)]) for i, turns in enumerate(talks) for k, (role, parts) in enumerate(turns)]
    out = chat.format_chats(spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {part}"))
    got = {r["conv_id"]: r for r in out.select("conv_id", "attachments", chat.read_turns(chat.F.col("formatted")).alias("turns")).select("*", chat.media_parts(chat.F.col("turns")).alias("media")).collect()}
    for i, turns in enumerate(talks):
        want, refs = [], []
        for k, (role, parts) in enumerate(turns):
            merged = []
            for j, (t, x) in enumerate(parts):
                if t != "text":
                    merged.append((t, None))
                    refs.append((k, t, f"{i}-{k}-{j}"))
                elif x and merged and merged[-1][0] == "text":
                    merged[-1] = ("text", merged[-1][1] + x)
                elif x:
                    merged.append(("text", x))
            want.append((role, "".join(x for t, x in merged if t == "text"), merged))
        assert [(t["role"], t["text"], [tuple(p) for p in t["parts"]]) for t in got[i]["turns"]] == want
        assert [(m["turn"], m["type"], a["ref"]) for m, a in zip(got[i]["media"], got[i]["attachments"], strict=True)] == refs


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=20))
def test_plan_fills_every_place_once(counts):
    capacity, taken, ranks = 60, {}, {n: [] for n in counts}
    for n, first, pieces, each, seq, offset in plan_packing(counts, capacity):
        for k in range(pieces):
            ranks[n].append(first + k)
            taken.setdefault(seq + k // each, []).append((offset + k % each * n, n))
    assert all(sorted(r) == list(range(counts[n])) for n, r in ranks.items())
    for places in taken.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in places) <= 2
    total, large = sum(n * c for n, c in counts.items()), sorted(n for n, c in counts.items() if 3 * n > capacity for _ in range(c))
    low, high, pairs = 0, len(large) - 1, 0
    while low <= high:  # the least number of sequences for the large ones: the smallest beside the largest, if it fits
        low += low < high and large[low] + large[high] <= capacity
        high -= 1
        pairs += 1
    bins: list[int] = []  # first fit, the largest first
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = next((k for k, b in enumerate(bins) if b + n <= capacity), None)
        bins = [*bins, n] if at is None else [b + n * (k == at) for k, b in enumerate(bins)]
    assert len(taken) <= 1.1 * len(bins) + 1
    assert total != sum(large) or len(taken) == pairs


def test_cut():
    assert list(cut(np.arange(10), 4)) == [(0, 0, 2), (1, 2, 4), (2, 6, 4)] and list(cut(np.arange(8), 4)) == [(0, 0, 4), (1, 4, 4)] and list(cut(np.arange(3), 4)) == [(0, 0, 3)]


@pytest.mark.parametrize("where", ["edge", "sf0.001"])
def test_packing(spark, sf_dir, where):
    from tokenizers import Tokenizer

    docs = table(spark) if where == "edge" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        want.update((r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)))
    got = pack_documents(docs, q.public_byte_bpe()).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    if where == "sf0.001":
        assert len(seqs) <= 1.02 * sum(r["length"] for r in got) / 1024 + 1


def test_packing_keeps_ids(spark):
    docs = table(spark).where("doc_id in (8, 14)")
    got = pack_documents(docs, q.public_byte_bpe(), with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    assert pack_documents(table(spark, False), q.public_byte_bpe()).count() == 0


def test_pipeline(spark, sf_dir):
    """run() against a version that takes each stage's operator apart in Python."""
    import corpus_pipeline as pipe
    from tests.llm.test_text_ops import base_spans, linked

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = pipe.quality_rules(spark, docs, sf_dir)
    verdicts = {r["doc_id"]: r["kept"] for r in q.op5_quality_rules(spark, sf_dir).collect()}
    own = {r["doc_id"]: r for r in docs.collect() if verdicts[r["doc_id"]]}
    assert {r["doc_id"] for r in kept.collect()} == own.keys()
    least = {i for i, _, c in linked([(i, r["text"]) for i, r in own.items()]) if i == c}
    alone = pipe.near_duplicates(spark, kept, sf_dir)
    assert {r["doc_id"] for r in alone.collect()} == least and alone.count() == len(least)
    clean = pipe.secrets(spark, alone, sf_dir)
    for r in clean.collect():
        assert not base_spans(r["text"]) and (r["text"] == own[r["doc_id"]]["text"]) == (not base_spans(own[r["doc_id"]]["text"])) and r["n_chars"] == len(r["text"])
    mixed = pipe.mixing(spark, clean, sf_dir)
    assert clean.columns == mixed.columns == docs.columns and mixed.count() > 0
    times = Counter(r["doc_id"] for r in mixed.collect())
    out = pipe.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == times
    assert [n for n, _ in pipe.STAGES] == ["quality_rules", "near_duplicates", "secrets", "mixing", "packing"]


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline as pipe

    for name, docs in (("some", table(spark)), ("none", table(spark, False))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(0, 1), (10, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        stage = docs
        for k, (_, f) in enumerate(pipe.STAGES[:-1]):
            stage = f(spark, stage, f"{tmp_path}/{name}")
            assert stage.columns == docs.columns, k
        out = pipe.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in out} <= {r[0] for r in rows()} and (name == "some") == bool(out)
