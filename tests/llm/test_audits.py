"""SentencePiece with offsets, repaired conversations and the filter audit against the library and plain Python."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.common import WORD, rows, table
from voxloom.llm import pieces, repair
from voxloom.llm.filters import audit_filters, text_failures
from voxloom.llm.repair import audit_conversations, damage, repair_conversations

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_and_spans_as_the_library(spark, library):
    docs = table(spark)
    got = pieces.decode_ids(pieces.encode_texts(docs, MODEL), MODEL).join(docs.select("doc_id", "text"), "doc_id").collect()
    at_once = {r["doc_id"]: (r["ids"], r["decoded"]) for r in pieces.encode_texts(docs, MODEL, decoded=True).collect()}
    assert pieces.encode_texts(docs, MODEL).count() == len(rows()) and all(at_once[r["doc_id"]] == (r["ids"], r["decoded"]) for r in got)
    for r in got:
        text = r["text"] or ""
        assert r["ids"] == library.encode(text, add_bos=True, add_eos=True)
        assert r["decoded"] == library.decode(r["ids"])
        found = library.encode(text, return_type="proto").pieces
        assert list(zip(r["starts"][1:-1], r["ends"][1:-1], strict=True)) == [(p.begin, p.end) for p in found]
        assert r["span_bytes"] == len(text.encode())
    assert pieces.encode_texts(table(spark, some=False), MODEL).count() == 0


def test_packed_ids_decode_alike(spark, library):
    packed = pieces.decode_ids(pieces.encode_texts(table(spark), MODEL, begin=False, end=False, spans=False, pack=True), MODEL)
    assert packed.columns == ["doc_id", "ids", "span_bytes", "decoded"]
    by_id = {r["doc_id"]: r for r in packed.collect()}
    assert np.frombuffer(by_id[13]["ids"], "<u4").tolist() == library.encode(rows()[13][1])
    assert by_id[13]["decoded"] == rows()[13][1] and by_id[3]["ids"] == b"" and by_id[3]["decoded"] == ""
    named = pieces.decode_ids(spark.createDataFrame([([1, 2], 5, None), (None, 5, "x"), ([], 5, None)], "`a.b` array<long>, decoded long, row string"), MODEL, "a.b", "text")
    assert named.columns == ["a.b", "decoded", "row", "text"] and sorted((r["text"] for r in named.collect()), key=str) == ["", "", None]


def test_parts_are_segmented_alone(monkeypatch, library):
    draw = random.Random(3)
    text = "".join(draw.choice(["the ", "  ", "é", "𝕏", "ing", "\n", "abc", "1", "▁"]) for _ in range(4000))
    monkeypatch.setattr(pieces, "PART_CHARS", 7)
    model = pieces.load_model(MODEL)
    assert len(list(model.parts(model.normalise(text.encode())[0].decode()))) > 100
    assert model.encode([text.encode()])[0].ids.tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_wrong_bytes(library):
    for data in (b"\xff\xfeab \xe2\x82 c", b"\xed\xa0\x80x", b"a\xc0\x80", b"\xf0\x9f"):
        assert pieces.load_model(MODEL).encode([data])[0].ids.tolist() == library.encode(data, add_bos=True, add_eos=True)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("flags", [{}, {"add_dummy_prefix": True}, {"remove_extra_whitespaces": False}, {"escape_whitespaces": False}])
def test_character_map(rule, flags):
    want = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
    spec = dict(pieces._fields(dict(pieces._fields(want.serialized_model_proto()))[3]))
    own = pieces.PieceModel.__new__(pieces.PieceModel)
    own.map, own.own, own.at_end = pieces.CharacterMap(spec[2]), None, False
    own.dummy, own.squeeze, own.space = bool(spec.get(3, 1)), bool(spec.get(4, 1)), pieces.ESCAPED if spec.get(5, 1) else b" "
    draw = random.Random(7)
    alphabet = [*" 　 ①Ａｶﾞ™¨​AbÄß字ﷺ𝕏\t", "é", "가", "  "]
    for _ in range(800):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(10)))
        normal, places = own.normalise(text.encode())
        expected, offsets = want.normalize(text, with_offsets=True)
        assert normal.decode() == expected
        char_at = {len(text[:k].encode()): k for k in range(len(text) + 1)}
        firsts = [0, *itertools.accumulate(len(c.encode()) for c in expected)]
        assert not offsets or [char_at[int(places[k])] for k in firsts] == list(offsets)


def least(found):
    """Cheapest edits by a queue over whole label strings; rows are (role, fault)."""
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, labels, at, out = heapq.heappop(queue)
        initials = out.replace(",", "")
        if at == len(found) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, labels
        state = (at, initials[-1:])
        if (*state, labels) in done:
            continue
        done.add((*state, labels))
        fits = lambda more: re.fullmatch("s|s?(ua)*u?", initials + more)
        for r in "ua":
            if fits(r) and cost < 60:
                heapq.heappush(queue, (cost + 3, labels + "I", at, initials + r))
        if at < len(found):
            role, fault = found[at]
            heapq.heappush(queue, (cost + 4, labels + "D", at + 1, initials))
            if fault < 2:
                if fits(role[:1]) and role[:1] in ("s", "u", "a"):
                    heapq.heappush(queue, (cost + 3 * fault, labels + "K", at + 1, initials + role[0]))
                for r in "ua":
                    if fits(r):
                        heapq.heappush(queue, (cost + 3 + 3 * fault, labels + "R", at + 1, initials + r))


def audited(turns):
    """Rows (turn, role, text) of one conversation after damage."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in turns:
        words = WORD.findall(text)
        faults.append(3 if not words else 2 if (role, text) in seen else 1 if words[-1][-1] not in ".!?" else 0)
        seen.add((role, text))
    known = [t for t, _, _ in turns if t is not None]
    cost, labels = least([(r, f) for (_, r, _), f in zip(turns, faults, strict=True)])
    lines, at = [], iter(turns)
    kept_system = labels.lstrip("D")[:1] == "K" and turns[len(labels) - len(labels.lstrip("D"))][1][:1] == "s"
    for x in labels:
        role, text = (None, "") if x == "I" else next(at)[1:]
        if x != "D":
            lines.append((role if x == "K" else ("user", "assistant")[(len(lines) + kept_system) % 2]) + ":" + text)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, faults.count(3), faults.count(2), faults.count(1), illegal, cost, labels, hashlib.sha256("\n".join(lines).encode()).hexdigest()


CONVERSATION = "conv_id long, turn long, role string, text string, piece string, k int"


@pytest.mark.parametrize("piece_rows", [1, 3, 512])
def test_cheapest_repair(spark, piece_rows):
    draw = random.Random(11)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", ""], ["Yes.", "no", " \n", "", "Why?", "ok! ", "Yes. é"]
    data = [(c if c else None, None if draw.random() < 0.05 else t // 2 * 3, draw.choice(roles), draw.choice(texts), "p", 1) for c in range(60) for t in range(draw.randrange(1, 8))]
    data += [(100, 1, None, None, None, None), (101, 1, "user", "Hello.", None, None), (101, 1, "user", "Hello.", None, None)]
    df = spark.createDataFrame(data, CONVERSATION)
    got = {r[0]: tuple(r)[1:] for r in audit_conversations(df, piece_rows=piece_rows).collect()}
    said = lambda x: " " if x is None else x
    by_conv = {}
    for conv, turn, role, text, *_ in data:
        by_conv.setdefault(conv, []).append((turn, said(role), said(text)))
    assert set(got) == set(by_conv)
    #: Rows of one turn and role are in the order of a hash, so only conversations without such have one answer.
    sure = {c: v for c, v in by_conv.items() if len({(t, r) for t, r, _ in v}) == len({*v})}
    assert len(sure) > 30
    for conv, turns in sure.items():
        assert got[conv] == audited(turns), (conv, turns)
    edits = repair_conversations(df, piece_rows=piece_rows).orderBy("piece", "step").collect()
    for conv in by_conv:
        own = [e for e in edits if e["conv_id"] == conv]
        assert "".join(e["edit"] for e in own) == got[conv][6]
        lines = "\n".join(f"{e['role']}:{e['text']}" for e in own if e["edit"] != "D")
        assert hashlib.sha256(lines.encode()).hexdigest() == got[conv][7]


def test_long_conversation_in_pieces(spark):
    draw = random.Random(2)
    data = [(7, t, draw.choice(["user", "assistant"]), draw.choice(["a.", "b", "", f"{t}.", f"{t}"]), None, None) for t in range(600)]
    whole, parts = (audit_conversations(spark.createDataFrame(data, CONVERSATION), piece_rows=n).first() for n in (1000, 16))
    assert whole == parts and len(whole["audit"]) >= 600


def test_damage(spark):
    data = [(c, t, "assistant", "Yes. No!") for c in range(20) for t in range(5)] + [(None, None, None, None)]
    got = sorted(map(tuple, damage(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()), key=str)
    want = []
    for conv, turn, role, text in data:
        said = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        row = (conv, turn, "user" if kind == 4 else said[2], {1: "", 2: re.sub("[.!?]", "", said[3])}.get(kind, said[3]))
        want += [row] * {0: 0, 3: 2}.get(kind, 1)
    assert got == sorted(want, key=str)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], CONVERSATION)
    assert audit_conversations(empty).count() == 0 and repair_conversations(empty).count() == 0
    assert repair.shortest("", repair.START) == {repair.START: (0, "")}


def test_filter_audit(spark):
    data = [*rows(), (50, "w " * 250, "fr", None, None, None, None, None), (51, "w " * 250, None, None, None, None, None, None), (52, "W# " * 250, "fr", None, None, None, None, None), (53, "", "", None, None, None, None, None)]
    data += [(60 + i, " ".join(f"v{i}x{j}" for j in range(201)), "fr", None, None, None, None, None) for i in range(12)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, size string, part string, bits string")
    marks = [(0, 1, 0), (50, 1, 1), (51, None, 1), (51, 1, None), (60, 1, 1), (None, 1, 1), (2, 0, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    first, flags = {}, []
    for doc, text, *_ in data:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    for doc, text, lang, *_ in data:
        t = text or ""
        w = WORD.findall(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), doc is not None and first[t] < doc]
        flags.append((lang or "", dict(zip("ABCDE", fails, strict=True)), any(m[0] == doc and m[1] == 1 for m in marks if doc is not None), any(m[0] == doc and m[2] == 1 for m in marks if doc is not None)))
    want, shapley = [], {}
    for order in itertools.permutations("ABCDE"):
        for part in {f[0] for f in flags}:
            own = [f for f in flags if f[0] == part]
            left = list(own)
            for step, x in enumerate(order, 1):
                out = [f for f in left if f[1][x]]
                failing = [f for f in own if f[1][x]]
                left = [f for f in left if not f[1][x]]
                shapley[part, x] = shapley.get((part, x), 0) + len(out)
                want.append((part, "".join(order), step, len(left), len(out), len(failing) - len(out), sum(sum(f[1].values()) == 1 for f in failing), sum(f[2] for f in out), sum(f[3] for f in out)))
    want = sorted((*w, shapley[w[0], w[1][w[2] - 1]]) for w in want)
    failures = text_failures(docs, labels)
    assert sorted(map(tuple, audit_filters(failures, "ABCDE", marks=("good", "toxic")).collect())) == want
    assert audit_filters(failures.limit(0), "ABCDE").count() == 0
    nulls = failures.select("part", F.lit(None).cast("boolean").alias("A"), "B")
    assert {r["removed"] for r in audit_filters(nulls, "AB").where("substring(filter_order, step, 1) = 'A'").collect()} == {0}
    with pytest.raises(ValueError, match="seven"):
        audit_filters(failures, "ABCDEFGH")
