"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised here, not in the library: at every place the longest key of the model's compiled character map (a
double array of byte steps) is taken, white space is escaped, and each byte that results keeps the place in the original
bytes that it came from. The library then segments the normalised text by the same model with an identity normaliser, and
every piece, a run of normalised bytes, is projected through that alignment to a span of original bytes.

A text may be cut between two characters that stand side by side in no piece: no merge crosses such a place, so the parts
are segmented alone and a long text takes the memory of its parts.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import packed, unpacked

#: Fixed values of the model's format: piece types, the model type that merges pairs, the escaped space, what stands for a wrong byte.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
ESCAPED, WRONG = "▁".encode(), "�".encode()
#: Characters that are segmented at once, and bytes of text that are encoded in one call.
PART_CHARS, BATCH_BYTES = 16_384, 1 << 20
#: Values of a segment that is copied, and of a byte that isn't UTF-8.
_COPY, _WRONG = -1, -2


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(message):
        key = number()
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if size is None else size
            yield key >> 3, message[at : at + size]
            at += size


class CharacterMap:
    """The compiled map of a normaliser: keys in a double array, replacements as strings that end with a zero byte."""

    def __init__(self, compiled: bytes) -> None:
        size = int.from_bytes(compiled[:4], "little")
        self.units, self.strings = np.frombuffer(compiled[4 : 4 + size], "<u4").astype(np.int64), compiled[4 + size :]

    @staticmethod
    def _jump(units: np.ndarray) -> np.ndarray:
        return (units >> 10) << ((units & 0x200) >> 6)

    def replacement(self, value: int) -> bytes:
        return self.strings[value : self.strings.index(0, value)]

    def longest(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each start the length of the longest key that begins there (0: none) and its value; all starts take a step at once."""
        lengths, values = np.zeros(len(starts), np.int64), np.full(len(starts), _COPY, np.int64)
        live, node, depth = np.arange(len(starts)), np.full(len(starts), self._jump(self.units[:1])[0]), 0
        while len(live):
            inside = starts[live] + depth < len(data)
            live, node = live[inside], node[inside]
            byte = data[starts[live] + depth].astype(np.int64)
            node = node ^ byte
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            fits = (node < len(self.units)) & ((unit & 0x800000FF) == byte)
            live, node, unit, depth = live[fits], (node ^ self._jump(unit))[fits], unit[fits], depth + 1
            ends = (unit >> 8) & 1 == 1
            lengths[live[ends]] = depth
            values[live[ends]] = self.units[node[ends]] & 0x7FFFFFFF
        return lengths, values


class Encoded(NamedTuple):
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class PieceModel:
    """A model file, with its own normaliser and segmentation of normalised text by the library."""

    def __init__(self, raw: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        #: Fields that are appended to a message replace what stands before: this copy neither maps, adds, removes nor escapes.
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=raw + bytes([3 << 3 | 2, 10, 2 << 3 | 2, 0, 3 << 3, 0, 4 << 3, 0, 5 << 3, 0, 6 << 3 | 2, 0]))
        pieces, spec, trainer = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece.get(1, b""), piece.get(3, NORMAL)))
            elif number == 2:
                trainer |= dict(_fields(value))
            elif number == 3:
                spec |= dict(_fields(value))
        self.map = CharacterMap(spec[2]) if spec.get(2) else None
        self.dummy, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.space = ESCAPED if spec.get(5, 1) else b" "
        self.at_end = bool(trainer.get(24, 0))
        own = sorted((p for p, kind in pieces if kind == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile(b"(?=(" + b"|".join(map(re.escape, own)) + b"))") if own else None
        self.lengths = np.array([1 if kind == BYTE else len(p) for p, kind in pieces], np.int64)
        self.unknown = next((i for i, (_, kind) in enumerate(pieces) if kind == UNKNOWN), -1)
        texts = [p.decode(errors="replace") for p, kind in pieces if kind in (NORMAL, USER_DEFINED, UNUSED)]
        #: Pairs of characters that a piece may hold side by side. Unknown characters are joined with their neighbours unless bytes stand for them.
        self.joined = {a + b for t in texts for a, b in zip(t, t[1:], strict=False)}
        self.known = None if trainer.get(35, 0) else set("".join(texts))
        self.cuts = trainer.get(3, 1) == BPE

    def _segments(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(start, end, value, replacements) of what the text is walked by; values index the replacements or are _COPY."""
        flat, wrong = np.frombuffer(data, np.uint8), []

        def skip(error: UnicodeDecodeError) -> tuple[str, int]:
            wrong.append(error.start)
            return "�", error.start + 1

        codecs.register_error("voxloom-places", skip)
        data.decode("utf-8", "voxloom-places")
        is_start = (flat & 0xC0) != 0x80
        is_start[wrong] = True
        starts = np.flatnonzero(is_start)
        ends, values = np.append(starts[1:], len(flat)), np.full(len(starts), _COPY, np.int64)
        if wrong:
            at = np.searchsorted(starts, wrong)
            values[at], ends[at] = _WRONG, starts[at] + 1
        table = [b" ", WRONG]
        found = np.where(values == _WRONG, 1, _COPY)
        chars = ends.copy()
        if self.map:
            lengths, mapped = self.map.longest(flat, starts)
            hit = np.flatnonzero(lengths)
            kinds, which = np.unique(mapped[hit], return_inverse=True)
            found[hit], ends[hit] = len(table) + which, starts[hit] + lengths[hit]
            table += [self.map.replacement(int(v)) for v in kinds]
        if self.own:
            for m in self.own.finditer(data):
                k = int(np.searchsorted(starts, m.start()))
                found[k], ends[k] = len(table), m.start() + len(m[1])
                table.append(m[1])
        found[(found == _COPY) & (flat[starts] == 0x20)] = 0
        kept, upto = np.ones(len(starts), bool), 0
        for k in np.flatnonzero(ends > chars).tolist():
            if starts[k] >= upto:
                upto = int(ends[k])
                kept[k + 1 : np.searchsorted(starts, upto)] = False
        return starts[kept], ends[kept], found[kept], table

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the place in ``data``: the first byte of what it was made from."""
        if not data:
            return b"", np.zeros(1, np.int64)
        starts, ends, found, table = self._segments(data)
        changed, size = found >= 0, len(table)
        leads = np.array([len(t) - len(t.lstrip(b" ")) for t in table])
        #: The second half of the table is for segments that lose their first spaces.
        forms = [t.replace(b" ", self.space) for t in table + [t.lstrip(b" ") for t in table]]
        head = 0
        if self.squeeze:
            bare = np.array([t == b" " for t in table])
            rest = np.flatnonzero(~(changed & bare[found]))
            if not len(rest):
                return b"", np.zeros(1, np.int64)
            head = int(starts[rest[0]])
            holds, after = ~changed | np.array([bool(t) for t in table])[found], changed & np.array([t.endswith(b" ") for t in table])[found]
            last = np.maximum.accumulate(np.where(holds, np.arange(len(starts)), -1))
            last = np.append(-1, last[:-1])
            spaced = np.where(last >= 0, after[last], True)
            found = np.where(changed & spaced & (leads[found] > 0), found + size, found)
        widths = np.where(changed, np.array([len(f) for f in forms])[found], ends - starts)
        prefix = self.space if self.dummy and not self.at_end else b""
        offsets = len(prefix) + np.cumsum(widths) - widths
        out = np.zeros(len(prefix) + int(widths.sum()), np.uint8)
        out[: len(prefix)] = np.frombuffer(prefix, np.uint8)
        align = np.concatenate((np.full(len(prefix), head), np.repeat(starts, widths), [len(data)]))
        plain = np.flatnonzero(~changed)
        reach = widths[plain]
        step = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
        out[np.repeat(offsets[plain], reach) + step] = np.frombuffer(data, np.uint8)[np.repeat(starts[plain], reach) + step]
        for v in np.unique(found[changed]).tolist():
            form, at = np.frombuffer(forms[v], np.uint8), offsets[changed & (found == v)]
            out[at[:, None] + np.arange(len(form))] = form
        text = out.tobytes()
        if self.squeeze:
            size = len(text)
            while text.endswith(self.space, 0, size):
                size -= len(self.space)
            text, align = text[:size], align[: size + 1]
        if self.dummy and self.at_end:
            text, align = text + self.space, np.concatenate((align[:-1], np.full(len(self.space) + 1, align[-1])))
        return text, align

    def parts(self, text: str) -> Iterator[str]:
        """The text, cut where no piece can reach across."""
        at, n = 0, len(text)
        while self.cuts and n - at > PART_CHARS:
            to = at + PART_CHARS
            while to < n and (text[to - 1 : to + 1] in self.joined or self.known is not None and not self.known.issuperset(text[to - 1 : to + 1])):
                to += 1
            yield text[at:to]
            at = to
        if at < n or not n:
            yield text[at:]

    def encode(self, texts: list[bytes], begin: bool = True, end: bool = True) -> list[Encoded]:
        """Of each text its ids, and the spans of original bytes that their pieces stand for. Begin and end ids have empty
        spans; of the byte pieces of one character the last has its span."""
        normal = [self.normalise(t) for t in texts]
        parts = [[p for p in self.parts(text.decode()) if p] for text, _ in normal]
        found = iter(self.plain.encode([p for of in parts for p in of], num_threads=1))
        out = []
        for data, (text, align), own in zip(texts, normal, parts, strict=True):
            ids = [np.array(next(found), np.int64) for _ in own]
            widths = [self.lengths[i] if not (i == self.unknown).any() else self._surfaces(p) for p, i in zip(own, ids, strict=True)]
            width = np.concatenate([*widths, np.zeros(0, np.int64)])
            upto = np.cumsum(width)
            if len(width) and upto[-1] != len(text):
                raise ValueError("pieces don't cover the normalised text")
            first, last = np.full(int(begin), 0), np.full(int(end), len(data))
            bos, eos = np.full(int(begin), self.library.bos_id()), np.full(int(end), self.library.eos_id())
            out.append(Encoded(np.concatenate((bos, *ids, eos)), np.concatenate((first, align[upto - width], last)), np.concatenate((first, align[upto], last))))
        return out

    def _surfaces(self, part: str) -> np.ndarray:
        """Lengths of the pieces of a part where some are unknown, and so of any length."""
        return np.array([len(p.surface.encode()) for p in self.plain.encode(part, return_type="proto").pieces], np.int64)


@functools.lru_cache(2)
def load_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True, spans: bool = True, pack: bool = False, decoded: bool = False) -> DataFrame:
    """A row per row of ``docs``: (doc_id, ids[, starts, ends], span_bytes[, decoded]).

    ids is an array, or with ``pack`` a binary of 32-bit little-endian numbers; starts and ends are arrays of byte places in
    the UTF-8 text, and span_bytes how many bytes the spans cover in all; decoded is what the library's decode makes of the ids. Null texts count as empty: begin and end ids
    alone. Bytes that aren't UTF-8 become U+FFFD one by one, as in the library. Rows that repeat, and null ids, are encoded
    as they stand; other columns are ignored; an empty table gives an empty result. ``model`` is a file that every
    executor has. Rows aren't shuffled.
    """
    fields = [("doc_id", pa.int64()), ("ids", pa.binary() if pack else pa.list_(pa.int64()))] + [("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))] * spans + [("span_bytes", pa.int64())] + [("decoded", pa.string())] * decoded
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load_model(model)

        def encoded(docs: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
            rows = [(d, e.ids.astype("<u4").tobytes() if pack else e.ids, *([e.starts, e.ends] if spans else []), int((e.ends - e.starts).sum()), *([own.library.decode(e.ids.tolist())] if decoded else [])) for d, e in zip(docs, own.encode(texts, begin, end), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            docs, texts, held = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                docs.append(doc.as_py())
                texts.append(text.as_py() or b"")
                held += len(texts[-1])
                if held >= BATCH_BYTES:
                    yield encoded(docs, texts)
                    docs, texts, held = [], [], 0
            if docs:
                yield encoded(docs, texts)

    ddl = f"doc_id long, ids {'binary' if pack else 'array<long>'}, " + "starts array<long>, ends array<long>, " * spans + "span_bytes long" + ", decoded string" * decoded
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string").cast("binary")).mapInArrow(run, ddl)


def decode_ids(encoded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the library decodes each row's ids, an array or packed, to. A null gives null, no ids an empty text. A column of
    the name ``out_col`` is replaced; others may have any name."""
    names = [c for c in encoded.columns if c != out_col]
    schema = encoded.select(packed(names).alias("row"), F.lit(None).cast("string").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = load_model(model).library
        for batch in batches:
            texts = [None if x is None else library.decode(np.frombuffer(x, "<u4").tolist() if isinstance(x, bytes) else x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return encoded.select(packed(names).alias("row"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, schema).select(*unpacked("row", names), F.col("text").alias(out_col))

