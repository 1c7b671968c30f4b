"""Chat formatting of typed content parts, with DataFrame functions only.

A visitor flattens the parts of every turn in order: text is escaped, an image, audio or document part becomes a
placeholder and an attachment record with the tokens it expands to. Turns are marked by control strings, all of which
begin with ``<|``; as ``<`` and ``&`` never stand in escaped text, no text can hold or form one, and escaping is undone
exactly. Placeholders are ``<|part:TYPE|>``: a name of their own, in which ``|`` is escaped as well, so no type can form a
control string, and a reader tells a placeholder from a text that looks like one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, prefix_sums

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PART, PART_END = "<|part:", "|>"
#: Tokens that one unit of a part expands to: an image's tile, a second of audio, a page of a document.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """One typed part that holds a text."""
    return F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units"))


def _kind(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text"))


def _visit(part: Column) -> Column:
    kind = _kind(part)
    placeholder = F.concat(F.lit(PART), F.replace(escape(kind), F.lit("|"), F.lit("&bar;")), F.lit(PART_END))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(placeholder)


def format_chats(turns: DataFrame, unit_tokens: Mapping[str, int] | None = None) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, placeholder_tokens) per conversation.

    ``turns`` has conv_id, turn, role and parts, an array of structs (type, text, ref, units). Turns are put in the
    order of turn, then role, then parts, so ties and repeats have one order. Null roles and texts count as empty, a
    null array of parts as none, a null type as text. loss_spans are (start, length) in code points of each text part of an assistant
    turn in ``formatted``: placeholders lie between spans, never within; attachments are (index, type, ref, tokens) in order of their placeholders. A null
    conv_id is one conversation. An empty table gives an empty result; other columns are ignored.
    A conversation is one value of its text columns, so a task has to hold its longest one.
    """
    tokens = F.create_map(*[x for k, v in (unit_tokens or UNIT_TOKENS).items() for x in (F.lit(k), F.lit(v))])
    flat = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(turns.schema["parts"].dataType)).alias("parts")).alias("t"),
    )
    whole = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    visited = whole.select(
        "conv_id",
        "ts",
        F.transform("ts", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)).alias("head"), F.transform(t["parts"], lambda p: F.struct((_kind(p) == "text").alias("said"), _visit(p).alias("body"))).alias("parts"))).alias("vs"),
    )
    #: What follows one another in a turn: its head, its parts, its end.
    run = lambda length, loss: F.struct(length.cast("long").alias("length"), loss.alias("loss"))
    of_turn = lambda v: F.concat(F.array(run(F.length(v["head"]), F.lit(False))), F.transform(v["parts"], lambda p: run(F.length(p["body"]), p["said"] & (v["role"] == "assistant"))), F.array(run(F.lit(len(END)), F.lit(False))))
    sized = visited.select("conv_id", "ts", "vs", F.flatten(F.transform("vs", of_turn)).alias("ls"))
    placed = let(prefix_sums(F.transform("ls", lambda x: x["length"])), lambda before: F.transform("ls", lambda x, i: F.struct(x["loss"].alias("loss"), F.get(before, i).alias("start"), x["length"].alias("length"))))
    spans = F.transform(F.filter(placed, lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    media = F.filter(F.flatten(F.transform("ts", lambda t: t["parts"])), lambda p: _kind(p) != "text")
    attachments = F.transform(media, lambda p, i: F.struct(i.alias("index"), p["type"].alias("type"), p["ref"].alias("ref"), (F.coalesce(tokens[p["type"]], F.lit(1)) * F.coalesce(p["units"], F.lit(1))).cast("long").alias("tokens")))
    out = sized.select(
        "conv_id",
        F.array_join(F.transform("vs", lambda v: F.concat(v["head"], F.array_join(F.transform(v["parts"], lambda p: p["body"]), ""), F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"),
        attachments.alias("attachments"),
    )
    return out.withColumn("placeholder_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_parts(body: Column) -> Column:
    """Array of (type, text) from what stands between a turn's body mark and its end: texts, neighbouring ones as one and empty ones left out, and
    the other parts, whose text is null."""

    def of(pieces: Column) -> Column:
        said = lambda x: F.struct(F.lit("text").alias("type"), unescape(x).alias("text"))
        kind = lambda x: F.struct(unescape(F.replace(x, F.lit("&bar;"), F.lit("|"))).alias("type"), F.lit(None).cast("string").alias("text"))
        after = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: let(F.split(p, r"\|>", 2), lambda q: F.array(kind(q[0]), said(q[1]))))
        return F.filter(F.concat(F.array(said(pieces[0])), F.flatten(after)), lambda p: F.coalesce(p["text"], F.lit("-")) != "")

    return let(F.split(body, r"<\|part:", -1), of)


def read_turns(formatted: Column) -> Column:
    """Array of (role, text, parts) from a formatted conversation; text is all texts of the turn, parts are those of ``read_parts``."""
    chunks = F.slice(F.split(formatted, r"<\|turn\|>", -1), F.lit(2), F.size(F.split(formatted, r"<\|turn\|>", -1)))
    pieces = F.transform(chunks, lambda c: F.split(F.substring(c, F.lit(1), F.length(c) - len(END)), r"<\|body\|>", 2))
    typed = F.transform(pieces, lambda p: F.struct(unescape(p[0]).alias("role"), read_parts(p[1]).alias("parts")))
    return F.transform(typed, lambda t: F.struct(t["role"].alias("role"), F.array_join(F.transform(F.filter(t["parts"], lambda p: p["type"] == "text"), lambda p: p["text"]), "").alias("text"), t["parts"].alias("parts")))


def media_parts(turns: Column) -> Column:
    """(turn, type) of the parts of ``read_turns`` that aren't text, in order: the kth belongs to the kth attachment."""
    return F.flatten(F.transform(turns, lambda t, i: F.transform(F.filter(t["parts"], lambda p: p["type"] != "text"), lambda p: F.struct(i.alias("turn"), p["type"].alias("type")))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chat_oracle() -> str:
    return """
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-1::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(replace(replace(role, '&', '&amp;'), '<', '&lt;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""
