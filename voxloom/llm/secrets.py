"""Secret scans with multipart credential linking, with DataFrame functions only.

Strong candidates (assignments, access identifiers, long hex runs) are always reported. Weak ones, an assigned user or
client name, a bare key-like string, a URL, are parts of a credential only beside their complements: an interval join within
each document looks for identifiers, secrets and endpoints that are apart from the candidate, and no further than a scope. The join is
a sweep over the parts' starts and ends: what has ended where a part starts lies before it, what starts where it has ended lies behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.scratch import Scratch

from .columns import let, packed, prefix_sums

#: Base kinds in the order of the contract, then the kinds that linking adds.
KINDS = ("assign", "access", "hex", "link_id", "link_secret", "link_endpoint")
#: Patterns: fixed values of the contract, the first group of a kind in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Weak parts.
WEAK_ID = r"""(?<![A-Za-z0-9_])(?i:access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9A-Z+/_-]*[a-z])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/=_-])"
WEAK_ENDPOINT = r"""(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+"""
#: Code points between complementary parts at most.
SCOPE = 200
_SPANS = "array<struct<start: bigint, kind: int, end: bigint>>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans in code points of the leftmost, non-overlapping matches whose group has that many characters.

    What stands between the matches is what splitting by the same pattern leaves, so lengths give the places.
    """
    p = F.lit(pattern)
    found = F.struct(F.split(text, p, -1).alias("gaps"), F.regexp_extract_all(text, p, F.lit(0)).alias("hits"), F.regexp_extract_all(text, p, F.lit(group)).alias("groups"))

    def of(x: Column) -> Column:
        widths = F.transform(x["hits"], lambda h, i: (F.length(F.get(x["gaps"], i)) + F.length(h)).cast("long"))
        return let(prefix_sums(widths), lambda before: F.filter(F.transform(x["hits"], lambda h, i: F.struct((F.get(before, i) + F.length(F.get(x["gaps"], i))).cast("bigint").alias("start"), F.lit(kind).alias("kind"), (F.get(before, i) + F.length(F.get(x["gaps"], i)) + F.length(h)).cast("bigint").alias("end"), (F.length(F.get(x["groups"], i)) >= least).alias("fits"))), lambda s: s["fits"]))

    plain = F.transform(let(found, of), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), plain).otherwise(F.array().cast(_SPANS))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """A row per row of ``docs``: (doc_id, text_key, spans), spans an array of (start, kind, end) in order; kind is an index of ``KINDS``.

    Places are code points, ends exclusive. Spans of different base kinds may overlap; linked spans don't overlap a base
    span. A weak identifier is reported if a secret lies within ``scope``, a weak secret if an identifier or an
    endpoint does, an endpoint if both do. What shares a character with a candidate doesn't count for it, so no part is its own
    complement, and a secret inside of one address is linked to another. text_key is a hash of the text: rows that repeat id and text get equal
    results. Null texts count as empty and have no spans; null ids are kept. Other columns are ignored.
    An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    base = F.concat(_spans(text, ASSIGN, 0, group=2, least=6), _spans(text, ACCESS, 1, least=20), _spans(text, HEX, 2))
    weak = F.concat(_spans(text, WEAK_ID, 3), _spans(text, WEAK_SECRET, 4), _spans(text, WEAK_ENDPOINT, 5))
    found = scratch.put(flat.select("doc_id", F.xxhash64(text).alias("text_key"), base.alias("base"), weak.alias("weak")), "found")

    key = ["doc_id", "text_key"]
    parts = found.where(F.size("weak") > 0).dropDuplicates(key).select(*key, F.explode(F.concat("base", "weak")).alias("s")).select(*key, "s.start", "s.kind", "s.end")
    is_a = {"id": F.col("kind").isin(1, 3), "secret": F.col("kind").isin(0, 2, 4), "endpoint": F.col("kind") == 5, "base": F.col("kind") < 3}
    #: A start and an end of each part; at one place ends come first, so that parts which touch are apart.
    event = lambda place, opens: F.struct(place.alias("place"), F.lit(opens).alias("opens"))
    events = parts.withColumn("e", F.explode(F.array(event(F.col("start"), 1), event(F.col("end"), 0)))).select("*", "e.place", "e.opens")
    ahead = Window.partitionBy(*key).orderBy("place", "opens").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*key).orderBy(F.desc("place"), F.desc("opens")).rowsBetween(Window.unboundedPreceding, -1)
    names = ("id", "secret", "endpoint")
    seen = [F.max(F.when((F.col("opens") == 0) & is_a[n], F.col("place"))).over(ahead).alias(f"end_{n}") for n in names]
    seen += [F.min(F.when((F.col("opens") == 1) & is_a[n], F.col("place"))).over(back).alias(f"start_{n}") for n in names]
    seen += [F.count(F.when((F.col("opens") == opens) & is_a["base"], True)).over(ahead).alias(f"base_{opens}") for opens in (0, 1)]
    at_start, at_end = F.col("opens") == 1, F.col("opens") == 0
    swept = events.select("*", *seen).where(F.col("kind") >= 3).groupBy(*key, "start", "kind", "end").agg(
        *[F.coalesce(F.max(F.when(at_start, F.col("start") - F.col(f"end_{n}") <= scope)), F.lit(False)).alias(f"before_{n}") for n in names],
        *[F.coalesce(F.max(F.when(at_end, F.col(f"start_{n}") - F.col("end") <= scope)), F.lit(False)).alias(f"after_{n}") for n in names],
        #: Base spans that have begun before this one's end, less those that have ended at its start.
        (F.max(F.when(at_end, F.col("base_1"))) - F.max(F.when(at_start, F.col("base_0")))).alias("over"),
    )
    near = lambda n: F.col(f"before_{n}") | F.col(f"after_{n}")
    linked = F.when(F.col("kind") == 3, near("secret")).when(F.col("kind") == 4, near("id") | near("endpoint")).otherwise(near("id") & near("secret"))
    added = swept.where(linked & (F.col("over") == 0)).groupBy(*key).agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    added = added.select(F.struct(*key).alias("k"), "added")
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_key") == F.col("k.text_key")), "left")
    return joined.select(*key, F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(_SPANS)))).alias("spans"))


def describe(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping ones, as ``[KIND]`` of the first."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    piece = lambda start, end: F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece(acc["at"], s["start"]), F.get(marks, s["kind"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), piece(acc["at"], F.length(text).cast("bigint"))))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with the secrets in its texts replaced by their kinds; rows, other columns and null texts stay."""
    spans = find_secrets(docs, id_col, text_col, scope).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    text = F.col(f"`{text_col}`")
    own = docs.select(packed(docs.columns).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("key"))
    joined = own.join(spans.select(F.struct("doc_id", "text_key", "spans").alias("found")), F.col("id").eqNullSafe(F.col("found.doc_id")) & (F.col("key") == F.col("found.text_key")), "left")
    clean = F.when(F.col("found").isNotNull(), redacted(F.col("text"), F.col("found.spans"))).otherwise(F.col("text"))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
