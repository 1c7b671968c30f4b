"""Mixing sources to target weights: tokens per source, repetition rates, then whole copies plus one seeded Bernoulli copy.

DataFrame functions only. Two passes over the documents; the only shuffle is the sum per source, combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.scratch import Scratch, is_small

from .columns import packed, unpacked

#: Sources up to which their table is broadcast; it is counted first. Beyond, rows are joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_rates(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times all sizes. A target above
    ``cap`` times its source's size stops there, and the excess is shared by weight until none is above. With sources
    in the order of cap / weight, the stopped ones are a prefix: source i stops if what the first i - 1 leave, shared
    by the weights from i on, is above its cap. Sources without words get target and rate 0.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = sums.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    named = named.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    stopped = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    named = named.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - stopped) / left)
    named = named.withColumn("open", F.col("weight") * F.col("level") <= F.col("most"))
    named = named.withColumn("final", F.min_by("level", F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source")))).over(everything))
    target = F.least(F.col("most"), F.col("weight") * F.col("final"))
    return named.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def bernoulli(id_col: Column, seed: int, chance: Column) -> Column:
    """True with the given chance, by a hash of seed and id, a string."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), id_col)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return u < chance


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, keep: Sequence[str] | None = None, out: str = "mix") -> DataFrame:
    """Every row of ``docs`` with its (size, source_size, target, copies) in the struct column ``out``, beside ``keep`` (default: all columns).

    copies is floor(rate) plus one with the chance of rate's fraction, so at most ``cap`` rounded up. Null texts have
    size 0; null sources are one source. Draws are hashes of seed and id, or of seed and text where there is no id, so reruns
    agree, and rows that repeat an id, or a text without an id, get the same draw. An empty table gives an empty result. A column
    of ``docs`` named as ``out`` is replaced; others may have any names. The table of sources is put in order in one task:
    up to some millions of sources.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    sized = docs.select(source.alias("source"), word_count(text).alias("size"))
    rates = scratch.put(source_rates(sized, weights, share, cap), "rates")
    rates = rates.select(F.struct("source", "source_size", "target", "rate").alias("rate"))
    columns = [c for c in (docs.columns if keep is None else keep) if c != out]
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    wide = docs.select(packed(columns).alias("row") if columns else F.lit(None).alias("row"), key.alias("key"), source.alias("source"), word_count(text).alias("size"))
    joined = wide.join(F.broadcast(rates) if is_small(rates, BROADCAST_SOURCES) else rates, F.col("source").eqNullSafe(F.col("rate.source")))
    whole = F.floor("rate.rate")
    copies = whole + bernoulli(F.col("key"), seed, F.col("rate.rate") - whole).cast("long")
    mix = F.struct("size", F.col("rate.source_size").alias("source_size"), F.col("rate.target").alias("target"), copies.alias("copies"))
    return joined.select(*unpacked("row", columns), mix.alias(out))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs``, with its columns, as many times as ``plan_mix`` says (0 times or more)."""
    name = "mix"
    while name in docs.columns:
        name += "_"
    plan = plan_mix(docs, out=name, **options).where(F.col(f"{name}.copies") > 0)
    copies = plan.select(packed(docs.columns).alias("row"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{name}.copies"))).alias("copy"))
    return copies.select(*unpacked("row", docs.columns))


def mix_oracle() -> str:
    return r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) AS key FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM sums),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER w, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE)) AS level
  FROM named WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT level FROM levels WHERE weight * level <= most ORDER BY most / weight, source NULLS LAST LIMIT 1),
rates AS (SELECT source, source_size, least(most, weight * final.level) AS target, CASE WHEN source_size > 0 THEN least(most, weight * final.level) / source_size ELSE 0 END AS rate FROM levels, final)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('7:' || key), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source"""
