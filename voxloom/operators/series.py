"""Ordered series: running sums at scale, runs, smoothing, interpolation, peaks, adjustment of p values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which a missing key is a key like any other, as it is for windows and grouping. Without keys ``right`` has one row, or
    none; it is paired with every row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    own = right.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])
    return left.join(own, same, how).drop(*[f"__key{i}" for i in range(len(keys))])


def range_edges(df: DataFrame, order: str, buckets: int = 64) -> list[float]:
    """Approximate quantiles of the whole table, so that no key or table has to be put in order by one task."""
    return sorted(set(df.approxQuantile(order, [k / buckets for k in range(1, buckets)], 1 / (8 * buckets))))


def bucket_of(order: str, edges: Sequence[float]) -> Column:
    """Range of ``order`` that a row is in. Rows with one value are in one range; missing ones are in the first."""

    def place(low: int, high: int) -> Column:
        """How many of the edges before ``high`` are below the value, if ``low`` are: a search by halves."""
        mid = (low + high) // 2
        return F.lit(low) if low == high else F.when(F.col(order) > F.lit(float(edges[mid])), place(mid + 1, high)).otherwise(place(low, mid))

    return place(0, len(edges))


def running_total(df: DataFrame, order: str, tie: str, value: Column, out: str, keys: Sequence[str] = (), buckets: int = 64, edges: Sequence[float] | None = None) -> DataFrame:
    """``df`` with the running sum of ``value`` in the order of (order, tie), within keys.

    One window over a whole table, or a frequent key, would be one task. Rows are put into ranges of ``order``, summed per range,
    and only ranges are windowed: each task numbers one range of a key and adds what comes before. ``edges`` are those of ``range_edges``,
    for a caller that has them. Missing keys are a key; a missing order comes first.
    """
    marked = df.withColumn("__bucket", bucket_of(order, range_edges(df, order, buckets) if edges is None else edges)).withColumn("__value", value)
    sums = marked.groupBy(*keys, "__bucket").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy(*keys, "__bucket").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    return same_keys(marked.withColumn("__run", F.sum("__value").over(own)), offsets, [*keys, "__bucket"]).withColumn(out, F.col("__before") + F.col("__run")).drop("__bucket", "__value", "__run", "__before")


def interpolate(queries: DataFrame, knots: DataFrame, x: str, y: str, keys: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """``queries`` with ``y`` interpolated linearly between the bracketing knots, clamped at the ends; of knots with one x the largest y counts.
    Knots that miss x or y take no part; a query without x, or whose key has no knots, gets NULL. Missing keys are a key.

    A sort-merge sweep: knots and queries in one order, with the last knot before and the first after each query. Ranges of x are
    swept apart, and take the nearest knots of the ranges beside them from one row per range.
    """
    have = knots.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x).agg(F.max(y).alias("__y"))
    edges = range_edges(have, x, buckets)
    bucket = bucket_of(x, edges)
    both = queries.withColumn("__q", F.lit(True)).unionByName(have.withColumn("__q", F.lit(False)), allowMissingColumns=True).withColumn("__bucket", bucket)
    knot = F.when(~F.col("__q"), F.struct(F.col(x).cast("double").alias("x"), F.col("__y").alias("y")))
    ends = have.select(*keys, bucket.alias("__bucket"), F.struct(F.col(x).cast("double").alias("x"), F.col("__y").alias("y")).alias("__k")).groupBy(*keys, "__bucket").agg(F.min("__k").alias("__low"), F.max("__k").alias("__high"))
    domain = queries.select(*keys).distinct() if keys else queries.sparkSession.range(1).select()
    every = same_keys(domain.withColumn("__bucket", F.explode(F.sequence(F.lit(0), F.lit(len(edges))))), ends, [*keys, "__bucket"], "left")
    order = Window.partitionBy(*keys).orderBy("__bucket")
    beside = every.select(*keys, "__bucket", F.max("__high").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.min("__low").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    ahead = Window.partitionBy(*keys, "__bucket").orderBy(F.col(x), F.col("__q")).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys, "__bucket").orderBy(F.desc(x), F.col("__q")).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("__a", F.last(knot, ignorenulls=True).over(ahead)).withColumn("__b", F.last(knot, ignorenulls=True).over(back)).where("__q")
    swept = same_keys(swept, beside, [*keys, "__bucket"]).withColumn("__a", F.coalesce("__a", "__before")).withColumn("__b", F.coalesce("__b", "__after"))
    width = F.col("__b.x") - F.col("__a.x")
    line = F.col("__a.y") + (F.col("__b.y") - F.col("__a.y")) * ((F.col(x) - F.col("__a.x")) / width)
    value = F.when(F.col(x).isNull(), None).when(F.col("__a").isNull(), F.col("__b.y")).when(F.col("__b").isNull() | (width == 0), F.col("__a.y")).otherwise(line)
    return swept.withColumn(y, value).drop("__q", "__y", "__a", "__b", "__bucket", "__before", "__after")


def runs(df: DataFrame, at: str, good: Column, keys: Sequence[str]) -> DataFrame:
    """(keys, start, end, n): maximal runs of consecutive positions where ``good`` holds."""
    by = Window.partitionBy(*keys).orderBy(at)
    kept = df.where(good).withColumn("__group", F.col(at) - F.row_number().over(by))
    return kept.groupBy(*keys, "__group").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("__group")


def longest_run(df: DataFrame, at: str, good: Column, keys: Sequence[str]) -> DataFrame:
    """The longest run of each key, the first of equals."""
    by = Window.partitionBy(*keys).orderBy(F.desc("n"), "start")
    return runs(df, at, good, keys).withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def end_trim(df: DataFrame, at: str, good: Column, keys: Sequence[str]) -> DataFrame:
    """Rows from the first to the last good position."""
    flag = F.max(good.cast("int"))
    ahead = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__a", flag.over(ahead)).withColumn("__b", flag.over(back)).where("__a = 1 and __b = 1").drop("__a", "__b")


def moving_median(df: DataFrame, at: str, value: str, half: int, keys: Sequence[str], out: str = "median") -> DataFrame:
    """Median of the ``2 half + 1`` rows around each, fewer at the ends."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(-half, half)
    return df.withColumn(out, F.percentile(F.col(value), F.lit(0.5)).over(w))


def moving_average(df: DataFrame, at: str, value: str, half: int, keys: Sequence[str], out: str = "mean") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(-half, half)
    return df.withColumn(out, F.avg(value).over(w))


def smoothed(df: DataFrame, at: str, value: str, weights: Sequence[float], keys: Sequence[str], out: str = "smooth") -> DataFrame:
    """Weighted sum of neighbouring rows, the ends repeated; weights are centred and of odd number."""
    w = Window.partitionBy(*keys).orderBy(at)
    half, first, last = len(weights) // 2, F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last(value).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = [F.coalesce(F.lag(value, -k).over(w), first if k < 0 else last) * F.lit(float(f)) for k, f in zip(range(-half, half + 1), weights, strict=True)]
    return df.withColumn(out, sum(near[1:], near[0]))


def peaks(df: DataFrame, at: str, value: str, keys: Sequence[str], height: float) -> DataFrame:
    """Strict local maxima of at least ``height``; plateaus aren't peaks."""
    w = Window.partitionBy(*keys).orderBy(at)
    return df.withColumn("__a", F.lag(value).over(w)).withColumn("__b", F.lead(value).over(w)).where((F.col(value) > F.col("__a")) & (F.col(value) > F.col("__b")) & (F.col(value) >= height)).drop("__a", "__b")


def find_peaks(df: DataFrame, at: str, value: str, keys: Sequence[str], height: float, distance: int, prominence: float) -> DataFrame:
    """(keys, at, value, prominence): plateau-aware maxima, thinned to ``distance`` from the highest down, then by prominence.

    A group is one profile, such as a histogram: its length is bounded by its bins.
    """
    import numpy as np
    import pandas as pd

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at).reset_index(drop=True)
        v = part[value].to_numpy(float)
        found, k = [], 1
        while k < len(v) - 1:
            if v[k - 1] < v[k]:
                e = k
                while e < len(v) - 1 and v[e + 1] == v[k]:
                    e += 1
                if e < len(v) - 1 and v[e + 1] < v[k] and v[k] >= height:
                    found.append((k + e) // 2)
                k = e + 1
            else:
                k += 1
        alive = dict.fromkeys(found, True)
        for p in sorted(found, key=lambda p: (-v[p], -p)):
            if alive[p]:
                for o in found:
                    if o != p and abs(o - p) < distance:
                        alive[o] = False
        rows = []
        for p in (p for p in found if alive[p]):
            left = v[: p + 1][::-1]
            right = v[p:]
            base = max(left[: int(np.argmax(left > v[p])) or len(left)].min(), right[: int(np.argmax(right > v[p])) or len(right)].min())
            if v[p] - base >= prominence:
                rows.append((*part.loc[p, list(keys)], part.loc[p, at], v[p], v[p] - base))
        return pd.DataFrame(rows, columns=[*keys, at, value, "prominence"])

    kinds = dict(df.dtypes)
    ddl = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {at} {kinds[at]}, {value} double, prominence double"
    return df.select(*keys, at, F.col(value).cast("double").alias(value)).groupBy(*keys).applyInPandas(one, ddl)


def benjamini_hochberg(df: DataFrame, p: str, tie: str, keys: Sequence[str] = (), out: str = "p_bh", buckets: int = 64) -> DataFrame:
    """Adjusted p values: the least of p n / rank from each rank on, at most 1; missing p stay missing and don't count. By ranges of p, as ``running_total``."""
    have = df.where(F.col(p).isNotNull())
    edges = range_edges(have, p, buckets)
    ranked = running_total(have, p, tie, F.lit(1), "__rank", keys, buckets, edges).withColumn("__bucket", bucket_of(p, edges))
    n = have.groupBy(*keys).agg(F.count("*").alias("__n"))
    scaled = same_keys(ranked, n, keys).withColumn("__s", F.col(p) * F.col("__n") / F.col("__rank"))
    least = scaled.groupBy(*keys, "__bucket").agg(F.min("__s").alias("__m"))
    later = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(1, Window.unboundedFollowing)
    least = least.select(*keys, "__bucket", F.min("__m").over(later).alias("__later"))
    down = Window.partitionBy(*keys, "__bucket").orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    done = same_keys(scaled.withColumn("__s", F.min("__s").over(down)), least, [*keys, "__bucket"])
    done = done.withColumn(out, F.least("__s", "__later", F.lit(1.0))).select(*df.columns, out)
    return done.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))
