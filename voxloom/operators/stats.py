"""Distributions, fits and tests over object tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.geometry import eigenvalues3
from voxloom.operators.series import interpolate, running_total, same_keys
from voxloom.scratch import Scratch, is_small

#: Keys whose brackets are broadcast.
FEW_KEYS = 10_000


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin of [low, high) with the last bin closed; NULL outside."""
    k = F.floor((value - low) / ((high - low) / bins)).cast("int")
    return F.when((value >= low) & (value <= high), F.least(k, F.lit(bins - 1)))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(keys, bin, n) with every bin of every key present, zero-filled."""
    n = F.count("*") if weight is None else F.sum(weight)
    got = df.withColumn("bin", bin_of(value, low, high, bins)).where("bin is not null").groupBy(*keys, "bin").agg(n.alias("n"))
    domain = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    every = domain.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return same_keys(every, got, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def value_counts(df: DataFrame, column: str, domain: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, n): counts of a fixed domain, zeros included, in one pass."""
    marks = [F.count(F.when(F.col(column) == v, 1)).alias(f"__{k}") for k, v in enumerate(domain)]
    wide = df.groupBy(*keys).agg(*marks)
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias(column), F.col(f"__{k}").alias("n")) for k, v in enumerate(domain)]))
    return wide.select(*keys, pairs.alias("__p")).select(*keys, f"__p.{column}", "__p.n")


def cumulative_q3(df: DataFrame, size: str, tie: str, weight: Column, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with q3, the percentage of weight at or below each size in order."""
    run = running_total(df, size, tie, weight, "__cum", keys)
    total = df.groupBy(*keys).agg(F.sum(weight).alias("__total"))
    return same_keys(run, total, keys).withColumn("q3", F.lit(100.0) * F.col("__cum") / F.col("__total")).drop("__cum", "__total")


def percentiles_q3(curve: DataFrame, size: str, at: Sequence[float]) -> DataFrame:
    """(q3, size): the size at given percentages, linear between points of the curve and clamped at its ends."""
    spark = curve.sparkSession
    queries = spark.createDataFrame([(float(q),) for q in at], "q3 double")
    return interpolate(queries, curve.select("q3", size), "q3", size)


def covariance(df: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("z", "y", "x"), sample: bool = False) -> DataFrame:
    """(keys, n, centre c*, covariances s**) from one aggregation."""
    cov = F.covar_samp if sample else F.covar_pop
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"c{a}") for a in axes], *[cov(a, b).alias(f"s{a}{b}") for a, b in pairs])


def plane_fit(df: DataFrame, keys: Sequence[str], sample: bool = False) -> DataFrame:
    """(keys, n, centre, l1, l2, l3, nz, ny, nx, rms): principal values, the largest first, the normal and the distance to the plane.

    The normal is the null vector of S - l3 I, the longest of the cross products of its rows, with nz >= 0.
    """
    c = covariance(df, keys, sample=sample)
    xx, yy, zz, xy, xz, yz = (F.col(n) for n in ("szz", "syy", "sxx", "szy", "szx", "syx"))
    l1, l2, l3 = eigenvalues3(xx, yy, zz, xy, xz, yz)
    c = c.withColumns({"l1": l1, "l2": l2, "l3": l3})
    k = F.col("l3")
    rows = [(F.col("szz") - k, F.col("szy"), F.col("szx")), (F.col("szy"), F.col("syy") - k, F.col("syx")), (F.col("szx"), F.col("syx"), F.col("sxx") - k)]
    cross = lambda p, q: (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    vectors = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    best = F.greatest(*[F.struct((v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias("m"), v[0].alias("z"), v[1].alias("y"), v[2].alias("x")) for v in vectors])
    c = c.withColumn("v", best)
    sign = F.when(F.col("v.z") < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) / F.sqrt(F.greatest(F.col("v.m"), F.lit(1e-300)))
    return c.select(*keys, "n", "cz", "cy", "cx", "l1", "l2", "l3", *[(F.col(f"v.{a}") * sign).alias(f"n{a}") for a in ("z", "y", "x")], F.sqrt(F.greatest(k, F.lit(0.0))).alias("rms"))


def slope_through_origin(x: str, y: str) -> Column:
    return F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))


def contrast(df: DataFrame, value: str, phase: str, low: int, high: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, snr, cnr) of two phases: the high phase's mean over its deviation, and the gap between both means over the root of their
    mean variance. Deviations are those of the population."""
    of = lambda f, k: f(F.when(F.col(phase) == k, F.col(value)))
    a, b, va, vb = of(F.avg, low), of(F.avg, high), of(F.var_pop, low), of(F.var_pop, high)
    return df.groupBy(*keys).agg(F.try_divide(b, F.sqrt(vb)).alias("snr"), F.try_divide(F.abs(b - a), F.sqrt((va + vb) / 2)).alias("cnr"))


def principal_axis(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, cz, cy, cx, az, ay, ax): centre and unit vector of largest variance, its first non-zero component positive.

    The axis is the longest column of (S - l2 I)(S - l3 I), which takes out the other two principal directions.
    """
    c = covariance(df, keys)
    names = [("szz", "szy", "szx"), ("szy", "syy", "syx"), ("szx", "syx", "sxx")]
    l1, l2, l3 = eigenvalues3(*(F.col(n) for n in ("szz", "syy", "sxx", "szy", "szx", "syx")))
    c = c.withColumns({"l2": l2, "l3": l3})
    m = lambda i, j, x: F.col(names[i][j]) - (F.col(x) if i == j else F.lit(0.0))
    product = [[sum((m(i, k, "l2") * m(k, j, "l3") for k in (1, 2)), m(i, 0, "l2") * m(0, j, "l3")) for j in range(3)] for i in range(3)]
    columns = [F.struct((product[0][j] * product[0][j] + product[1][j] * product[1][j] + product[2][j] * product[2][j]).alias("m"), *[product[i][j].alias(a) for i, a in enumerate("zyx")]) for j in range(3)]
    c = c.withColumn("v", F.greatest(*columns))
    first = F.when(F.abs(F.col("v.z")) > 1e-12 * F.sqrt("v.m"), F.col("v.z")).when(F.abs(F.col("v.y")) > 1e-12 * F.sqrt("v.m"), F.col("v.y")).otherwise(F.col("v.x"))
    scale = F.when(first < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) / F.sqrt("v.m")
    return c.select(*keys, "n", "cz", "cy", "cx", *[F.when(F.col("v.m") > 0, F.col(f"v.{a}") * scale).otherwise(F.lit(float(a == "z"))).alias(f"a{a}") for a in "zyx"])


def weighted_moments(df: DataFrame, value: str, weight: str, keys: Sequence[str]) -> DataFrame:
    """(keys, mean, ra, rq, rt, rsk, rku): two passes, both by partial sums."""
    mean = df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))
    off = same_keys(df, mean, keys).withColumn("__d", F.col(value) - F.col("mean"))
    w, d = F.col(weight), F.col("__d")
    sums = off.groupBy(*keys, "mean").agg(F.sum(w).alias("w"), F.sum(w * F.abs(d)).alias("s1"), F.sum(w * d * d).alias("s2"), F.sum(w * d * d * d).alias("s3"), F.sum(w * d * d * d * d).alias("s4"), (F.max(value) - F.min(value)).alias("rt"))
    rq = F.sqrt(F.col("s2") / F.col("w"))
    return sums.select(*keys, "mean", (F.col("s1") / F.col("w")).alias("ra"), rq.alias("rq"), "rt", F.try_divide(F.col("s3") / F.col("w"), rq * rq * rq).alias("rsk"), F.try_divide(F.col("s4") / F.col("w"), rq * rq * rq * rq).alias("rku"))


def otsu(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cut): the bin after which classes differ most, the first of equals. ``hist`` has (keys, bin, n) with a bounded number of bins."""
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    h = hist.select(*keys, "bin", F.sum("n").over(up).alias("w"), F.sum(F.col("n") * F.col("bin")).over(up).alias("m"), F.sum("n").over(every).alias("wt"), F.sum(F.col("n") * F.col("bin")).over(every).alias("mt"))
    w, m, rest = F.col("w").cast("double"), F.col("m").cast("double"), (F.col("wt") - F.col("w")).cast("double")
    gap = m / w - (F.col("mt") - m) / rest
    scored = h.where("w > 0 and wt > w").withColumn("between", w * rest * gap * gap)
    return scored.groupBy(*keys).agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("cut"))


def multi_otsu(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cut1, cut2): two cuts that make the variance between three classes largest."""
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    h = hist.select(*keys, "bin", F.sum("n").over(up).cast("double").alias("w"), F.sum(F.col("n") * F.col("bin")).over(up).cast("double").alias("m"), F.sum("n").over(every).cast("double").alias("wt"), F.sum(F.col("n") * F.col("bin")).over(every).cast("double").alias("mt"))
    a = h.select(*keys, F.col("bin").alias("cut1"), F.col("w").alias("w1"), F.col("m").alias("m1"))
    b = h.select(*keys, F.col("bin").alias("cut2"), F.col("w").alias("w2"), F.col("m").alias("m2"), "wt", "mt")
    pairs = same_keys(a, b, keys).where("cut1 < cut2")
    of = lambda m, w: m * m / w
    score = of(F.col("m1"), F.col("w1")) + of(F.col("m2") - F.col("m1"), F.col("w2") - F.col("w1")) + of(F.col("mt") - F.col("m2"), F.col("wt") - F.col("w2"))
    scored = pairs.where("w1 > 0 and w2 > w1 and wt > w2").withColumn("score", score)
    best = F.max_by(F.struct("cut1", "cut2"), F.struct("score", -F.col("cut1"), -F.col("cut2")))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.cut1", "b.cut2")


def exact_sample(df: DataFrame, size: int, id_col: str, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """The ``size`` rows of each key with the least md5 of ``seed:id``: reruns agree, and so does SQL."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    if not keys:
        return df.orderBy(order, id_col).limit(size)
    by = Window.partitionBy(*keys).orderBy(order, id_col)
    return df.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= size).drop("__r")


def replicas(df: DataFrame, n: int) -> DataFrame:
    """Every row once per replica 0 to n - 1."""
    return df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _drawn(points: DataFrame, want: DataFrame, keys: Sequence[str], n: int, id_col: str, seed: int) -> DataFrame:
    """The ``want`` points of each key with the least md5 of ``seed:replica:id`` in each of n replicas, ties to the smaller id.

    Hashes are even, so of a key's m points those below a threshold somewhat above want / m hold all that are wanted: only they are
    put in order. Where they are too few after all, the key's replica is done over with all of its points, so results are exact.
    """
    marked = replicas(points, n).withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replica").cast("string"), F.col(id_col).cast("string")).cast("binary")))
    sizes = points.groupBy(*keys).agg(F.count("*").alias("__m")) if keys else points.agg(F.count("*").alias("__m"))
    need = same_keys(sizes, want, keys)
    share = (F.col("want") + 6 * F.sqrt(F.col("want").cast("double")) + 16) / F.greatest(F.col("__m"), F.lit(1))
    #: A share of all hashes, as the first digits of one; "g" is above every digit.
    need = need.withColumn("__top", F.when(share >= 1, F.lit("g")).otherwise(F.lower(F.lpad(F.hex(F.floor(share * float(1 << 48)).cast("long")), 12, "0")))).drop("__m")
    both = same_keys(marked, need, keys)
    by = Window.partitionBy("replica", *keys).orderBy("__h", id_col)
    few = both.where(F.col("__h") < F.col("__top"))
    counts = few.groupBy("replica", *keys).agg(F.count("*").alias("__k"))
    wanted = same_keys(replicas(need, n), counts, ["replica", *keys], "left")
    short = wanted.where((F.coalesce("__k", F.lit(0)) < F.col("want")) & (F.col("__top") != "g")).select("replica", *keys)
    again = same_keys(both, short, ["replica", *keys], "left_semi")
    pool = same_keys(few, short, ["replica", *keys], "left_anti").unionByName(again)
    return pool.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= F.col("want")).drop("__r", "__h", "__top", "want")


def resampled(points: DataFrame, size: int, n: int, id_col: str, seed: int) -> DataFrame:
    """n samples of ``size`` without replacement: in each replica the points with the least hashes of (seed, replica, id)."""
    return _drawn(points, points.sparkSession.range(1).select(F.lit(size).alias("want")), [], n, id_col, seed)


def stratified(points: DataFrame, wanted: DataFrame, band: str, n: int, id_col: str, seed: int) -> DataFrame:
    """n samples with as many points per band as ``wanted`` (band, want), or all where a band has fewer."""
    return _drawn(points, wanted.select(band, "want"), [band], n, id_col, seed)


def tail_p(null: DataFrame, observed: Column | float, value: str, keys: Sequence[str] = (), floored: bool = False) -> DataFrame:
    """(keys, p): share of the null at or above what was observed; floored: (1 + count) / (1 + n), so never 0."""
    hit = (F.col(value) >= observed).cast("int")
    p = (F.sum(hit) + 1) / (F.count("*") + 1) if floored else F.avg(hit)
    return null.groupBy(*keys).agg(p.alias("p"))


def joint_tail_p(null: DataFrame, observed: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, p): share of draws at or above what was observed in all of ``values`` at once, and at least 1 / (draws + 1): no
    less can be claimed. ``observed`` has (keys, values), one row a key; keys without draws have p 1."""
    seen = observed.select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    both = same_keys(seen, null.select(*keys, *values, F.lit(1).alias("__draw")), keys, "left") if keys else seen.join(null.select(*values, F.lit(1).alias("__draw")), how="left")
    hit = F.lit(True)
    for v in values:
        hit = hit & (F.col(v) >= F.col(f"__{v}"))
    n, hits = F.count("__draw"), F.count_if(hit)
    p = F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(hits / n, 1 / (n + 1)))
    return both.groupBy(*keys).agg(p.alias("p"))


def flags_against_chance(tests: DataFrame, hit: Column, level: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, tests, hits, expected): how many tests were flagged, and how many would be by chance at that level."""
    return tests.groupBy(*keys).agg(F.count("*").alias("tests"), F.count_if(hit).alias("hits"), (F.lit(float(level)) * F.count("*")).alias("expected"))


def exact_summary(df: DataFrame, columns: Mapping[str, tuple[str, float]], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, names): one exact percentile of a column under each name; NULL where a key has no values. All columns are bracketed in one
    aggregation and counted in another, whatever their number."""
    wanted: dict[str, list[float]] = {}
    for value, p in columns.values():
        wanted[value] = sorted({*wanted.get(value, []), float(p)})
    found = _percentiles(df, wanted, keys)
    names = list(wanted)
    at = lambda value, p: F.max(F.when((F.col("__c") == names.index(value)) & (F.col("__p") == float(p)), F.col("__out")))
    return found.groupBy(*keys).agg(*[at(value, p).alias(name) for name, (value, p) in columns.items()])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose keys it hasn't."""
    return same_keys(old, new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def exact_percentiles(df: DataFrame, value: str, at: Sequence[float], keys: Sequence[str] = (), accuracy: int = 1000) -> DataFrame:
    """(keys, p, value): exact percentiles, linear between ranks, of groups too large for one task's memory. Keys without a value have no row; a
    missing key is a key."""
    found = _percentiles(df, {value: sorted(set(map(float, at)))}, keys, accuracy)
    return found.where("__p is not null").select(*keys, F.col("__p").alias("p"), F.col("__out").alias(value))


def _percentiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], keys: Sequence[str], accuracy: int = 1000) -> DataFrame:
    """(keys, __c, __p, __out): percentile __p of the __c-th column; a key without any values has one row without them.

    The built-in ``percentile`` keeps a group's distinct values in one buffer. Here an approximate quantile brackets
    each rank with its guaranteed error; what lies below is only counted, and only the bracket, about 4 / accuracy of
    the rows, is put in order, as counts of distinct values.
    """
    e = 2.0 / accuracy
    v = {name: F.col(f"`{name}`").cast("double") for name in wanted}
    ends = []
    for c, (name, at) in enumerate(wanted.items()):
        low, high = ([min(1.0, max(0.0, p + side)) for p in at] for side in (-e, e))
        ends += [F.count(v[name]).alias(f"__n{c}"), F.min(v[name]).alias(f"__a{c}"), F.max(v[name]).alias(f"__b{c}"), F.percentile_approx(v[name], [*low, *high], accuracy).alias(f"__q{c}")]

    def marks(c: int, at: Sequence[float]) -> Column:
        def mark(k: int, p: float) -> Column:
            low = F.get(f"__q{c}", F.lit(k)) if p > e else F.col(f"__a{c}")
            high = F.get(f"__q{c}", F.lit(len(at) + k)) if p < 1 - e else F.col(f"__b{c}")
            return F.struct(F.lit(p).alias("p"), low.alias("lo"), high.alias("hi"), (F.lit(p) * (F.col(f"__n{c}") - 1)).alias("pos"))

        return F.when(F.col(f"__n{c}") > 0, F.array(*[mark(k, p) for k, p in enumerate(at)]))

    named = [marks(c, at).alias(f"__m{c}") for c, at in enumerate(wanted.values())]
    bracketed = Scratch(df.sparkSession, "percentiles").put(df.groupBy(*keys).agg(*ends).select(*keys, *named), "brackets")
    #: A join by a few keys would sort a key's rows in one task.
    if keys and is_small(bracketed, FEW_KEYS):
        bracketed = F.broadcast(bracketed)
    spread = same_keys(df.select(*keys, *[x.alias(f"__v{c}") for c, x in enumerate(v.values())]), bracketed, keys)
    pair = lambda c: F.transform(F.when(F.col(f"__v{c}").isNotNull(), F.col(f"__m{c}")), lambda m: F.struct(F.lit(c).alias("c"), F.col(f"__v{c}").alias("v"), m.alias("m")))
    every = F.flatten(F.array(*[F.coalesce(pair(c), F.array().cast("array<struct<c: int, v: double, m: struct<p: double, lo: double, hi: double, pos: double>>>")) for c in range(len(v))]))
    each = spread.select(*keys, F.explode_outer(every).alias("x")).select(*keys, F.col("x.c").alias("__c"), F.col("x.m.p").alias("__p"), F.col("x.m.lo").alias("__lo"), F.col("x.m.hi").alias("__hi"), F.col("x.m.pos").alias("__pos"), F.col("x.v").alias("__v"))
    group = [*keys, "__c", "__p", "__pos"]
    #: Below the bracket one row with the largest value, above it one with the smallest: in small groups a rank can lie there.
    side = F.when(F.col("__v") < F.col("__lo"), F.lit(float("-inf"))).when(F.col("__v") <= F.col("__hi"), F.col("__v")).otherwise(F.lit(float("inf")))
    counted = each.groupBy(*group, side.alias("__s")).agg(F.count("*").alias("__n"), F.min("__v").alias("__l"), F.max("__v").alias("__h"))
    upto = F.sum("__n").over(Window.partitionBy(*group).orderBy("__s").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("__to", upto).withColumn("__v", F.when(F.col("__s") == float("-inf"), F.col("__h")).otherwise(F.col("__l")))
    first = F.min_by("__v", F.when(F.col("__to") > F.floor("__pos"), F.col("__to")))
    second = F.min_by("__v", F.when(F.col("__to") > F.ceil("__pos"), F.col("__to")))
    out = ranked.groupBy(*group).agg(first.alias("__x"), second.alias("__y"))
    return out.select(*keys, "__c", "__p", (F.col("__x") + (F.col("__y") - F.col("__x")) * (F.col("__pos") - F.floor("__pos"))).alias("__out"))
