"""Quality rules: base counts of every text, and a learned decision list over them, with DataFrame functions only.

The list is learned by sequential covering. Each rule grows by the condition ``statistic > t`` or ``<= t`` with the most
information gain, from one aggregation per condition over all labelled rows; it is pruned to the prefix that does best on
rows kept aside, and taken only if nearly all it covers there is of the rejected class. The list is then an ordered Spark
conditional expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.scratch import Scratch

from .columns import SPACES, count_chars, let, packed, unpacked, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Thresholds to a statistic, conditions to a rule and rules to a list, at most.
BINS, MAX_CONDITIONS, MAX_RULES = 32, 4, 8
#: What of the kept-aside rows that a rule covers has to be of the rejected class, and rows it has to cover.
MIN_PRECISION, MIN_COVER = 0.95, 5

Condition = tuple[str, str, float]
Rule = list[Condition]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words, given by their hashes, lie in windows of ``width`` that are in the array twice or more, the first included."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
            again = F.filter(p, lambda x, k: same(x, k + 1) | F.when(k > 0, same(x, k - 1)).otherwise(False))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def total(at: Column) -> Column:
            each = F.transform(at, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - x, F.lit(width))).cast("long"))
            return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(ordered, starts), total))

    return let(words, lambda w: F.when(F.size(w) <= width, F.lit(0).cast("long")).otherwise(let(F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])), covered)))


def base_counts(text: Column) -> dict[str, Column]:
    """The counts of the contract, and the others that statistics are made of. Null texts count as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    lines = let(F.filter(F.split(t, "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    hashes = F.transform(words_of(t), lambda w: F.xxhash64(w))
    words = let(hashes, lambda h: F.struct(F.size(h).alias("n"), F.size(F.array_distinct(h)).alias("distinct"), repeated_words(h).alias("repeat")))
    return {
        "words": words,
        "lines": lines,
        "word_chars": F.length(t).cast("long") - count_chars(t, r"\x20\x09-\x0D"),
        "n_symbols": count_chars(t, SYMBOLS),
        "pipes": count_chars(t, "|"),
        "marks": count_chars(t, "!?"),
        "stops": count_chars(t, ".,;:"),
        "digits": count_chars(t, "0-9"),
        "upper": count_chars(t, r"\p{Lu}"),
    }


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, s[, row]) per row; s is a struct of ratios, row one of all columns."""
    own = [packed(docs.columns).alias("row")] if whole else []
    flat = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *own, *[c.alias(n) for n, c in base_counts(F.col(f"`{text_col}`")).items()])
    flat = flat.select("*", F.col("words.n").cast("long").alias("n_words"), F.col("lines.dup").cast("long").alias("n_dup_lines"), F.col("words.repeat").alias("n_repeat_words"))
    per = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    ratios = {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"),
        "pipes": per("pipes", "n_words"),
        "marks": per("marks", "n_words"),
        "stops": per("stops", "n_words"),
        "digits": per("digits", "word_chars"),
        "upper": per("upper", "word_chars"),
        "distinct": per("words.distinct", "n_words"),
        "repeats": per("n_repeat_words", "n_words"),
        "dup_lines": per("n_dup_lines", "lines.n"),
        "line_words": per("n_words", "lines.n"),
    }
    return flat.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.struct(*[c.alias(n) for n, c in ratios.items()]).alias("s"), *(["row"] if whole else []))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def _holds(bins: Column, names: Sequence[str], cuts: dict[str, list[float]], rule: Rule) -> Column:
    tests = [(F.get(bins, F.lit(names.index(f))) > cuts[f].index(t)) if op == ">" else (F.get(bins, F.lit(names.index(f))) <= cuts[f].index(t)) for f, op, t in rule]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _bin(value: Column, cuts: Sequence[float]) -> Column:
    """How many cuts are below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in cuts]), lambda t: value > t)) if cuts else F.lit(0)


def learn_decision_list(train: DataFrame, names: Sequence[str], max_rules: int = MAX_RULES, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Rules that cover rows with ``reject`` = 1, in order. ``train`` has doc_id, reject (0 or 1) and the struct s of statistics.

    Every labelled row counts. What comes to the driver is a histogram of at most statistics x 2 (bins + 1) cells for each
    condition. No rows, or rows of one class only, give an empty list.
    """
    scratch = Scratch(train.sparkSession, "rules")
    marks = [k / BINS for k in range(BINS + 1)]
    rejected = F.col("reject") == 1
    quantiles = lambda n, of, tag: F.percentile_approx(F.when(of, F.col(f"s.{n}")), marks, 10_000).alias(f"{tag}{n}")
    found = train.agg(*[quantiles(n, of, tag) for n in names for of, tag in ((F.lit(True), "a"), (rejected, "r"))]).first()
    #: Quantiles of all rows and of the rejected ones, so that a rare kind of these has thresholds too. A threshold is halfway
    #: between neighbours: it keeps its distance to the rows on both sides.
    steps = {n: sorted({*(found[f"a{n}"] or []), *(found[f"r{n}"] or [])}) for n in names}
    cuts = {n: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for n, v in steps.items()}
    places = [_bin(F.col(f"s.{n}"), cuts[n]) for n in names]
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(3)) == 0
    rows = scratch.put(train.select(F.array(*places).alias("bins"), aside.alias("aside"), F.col("reject").cast("long").alias("reject")), "rows")

    def cells(mask: Column) -> tuple[dict, list[int]]:
        """Rejected and other rows by (aside, statistic, bin), and their sums (grow p, grow n, aside p, aside n)."""
        flat = rows.where(mask).select("aside", "reject", F.posexplode("bins").alias("f", "bin"))
        got = {(r["aside"], r["f"], r["bin"]): (r["p"], r["n"] - r["p"]) for r in flat.groupBy("aside", "f", "bin").agg(F.sum("reject").alias("p"), F.count("*").alias("n")).collect()}
        sums = [sum(v[x] for (a, f, _), v in got.items() if a == side and f == 0) for side in (False, True) for x in (0, 1)]
        return got, sums

    rules: list[Rule] = []
    open_rows: Column = F.lit(True)
    while len(rules) < max_rules:
        rule: Rule = []
        table, (p, n, *held) = cells(open_rows)
        prefixes: list[tuple[int, int, int, int]] = []
        while p and n and len(rule) < MAX_CONDITIONS:
            best = None
            for f, name in enumerate(names):
                for side in ("<=", ">"):
                    order = range(len(cuts[name]))
                    sums = [0, 0, 0, 0]
                    for j in order if side == "<=" else reversed(order):
                        b = j if side == "<=" else j + 1
                        for k, part in enumerate((False, True)):
                            got = table.get((part, f, b), (0, 0))
                            sums[2 * k] += got[0]
                            sums[2 * k + 1] += got[1]
                        if sums[0] >= MIN_COVER and (gain := sums[0] * (math.log2(sums[0] / (sums[0] + sums[1])) - math.log2(p / (p + n)))) > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, (name, side, cuts[name][j]), tuple(sums))
            if best is None:
                break
            rule.append(best[1])
            prefixes.append(best[2])
            p, n = best[2][:2]
            if p and n and len(rule) < MAX_CONDITIONS:
                table, (p, n, *held) = cells(open_rows & _holds(F.col("bins"), names, cuts, rule))
        if not prefixes:
            break
        worth = lambda x: (x[2] - x[3]) / (x[2] + x[3]) if x[2] + x[3] else (x[0] - x[1]) / (x[0] + x[1]) - 1e-6
        k = max(range(len(prefixes)), key=lambda i: (round(worth(prefixes[i]), 9), -i))
        p, n, hp, hn = prefixes[k]
        if p < min_precision * (p + n) or hp < min_precision * (hp + hn):
            break
        rules.append(rule[: k + 1])
        open_rows = open_rows & ~_holds(F.col("bins"), names, cuts, rules[-1])
    return rules


def verdict(rules: Sequence[Rule], statistic: Callable[[str], Column]) -> Column:
    """True unless a rule holds: an ordered conditional expression, one branch to a rule."""
    out = None
    for rule in rules:
        test = reduce(lambda a, b: a & b, [(statistic(f) > t) if op == ">" else (statistic(f) <= t) for f, op, t in rule])
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, keep_label: int) -> tuple[DataFrame, list[Rule]]:
    """``document_statistics``, written, and the rules that the labelled rows teach."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.put(document_statistics(docs, id_col, text_col), "stats")
    marked = labels.where(F.col("quality").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    train = stats.join(marked, "doc_id").where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("doc_id", "s", (F.col("quality") != keep_label).cast("int").alias("reject"))
    return stats, learn_decision_list(scratch.put(train, "train"), stats.schema["s"].dataType.names)


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_label: int = 1) -> DataFrame:
    """A row per row of ``docs``: its counts, base_failed and kept (false if base_failed, or if a learned rule rejects it).

    ``labels`` has the id and quality; rows without a quality are passed over, of repeated ids the least counts. Null and empty
    texts have no words and fail. Rows that repeat an id or a text are judged each. Null ids are kept as they are.
    Other columns are ignored. An empty table gives an empty result; without labels only base_failed decides.
    Words and windows are compared by 64-bit hashes.
    """
    stats, rules = _learned(docs, labels, id_col, text_col, keep_label)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    kept = ~failed & verdict(rules, lambda f: F.col(f"s.{f}"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_label: int = 1) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, with their columns. Each row is judged by its own text: rows that share an id, or have none,
    stay or go one by one. Statistics are computed twice, to learn from and to judge by, so that no text is copied or shuffled."""
    _, rules = _learned(docs, labels, id_col, text_col, keep_label)
    stays = lambda x: ~base_failed(x["n_words"], x["n_repeat_words"]) & verdict(rules, lambda f: x["s"][f])
    #: A filter on an array of one row: a condition would be computed in the scan once for every use of a statistic.
    judged = document_statistics(docs, id_col, text_col, True).select(F.explode(F.filter(F.array(F.struct("n_words", "n_repeat_words", "s", "row")), stays)).alias("x"))
    return judged.select("x.row").select(*unpacked("row", docs.columns))
