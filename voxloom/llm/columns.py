"""Column helpers for array work inside one row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(columns: Sequence[str]) -> Column:
    """Columns of any names in one struct, so that none can clash with a column that is added."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])


def unpacked(name: str, columns: Sequence[str]) -> list[Column]:
    """The columns of ``packed``."""
    return [F.col(f"{name}.`{c}`").alias(c) for c in columns]


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of text are in the class ``[chars]``: a count of matches, several times as fast as translate."""
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def words_of(text: Column) -> Column:
    """Runs of other than ASCII white space, in order."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>"))


def prefix_sums(values: Column, chunk: int = 128) -> Column:
    """Sums of all values before each, for an array of long. Arrays grow within chunks only, so long ones take linear time."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")

    def fold(part: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), step)["out"]

    def of(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(whole) - 1, F.lit(0)), F.lit(chunk))
        return let(F.transform(starts, lambda c: F.slice(whole, c + 1, chunk)), lambda parts: let(fold(F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x)), zero), lambda offsets: F.flatten(F.transform(parts, lambda p, i: fold(p, F.get(offsets, i))))))

    return let(values, of)
