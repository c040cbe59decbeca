"""Places of pattern matches in texts, as column expressions. Offsets are code points, ends exclusive.

All work is linear in the text: Spark gives matches and the text between them, and the offsets are
their running lengths, summed in blocks so that no accumulator grows with the number of matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Column:
    """Sum of the entries before each entry."""
    return F.aggregate(
        lengths,
        F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all")),
        lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all")),
        lambda a: a["all"])


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def running(lengths: Column) -> Column:
    """Sum of the entries before each entry of an array of longs."""
    def over(blocks: Column) -> Column:
        return let(_running(F.transform(blocks, _sum)), lambda before: F.flatten(F.transform(
            blocks, lambda block, i: F.transform(_running(block), lambda x: x + F.get(before, i)))))
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    return F.when(n > 0, let(blocks, over)).otherwise(F.array().cast("array<bigint>"))


PLACES = "array<struct<start:bigint,end:bigint,value:string>>"


def places(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a Java pattern that never matches the empty string."""
    p = F.lit(pattern)

    def found(parts: Column) -> Column:
        lengths = F.zip_with(parts["gaps"], parts["hits"], lambda g, h: F.array(
            F.length(g).cast("long"), F.coalesce(F.length(h), F.lit(0)).cast("long")))
        return let(running(F.flatten(lengths)), lambda at: F.transform(parts["hits"], lambda h, i: F.struct(
            F.get(at, 2 * i + 1).alias("start"), (F.get(at, 2 * i + 1) + F.length(h)).alias("end"), h.alias("value"))))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, p, F.lit(0)).alias("hits"))
    return F.when(F.rlike(text, p), let(parts, found)).otherwise(F.array().cast(PLACES))


def labelled(kind: str, found: Column) -> Column:
    return F.transform(found, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def rewrite(text: Column, found: Column) -> Column:
    """``text`` with every span (start, end, put) of ``found`` replaced; overlapping ones become one, by the first."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["put"].alias("put"))))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        inside = s["start"] < a["at"]
        between = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"),
                        F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(between, s["put"]))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(ordered, first, step, lambda a: F.concat(
        F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))).otherwise(text)
