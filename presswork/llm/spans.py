"""Pattern matches with their positions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions.core import let

#: Elements summed up in one step of a running sum.
STRIDE = 128
#: Characters of context kept on either side.
LEFT, RIGHT = 24, 12
SPAN = "array<struct<start:int,end:int,text:string,left:string,right:string>>"


def running_sum(sizes: Column) -> Column:
    """Sums of all elements before each one; the work is linear but for one add per stride."""

    def before(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all"))
        return F.aggregate(values, start, step, lambda acc: acc["all"])

    strides = F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), ((F.size(sizes) - 1) / STRIDE).cast("int"))
    )
    parts = F.transform(strides, lambda k: F.slice(sizes, k * STRIDE + 1, STRIDE))
    return let(
        parts,
        lambda p: let(
            before(F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b))),
            lambda offsets: F.flatten(F.transform(p, lambda x, i: F.transform(before(x), lambda s: s + F.get(offsets, i)))),
        ),
    )


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern: array of (start, end, text, left, right).

    Positions count code points from 0, the end is exclusive; ``left`` and ``right`` are what
    stands before and after, up to the neighbouring matches.  The pieces between matches are
    only looked for in texts that have a match.
    """

    def located(found: Column) -> Column:
        def placed(pieces: Column) -> Column:
            n = F.size(found)
            sizes = F.zip_with(F.slice(pieces, 1, n), found, lambda gap, m: F.length(gap) + F.length(m))
            context = F.zip_with(
                F.slice(pieces, 1, n), F.slice(pieces, 2, n),
                lambda a, b: F.struct(F.substring(a, -LEFT, LEFT).alias("left"), F.substring(b, 1, RIGHT).alias("right")),
            )
            ends = let(sizes, lambda s: F.zip_with(running_sum(s), s, lambda before, size: before + size))
            return F.zip_with(
                F.zip_with(ends, found, lambda end, m: F.struct(end.alias("end"), m.alias("text"))), context,
                lambda m, c: F.struct(
                    (m["end"] - F.length(m["text"])).cast("int").alias("start"), m["end"].cast("int").alias("end"),
                    m["text"].alias("text"), c["left"].alias("left"), c["right"].alias("right"),
                ),
            )

        return let(F.split(text, pattern, -1), placed)

    empty = F.array().cast(SPAN)
    return F.coalesce(
        let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, empty).otherwise(located(found))), empty
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
