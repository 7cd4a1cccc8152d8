"""Consecutive numbers within groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import let

#: Rows one range should hold, the most ranges used, and sampled rows per range.
ROWS_PER_RANGE = 500_000
MAX_RANGES = 4_096
SAMPLES_PER_RANGE = 20


def range_number(keys: list[str], bounds: list[tuple]) -> Column:
    """Number of boundaries at or below the row's key tuple, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, b)]) for b in bounds])
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def search(here: Column) -> Column:
        def halve(span: Column, _: Column) -> Column:
            mid = F.floor((span.lo + span.hi) / 2).cast("int")
            above = here >= F.get(table, mid)
            open_ = span.lo < span.hi
            return F.struct(
                F.when(open_ & above, mid + 1).otherwise(span.lo).alias("lo"),
                F.when(open_ & ~above, mid).otherwise(span.hi).alias("hi"),
            )

        start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
        return F.aggregate(steps, start, halve, lambda span: span.lo)

    return let(F.struct(*keys), search)


def range_bounds(df: DataFrame, keys: list[str], rows: int, ranges: int) -> list[tuple]:
    """Key tuples that cut ``df`` into about equal ranges, from a sample of bounded size."""
    target = ranges * SAMPLES_PER_RANGE
    sample = df.select(*keys).na.drop().sample(min(1.0, target / rows), seed=17).limit(2 * target)
    points = sorted({tuple(r) for r in sample.collect()})
    step = max(1, len(points) // ranges)
    return points[step::step]


def number_within(df: DataFrame, group: str, order: list[str], out: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``out``: 1, 2, 3 ... within ``group`` by ``order`` (ascending, a total order).

    A plain window would put a whole group into one task.  Here (group, order) is cut into
    value ranges of bounded size, rows are numbered within (group, range), and the number
    of rows in the group's earlier ranges is added.  The sample that places the boundaries
    affects balance only; results are exact for any boundaries.
    """
    keys = [group, *order]
    rows = df.count()
    ranges = min(MAX_RANGES, math.ceil(rows / rows_per_range))
    if ranges <= 1:
        number = F.row_number().over(W.partitionBy(group).orderBy(*order))
        return df.withColumn(out, number.cast("long"))
    ranged = df.withColumn("_range", range_number(keys, range_bounds(df, keys, rows, ranges)))
    before = (
        ranged.groupBy(group, "_range")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(
                W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
            ),
        )
        .select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    local = F.row_number().over(W.partitionBy(group, "_range").orderBy(*order))
    matched = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r"))
    return ranged.withColumn("_local", local).join(before, matched, "left").select(
        *df.columns, (F.col("_local") + F.col("_before")).cast("long").alias(out)
    )
