"""Running values within groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a group that one task goes through.
BLOCK = 100_000


def running(df: DataFrame, group: list[str], no: str, value: str, out: str, combine: Callable[[str], Column] = F.sum, block: int = BLOCK) -> DataFrame:
    """Add ``out``: ``combine`` of ``value`` over the group's rows before this one.

    ``no`` counts 1, 2, 3 ... within the group.  Rows are gone through in blocks of
    consecutive numbers, and what the blocks before have is added; only one row per block
    meets within its group.  ``combine`` is F.sum, F.min or F.max; null before the first value.
    """
    blocked = df.withColumn("_block", F.floor((F.col(no) - 1) / block))
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocked.groupBy(*group, "_block").agg(combine(value).alias("_all"))
    blocks = blocks.select(
        *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_block").alias("_b"), combine("_all").over(before).alias("_earlier")
    ).filter("_earlier is not null")
    here = W.partitionBy(*group, "_block").orderBy(no).rowsBetween(W.unboundedPreceding, -1)
    rows = blocked.withColumn("_here", combine(value).over(here))
    same = F.col("_block") == F.col("_b")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    # of the block's part and the earlier one either may be missing
    both = {F.sum: F.col("_earlier") + F.col("_here"), F.max: F.greatest("_earlier", "_here"), F.min: F.least("_earlier", "_here")}[combine]
    return rows.join(blocks, same, "left").select(*df.columns, F.coalesce(both, "_here", "_earlier").alias(out))
