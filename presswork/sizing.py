"""Size checks: what may be inlined into a plan, and what needs spreading out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

#: Parameter tables up to this many rows are folded into the plan as literals.
INLINE_ROWS = 5_000
#: Scans estimated below this many bytes may sit in a single file split.
SMALL_SCAN_BYTES = 512 * 1024 * 1024


def inline_rows(table: DataFrame | Iterable, limit: int = INLINE_ROWS) -> list[tuple] | None:
    """Rows of a parameter table as plain tuples, or ``None`` if it is too large to inline.

    At most ``limit + 1`` rows ever reach the driver, so a table of any size may be
    passed; callers must have a join for the ``None`` case.
    """
    if isinstance(table, DataFrame):
        head = table.limit(limit + 1).collect()
        return None if len(head) > limit else [tuple(r) for r in head]
    rows = [r if isinstance(r, tuple) else (r,) for r in table]
    return None if len(rows) > limit else rows


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's own size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small scan over the available cores.

    A table of a few megabytes is often one row group, hence one task.  Large tables
    already arrive in enough splits and are returned untouched, without a shuffle.
    """
    if estimated_bytes(df) >= SMALL_SCAN_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
