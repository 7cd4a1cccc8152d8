"""Totals per sector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def sector_stats(df: DataFrame, sectors: DataFrame | None = None, before: str = "content", after: str | None = None) -> DataFrame:
    """Articles, thin articles and sentences per sector, before and after backfill.

    With ``sectors`` given, sectors without articles are listed with zero.
    """
    n_before = X.count_sentences(before)
    measured = df.select(
        "sector", n_before.alias("_b"), (X.count_sentences(after) if after else n_before).alias("_a")
    )
    stats = measured.groupBy("sector").agg(
        F.count("*").alias("articles"),
        F.count_if(F.col("_b") < 6).alias("thin_articles"),
        F.sum("_b").alias("sentences_before"),
        F.sum("_a").alias("sentences_after"),
    )
    if sectors is None:
        return stats
    return sectors.select("sector").join(stats, "sector", "left").na.fill(0)


def empty_sectors(df: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sectors for which nothing was found."""
    return sectors.select("sector").join(df.select("sector").distinct(), "sector", "left_anti")
