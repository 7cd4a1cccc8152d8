"""The preview of a digest: cards, sector headings, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cards, filters, stats
from ..session import written


def preview(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Preview cards with their sector's icon, description and article count."""
    rows = filters.valid_rows(df)
    shown = cards.with_sector_meta(cards.preview_cards(rows), meta)
    totals = written(stats.sector_stats(rows).select("sector", "articles"), "totals")
    return shown.join(totals, "sector").withColumn(
        "heading", F.concat(F.col("sector"), F.lit(" Sector ("), F.col("articles").cast("string"), F.lit(" articles)"))
    )
