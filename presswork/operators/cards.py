"""Card and preview rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import fields as C
from ..functions import text as X
from ..functions.core import text_or_empty


def preview_cards(df: DataFrame) -> DataFrame:
    """What the preview shows of each article."""
    keep = [c for c in ("sector", "deck_pos", "url", "source_name") if c in df.columns]
    has_text = (text_or_empty("content") != "") | (text_or_empty("url") != "")
    return df.select(
        *keep,
        C.preview_title("title").alias("preview_title"),
        C.preview_description("description").alias("preview_description"),
        C.preview_date("published_raw").alias("preview_date"),
        has_text.alias("has_content"),
    )


def deck_articles(df: DataFrame) -> DataFrame:
    """Articles in the shape a deck takes."""
    extra = [c for c in ("deck_pos", *("query_idx", "provider_idx", "provider_rank")) if c in df.columns]
    # fixed values: texts in place of missing ones
    return df.select(
        "sector",
        "url",
        *extra,
        F.coalesce("title", F.lit("No Title")).alias("title"),
        F.coalesce("source_name", F.lit("Unknown Source")).alias("source"),
        F.left(text_or_empty("published_raw"), F.lit(10)).alias("date"),
        F.coalesce("description", F.lit("No summary available.")).alias("summary"),
        F.array("sector").alias("categories"),
        text_or_empty("content").alias("content"),
    )


def with_display_content(df: DataFrame, phrases: Iterable[str] = params.BOILERPLATE) -> DataFrame:
    """Add the card text and whether the article may be shown at all."""
    df = df.withColumn("display_content", X.display_content("summary", "content", phrases))
    return df.withColumn("accepted", F.col("display_content").isNotNull())


def card_rows(df: DataFrame, phrases: Iterable[str] = params.BOILERPLATE) -> DataFrame:
    """Deck articles with every text a card carries."""
    cols = {
        "source_line": C.source_line("source", "date"),
        "tag": C.tag("categories"),
        "tags": C.tags("categories"),
        "summary_15": X.enhance_summary("summary", "content"),
    }
    if "key_points" in df.columns:
        cols["card_points"] = F.slice("key_points", 1, 5)
    return with_display_content(df, phrases).withColumns(cols)


def with_sector_meta(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Add icon and description of the sector; ``meta`` has (sector, icon, description)."""
    renamed = meta.select(
        "sector", F.col("icon").alias("_icon"), F.col("description").alias("_blurb")
    )
    return (
        df.join(renamed, "sector", "left")
        .withColumn("sector_icon", F.coalesce("_icon", F.lit(params.DEFAULT_ICON)))
        .withColumn(
            "sector_description",
            F.coalesce("_blurb", F.concat(F.lit(params.DEFAULT_BLURB_PREFIX), F.col("sector"))),
        )
        .drop("_icon", "_blurb")
    )


def default_sector_meta(spark) -> DataFrame:
    # literals, so that the optimizer knows how small the table is
    rows = [
        F.struct(F.lit(s).alias("sector"), F.lit(icon).alias("icon"), F.lit(blurb).alias("description"))
        for s, (icon, blurb) in params.SECTOR_META.items()
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def default_sector_queries(spark) -> DataFrame:
    return spark.createDataFrame(
        list(params.SECTOR_QUERIES.items()), "sector string, queries array<string>"
    )


def default_sectors(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(params.SECTORS)), "ord int, sector string")
