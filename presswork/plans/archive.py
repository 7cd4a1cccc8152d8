"""Landed responses, filings and pages brought into one archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import text_or_empty
from ..operators import selection
from ..sources import archive, pages as page_source, providers


def archive_rows(
    responses: dict[str, DataFrame],
    now: Column,
    filings: DataFrame | None = None,
    pages: DataFrame | None = None,
    request_keys: tuple[str, ...] = ("request_id",),
    limit: int | None = None,
    filing_limit: int | None = None,
) -> DataFrame:
    """Articles of all providers in one shape, thin ones filled from their pages.

    ``responses`` maps provider to raw responses (``request_keys`` and ``body``); filings
    have ``request_keys``, ``provider_rank`` and the feed fields.  What has landed is kept
    whole unless a limit per request is given.
    """
    normalize = {"newsapi": providers.normalize_newsapi, "gnews": providers.normalize_gnews}
    parts = []
    for name, df in responses.items():
        rows = normalize[name](providers.read_provider_responses(df, name), now)
        if limit is not None:
            rows = selection.limit_per(rows, limit, request_keys, ["provider_rank"])
        if pages is not None:
            thin = F.length(text_or_empty("content")) < 500
            rows = selection.backfill_content(rows, pages, thin)
        parts.append(rows.withColumn("provider", F.lit(name)))
    if filings is not None:
        if filing_limit is not None:
            filings = selection.limit_per(filings, filing_limit, request_keys, ["provider_rank"])
        parts.append(providers.normalize_filings(filings).withColumn("provider", F.lit("sec_edgar")))
    if pages is not None:
        parts.append(page_source.normalize_pages(pages).withColumn("provider", F.lit("web_scraper")))
    return selection.union_sources(*parts)


def archive_sources(rows: DataFrame, path: str, now: Column) -> None:
    """Append the rows of each provider under its own stamp."""
    archive.write_archive(rows.withColumnRenamed("provider", "_by"), F.col("_by"), path, now, drop=["_by"])
