"""From landed articles to a one-up digest deck (the app's path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import text as X
from ..functions.core import text_or_empty
from ..operators import cards, deck, filters, selection
from ..schema import COLLECTION_ORDER
from ..session import written


def needs_page(df: DataFrame) -> Column:
    """Articles worth a look at their page: stubs, short NewsAPI texts, few sentences."""
    n = F.length(text_or_empty("content"))
    few = X.count_sentences("content") < 6
    if "provider" in df.columns:
        return (n < 100) | ((F.col("provider") == "newsapi") & (n < 500)) | few
    return (n < 100) | few


#: What tells landed articles apart.
IDENTITY = ["url", "provider_idx", "provider_rank"]


def select_articles(
    articles: DataFrame,
    n: int = params.DEFAULT_ARTICLES_PER_SECTOR,
    queries: DataFrame | list | None = None,
    lang: str | None = "en",
    as_of: Column | None = None,
) -> DataFrame:
    """Searched, filtered, de-duplicated articles, the first ``n`` per sector.

    With searches, articles rank by search, provider, score and date; without, by the
    order in which they were collected.

    Only identities and sort keys are shuffled for the ranking.  The winners, at most ``n``
    per sector, are written out, and full rows are fetched by joining them back; the
    written table's size decides whether that join broadcasts.
    """
    rows = filters.require_fields(articles)
    if lang is not None:
        rows = filters.language(rows, lang)
    if as_of is not None:
        rows = filters.lookback(rows, as_of)
    if queries is None:
        keys, order, extra = ["sector", "query_idx", *IDENTITY], list(COLLECTION_ORDER), []
        ranked = rows.select(*keys)
    else:
        keys, extra = list(IDENTITY), ["sector", "query_idx"]
        order = [
            "query_idx", "provider_idx", F.col("score").desc(),
            F.col("published_ts").desc_nulls_last(), "provider_rank",
        ]
        searched = rows.select(*keys, *extra, "title", "description", "content", "published_ts")
        ranked = selection.search_articles(searched, queries).select(*keys, *extra, "score", "published_ts")
        rows = rows.drop(*extra)
    winners = selection.top_per_sector(selection.dedup_by_url(ranked, order), n, order)
    winners = written(winners.select(*keys, *extra, "deck_pos"), "winners")
    same = F.lit(True)
    for k in keys:  # identities may have gaps
        same = same & rows[k].eqNullSafe(F.col(f"_{k}"))
    fetched = rows.join(winners.withColumnsRenamed({k: f"_{k}" for k in keys}), same).drop(*[f"_{k}" for k in keys])
    # an article landed twice under one identity comes back twice
    fetched = selection.first_per(fetched, ["sector", "deck_pos"], ["published_ts"])
    # written as well, so the steps after it do not scan the landed articles again
    return written(fetched, "chosen")


def build_digest(
    articles: DataFrame,
    pages: DataFrame | None = None,
    n: int = params.DEFAULT_ARTICLES_PER_SECTOR,
    queries: DataFrame | list | None = None,
    lang: str | None = "en",
    as_of: Column | None = None,
    phrases=params.BOILERPLATE,
) -> DataFrame:
    """Deck rows with their place on the slides, rejected articles marked.

    Ranking needs no text beyond what is searched; only the winners, at most ``n`` per
    sector, are backfilled and formatted.
    """
    chosen = select_articles(articles, n, queries, lang, as_of)
    if pages is not None:
        chosen = selection.backfill_content(chosen, pages, needs_page(chosen))
    rows = cards.with_display_content(cards.deck_articles(chosen), phrases)
    return deck.deck_layout(rows, ["deck_pos"], per_slide=1, number="deck_pos")
