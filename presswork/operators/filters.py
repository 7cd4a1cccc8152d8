"""Row filters and content flags.  All are narrow and leave pushdown to the optimizer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import text as X
from ..functions.core import text_or_empty
from .numbering import number_within


def require_fields(df: DataFrame, cols: Iterable[str] = ("url",)) -> DataFrame:
    """Rows in which every named text is present and not empty."""
    for c in cols:
        df = df.filter(F.col(c).isNotNull() & (F.col(c) != ""))
    return df


def lookback(df: DataFrame, as_of: Column, days: int = params.LOOKBACK_DAYS, ts: str = "published_ts") -> DataFrame:
    """Published between ``days`` before ``as_of`` and ``as_of``, whole days at both ends."""
    first = F.to_timestamp(F.date_sub(F.to_date(as_of), days))
    end = F.to_timestamp(F.date_add(F.to_date(as_of), 1))
    return df.filter((F.col(ts) >= first) & (F.col(ts) < end))


def language(df: DataFrame, lang: str = "en", col: str = "lang") -> DataFrame:
    return df.filter(F.col(col) == lang)


def content_flags(df: DataFrame) -> DataFrame:
    """Which refetch rules an article's text triggers."""
    n = F.length(text_or_empty("content"))
    return df.withColumns(
        {
            "needs_refetch": n < 100,
            "needs_second_extractor": n < 200,
            "needs_full_text": n < 500,
            "needs_more_sentences": X.count_sentences("content") < 6,
        }
    )


def drop_boilerplate(df: DataFrame, phrases: Iterable[str] = params.BOILERPLATE, col: str = "sentences") -> DataFrame:
    """Remove sentences holding any of the phrases from an array column."""
    return df.withColumn(col, X.drop_boilerplate(F.col(col), phrases))


def content_gate(
    df: DataFrame,
    minimum: int = params.MIN_CARD_SENTENCES,
    phrases: Iterable[str] = params.BOILERPLATE,
    summary: str = "summary",
    content: str = "content",
) -> DataFrame:
    """Add ``kept_sentences``; keep only articles that have enough of them."""
    kept = X.display_sentences(summary, content, phrases, minimum)
    return df.withColumn("kept_sentences", kept).filter(F.col("kept_sentences").isNotNull())


def valid_rows(df: DataFrame) -> DataFrame:
    """Drop rows without any content, such as the placeholder of an empty snapshot."""
    fields = [c for c in ("url", "title", "description", "content") if c in df.columns]
    return df.filter(F.coalesce(*[F.col(c) for c in fields]).isNotNull())


def order_articles(df: DataFrame, by: str = "relevance", score: str = "score") -> DataFrame:
    """Global order by relevance or by recency, ties settled by date and link."""
    recency = [F.col("published_ts").desc_nulls_last(), F.col("url").asc()]
    if by == "relevance":
        return df.orderBy(F.col(score).desc_nulls_last(), *recency)
    if by == "recency":
        return df.orderBy(*recency)
    raise ValueError(f"unknown order: {by}")


def rank_articles(df: DataFrame, by: str = "relevance", score: str = "score", out: str = "rank") -> DataFrame:
    """All rows with their place 1, 2, 3 ... in ``order_articles``, numbered by ranges."""
    if by not in ("relevance", "recency"):
        raise ValueError(f"unknown order: {by}")
    date = F.unix_micros(F.col("published_ts").cast("timestamp"))
    keys = {"_no_date": date.isNull(), "_date": -date}
    if by == "relevance":
        keys = {"_no_score": F.col(score).isNull(), "_score": -F.col(score)} | keys
    # ranges are bounded by values, so missing ones have to be some value
    keys = {k: c if k.startswith("_no") else F.coalesce(c, F.lit(0)) for k, c in keys.items()}
    keys |= {"_no_url": F.col("url").isNotNull(), "_url": F.coalesce("url", F.lit(""))}
    rows = df.withColumns({"_all": F.lit(0)} | keys)
    return number_within(rows, "_all", list(keys), out).select(*df.columns, out)
