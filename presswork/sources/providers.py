"""Landed provider responses and their article dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.core import strip, text_or_empty
from ..functions.fields import source_name

PROVIDERS = {"newsapi": schema.NEWSAPI_RESPONSE, "gnews": schema.GNEWS_RESPONSE}


def read_provider_responses(df: DataFrame, provider: str, body: str = "body") -> DataFrame:
    """Articles of raw responses, one row each; error responses give none.

    Keeps the other columns of ``df`` and adds ``provider_rank``, the article's JSON text
    fields, and ``raw`` (the article's own JSON), from which absent keys can be told from nulls.
    """
    rest = [c for c in df.columns if c != body]
    if provider == "newsapi":
        ok = ~F.get_json_object(body, "$.status").eqNullSafe("error")
    else:
        # the key alone marks an error, whatever its value
        keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
        ok = ~F.array_contains(keys, "errors")
    texts = F.from_json(body, "articles array<string>").getField("articles")
    rows = df.filter(ok).select(*rest, F.posexplode(texts).alias("provider_rank", "raw"))
    article = PROVIDERS[provider]["articles"].dataType.elementType
    return rows.select(
        *rest,
        F.col("provider_rank").cast("long").alias("provider_rank"),
        "raw",
        F.from_json("raw", article).alias("a"),
    ).select(*rest, "provider_rank", "raw", "a.*")


def _absent(key: str) -> Column:
    """True when the article's JSON has no such key at all."""
    keys = F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>"))
    return ~F.array_contains(keys, key)


def _keep(df: DataFrame, made: list[str]) -> list[str]:
    used = set(made) | {"source", "urlToImage", "publishedAt", "image", "raw"}
    return [c for c in df.columns if c not in used]


def normalize_newsapi(df: DataFrame, now: Column) -> DataFrame:
    """Defaults apply to absent keys only; an explicit null stays null."""
    made = ["url", "title", "description", "content", "author"]
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")
    return df.select(
        *_keep(df, made),
        *made,
        source_name("source").alias("source_name"),
        F.when(_absent("urlToImage"), F.lit("")).otherwise(F.col("urlToImage")).alias("image_url"),
        F.when(_absent("publishedAt"), stamp).otherwise(F.col("publishedAt")).alias("published_raw"),
    )


def normalize_gnews(df: DataFrame, now: Column) -> DataFrame:
    """Strip every text and keep articles that have both a title and a link."""
    made = ["url", "title", "description", "content"]
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")
    rows = df.select(
        *_keep(df, made),
        *[strip(text_or_empty(c)).alias(c) for c in made],
        source_name("source").alias("source_name"),
        strip(text_or_empty("image")).alias("image_url"),
        F.when(_absent("publishedAt"), stamp).otherwise(F.col("publishedAt")).alias("published_raw"),
    )
    return rows.filter((F.col("title") != "") & (F.col("url") != ""))


def normalize_filings(df: DataFrame) -> DataFrame:
    """Filing feed rows (title ``COMPANY: TYPE``, link, published, summary) as articles."""
    parts = F.split(text_or_empty("title"), ":", -1)
    known = F.size(parts) > 1
    company = F.when(known, strip(F.get(parts, F.lit(0)))).otherwise(F.lit("Unknown Company"))
    kind = F.when(known, strip(F.get(parts, F.lit(1)))).otherwise(F.lit("Filing"))
    rest = [c for c in df.columns if c not in ("title", "link", "published", "summary")]
    return df.select(
        *rest,
        F.concat(company, F.lit(" - "), kind).alias("title"),
        F.replace(text_or_empty("link"), F.lit("-index.htm"), F.lit(".txt")).alias("url"),
        F.lit("SEC EDGAR").alias("source_name"),
        text_or_empty("published").alias("published_raw"),
        text_or_empty("summary").alias("content"),
        F.concat(kind, F.lit(" filing from "), company).alias("description"),
        company.alias("company"),
        kind.alias("filing_type"),
    )
