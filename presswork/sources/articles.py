"""What the sources deliver, brought into the columns of the canonical article table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import published_ts, source_name
from ..schema import ARTICLE_COLUMNS

#: Where a canonical column is found, in order of preference.
FOUND_IN = {
    "source_name": ["source_name"],
    "image_url": ["image_url", "urlToImage", "url_to_image", "image", "top_image"],
    "published_raw": ["published_raw", "publishedAt", "published_at", "published"],
    "content": ["content", "summary"],
}
TYPES = {"query_idx": "int", "provider_idx": "int", "provider_rank": "long", "published_ts": "timestamp", "snapshot_ts": "timestamp"}


def to_articles(df: DataFrame, lang: str = "en", **known: Column | str | int) -> DataFrame:
    """Articles of any source (snapshots, responses, filings, pages, archive) with all
    canonical columns.

    ``known`` gives columns that the source does not carry, such as ``sector`` or
    ``provider``; ``lang`` is the language of sources that name none, as they are searched
    by language.  Places in the order of collection that are unknown count as 0; whatever
    else is missing is NULL.
    """

    def column(name: str) -> Column:
        if name in known:
            return known[name] if isinstance(known[name], Column) else F.lit(known[name])
        own = [F.col(c) for c in FOUND_IN.get(name, [name]) if c in df.columns]
        if name == "source_name" and not own and "source" in df.columns:
            return source_name("source")
        if name == "published_ts" and not own:
            return published_ts(column("published_raw"))
        if name == "author" and not own and "authors" in df.columns:
            return F.array_join("authors", ", ")
        default = {"lang": lang, "query_idx": 0, "provider_idx": 0, "provider_rank": 0}.get(name)
        return F.coalesce(*own, F.lit(default)) if default is not None else F.coalesce(*own, F.lit(None))

    return df.select(*[column(c).cast(TYPES.get(c, "string")).alias(c) for c in ARTICLE_COLUMNS])
