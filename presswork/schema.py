"""Schemas of what lands and of the canonical article table."""

from __future__ import annotations

from pyspark.sql import types as T

# ``source`` is a JSON string in some files and an object in others; read as STRING the
# object keeps its JSON text and ``functions.fields.source_name`` unifies both.
SNAPSHOT_ARTICLE = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "source", "author", "title", "description", "url", "urlToImage", "publishedAt",
            "content",
        )
    ]
)

SNAPSHOT_FILE = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("articles", T.ArrayType(SNAPSHOT_ARTICLE)),
    ]
)

ARCHIVE_META = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source", "fetched_at", "version")]
)

ARCHIVE_ARTICLE = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "title", "url", "source", "published_at", "content", "description", "author",
            "url_to_image", "image", "source_url", "company", "filing_type", "top_image",
            "summary",
        )
    ]
    + [
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("_metadata", ARCHIVE_META),
    ]
)

NEWSAPI_RESPONSE = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("articles", T.ArrayType(SNAPSHOT_ARTICLE)),
    ]
)

GNEWS_RESPONSE = T.StructType(
    [
        T.StructField("errors", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField(
            "articles",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(n, T.StringType())
                        for n in (
                            "title", "description", "content", "url", "image", "publishedAt",
                            "source",
                        )
                    ]
                )
            ),
        ),
    ]
)

#: Columns of the canonical article table, in order.
ARTICLE_COLUMNS = [
    "sector", "provider", "query_idx", "provider_idx", "provider_rank", "url", "title",
    "description", "content", "source_name", "author", "image_url", "lang", "published_raw",
    "published_ts", "snapshot_ts",
]

#: The order in which a sector's articles were collected: search, provider, position.
COLLECTION_ORDER = ["query_idx", "provider_idx", "provider_rank"]
