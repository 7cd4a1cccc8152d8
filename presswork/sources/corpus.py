"""Plain text corpora read as articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_BREAK
from ..sizing import spread_small


def read_documents(spark: SparkSession, path: str, sectors: int = 8, spread: bool = True) -> DataFrame:
    """A ``documents`` table (doc_id, text, lang, source) as canonical articles.

    The link is derived from the text, so exact copies share it; sector, provider and
    search number are dealt out by document number.  ``spread=False`` is for light work on a
    text: small tables are then read as they lie.
    """
    docs = spark.read.parquet(path).select("doc_id", "text", "lang", "source")
    docs = spread_small(docs, "doc_id") if spread else docs
    head = F.split("text", SENTENCE_BREAK, 3)
    day = F.lit(86_400)
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3_600)
    return docs.select(
        "doc_id",
        F.concat(F.lit("S"), (F.col("doc_id") % sectors).cast("string")).alias("sector"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("newsapi")).otherwise(F.lit("gnews")).alias("provider"),
        (F.floor(F.col("doc_id") / sectors) % 5).cast("int").alias("query_idx"),
        (F.col("doc_id") % 2).cast("int").alias("provider_idx"),
        F.col("doc_id").alias("provider_rank"),
        F.concat(F.lit("doc://"), F.md5("text")).alias("url"),
        F.get(head, F.lit(0)).alias("title"),
        F.array_join(F.slice(head, 1, 2), " ").alias("description"),
        F.col("text").alias("content"),
        F.col("source").alias("source_name"),
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("image_url"),
        "lang",
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_raw"),
        ts.alias("published_ts"),
        F.timestamp_seconds(
            F.floor((F.lit(1_704_067_200) + F.col("doc_id") * 3_600) / day) * day
        ).alias("snapshot_ts"),
    )
