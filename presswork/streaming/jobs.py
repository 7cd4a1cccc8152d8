"""Incremental forms: a growing snapshot folder read, de-duplicated, counted and enriched."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators import selection
from ..plans.enrich import enrich_articles
from ..session import discarding, scratch_path, written
from . import keys

SALTS = 16


def stream_dedup(df: DataFrame, ts: str = "published_ts", ttl: str = "24 hours", keys: tuple[str, ...] = ("sector", "url"), salts: int = SALTS) -> DataFrame:
    """First arrival of each link within the retention period.

    Rows first meet within (link, salt), the salt coming from the task that read the row, so
    a link that makes up much of the stream, even by rows alike in everything, is thinned
    out by many tasks before its few survivors meet.
    """
    rows = df.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.filter(F.col("url").isNotNull() & (F.col("url") != ""))
    rows = rows.withWatermark(ts, ttl)
    if salts > 1:
        rows = rows.withColumn("_salt", F.spark_partition_id() % salts)
        rows = rows.dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt")
    return rows.dropDuplicatesWithinWatermark(list(keys))


def stream_category_counts(df: DataFrame, ts: str = "published_ts", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Insights per category and day; rows later than the watermark are dropped."""
    cats = F.coalesce("categories", F.array(F.lit("Other")))
    return (
        df.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, late)
        .select(ts, F.explode(cats).alias("category"))
        .groupBy(F.window(ts, width), "category")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("day_start"), "category", "n")
    )


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append whatever is available now to a Parquet table, exactly once."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def drain(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is available and read the result back."""
    base = scratch_path(spark, name)
    run_to_table(df, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/table")


def drain_all(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Counts of everything that is available, windows still open included, as in batch.

    ``df`` has an aggregation.  Each batch writes the whole result, rows that would be late included.
    """
    base = scratch_path(spark, name)
    table = f"{base}/table"
    spark.createDataFrame([], df.schema).write.parquet(f"{table}/batch_id=-1")
    newest = -1  # a query without input reports a batch that never ran

    def keep(batch: DataFrame, batch_id: int) -> None:
        nonlocal newest
        # under its number, so a failure while writing leaves what was there before
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        newest = batch_id

    query = (
        df.writeStream.option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("complete")
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{table}/batch_id={newest}")


#: What tells enriched articles apart.
KEYS = ("sector", "url")


def _key_store(spark: SparkSession, path: str) -> str:
    """The folder of the table's key store, made from the table if that is older than stores."""
    store = f"{path.rstrip('/')}_keys"
    try:
        spark.read.schema("sector string").parquet(f"{store}/delta")
        return store
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return store
    for r in table.select("batch_id").distinct().collect():  # one for each batch so far
        keys.add(table.filter(F.col("batch_id") == r["batch_id"]), store, r["batch_id"], KEYS)
    return store


def merge_batch(batch: DataFrame, batch_id: int, path: str, **enriching) -> None:
    """Enrich the articles not stored yet and add them under their batch number.

    Rewriting a batch replaces exactly its own partitions, so a batch repeated after a
    failure leaves no duplicates.  All stored links count, whatever their day; they are
    looked up in a store of keys beside the table, of which a batch reads its own buckets.
    Tables made on the way are removed.
    """
    with discarding(batch.sparkSession):
        _merge(batch, batch_id, path, **enriching)


def _merge(batch: DataFrame, batch_id: int, path: str, **enriching) -> None:
    spark = batch.sparkSession
    fresh = selection.dedup_by_url(batch, ["snapshot_ts", "provider_rank", "snapshot_file"])
    store = _key_store(spark, path)
    known = keys.known(fresh, store, batch_id, KEYS)
    if known is not None:
        known = written(known, "known-links").select(F.col("sector").alias("_s"), F.col("url").alias("_u"))
        fresh = fresh.join(known, F.col("sector").eqNullSafe(F.col("_s")) & (F.col("url") == F.col("_u")), "left_anti")
    # articles are dealt to their days before they are enriched, as records are several times as wide; a batch of
    # few days is cut finer, as enriching takes more time than writing
    parts = math.ceil(spark.sparkContext.defaultParallelism / max(1, batch.select("snapshot_date").distinct().count()))
    fresh = fresh.withColumn("_part", F.pmod(F.xxhash64("url"), F.lit(parts))).hint("rebalance", "snapshot_date", "_part").drop("_part")
    rows = enrich_articles(fresh, **enriching).withColumn("batch_id", F.lit(batch_id).cast("long"))
    if any(isinstance(v, DataFrame) for v in enriching.values()):  # may be joined, which deals rows anew
        rows = rows.hint("rebalance", "snapshot_date")
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", "snapshot_date")
        .parquet(path)
    )
    try:
        added = spark.read.parquet(path).filter(F.col("batch_id") == batch_id)
    except AnalysisException as e:  # nothing has been added so far
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return
    keys.add(added, store, batch_id, KEYS)
    if batch_id % keys.COMPACT_AFTER == keys.COMPACT_AFTER - 1:
        keys.compact(added, store, batch_id - 1, KEYS)


def stream_enrich(df: DataFrame, path: str, checkpoint: str, **enriching) -> StreamingQuery:
    """Enrich each batch of new snapshots and merge it into the table by (sector, url)."""
    return (
        df.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: merge_batch(batch, batch_id, path, **enriching))
        .trigger(availableNow=True)
        .start()
    )
