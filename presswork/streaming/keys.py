"""Keys of what a growing table holds: a delta for each batch, in buckets, compacted from time to time.

Layout below the store's folder: ``delta/batch_id=b/bucket=k`` and ``base/upto=b/bucket=k``, the
latter with the keys of all batches up to ``b``; a base counts once ``bases/upto=b`` is there,
which is written last.  A repeated batch replaces its own delta.  Looking keys up reads the
buckets of the wanted keys only, and sends none of the others anywhere.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: Buckets of keys, fixed for the life of a store; deltas after which a new base is made.
BUCKETS, COMPACT_AFTER = 64, 50


def bucket(keys: tuple[str, ...]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _schema(df: DataFrame, keys: tuple[str, ...], part: str) -> str:
    return ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), f"{part} long", "bucket int"])


def _upto(spark: SparkSession, path: str) -> int:
    """The last batch that a complete base holds, -1 without any."""
    bases = _read(spark, f"{path}/bases", "n long, upto long")
    return -1 if bases is None else bases.agg(F.max("upto")).first()[0]


def add(rows: DataFrame, path: str, batch_id: int, keys: tuple[str, ...]) -> None:
    """Store the keys of a batch, in place of what the batch stored before."""
    delta = rows.select(*keys).distinct().withColumn("bucket", bucket(keys))
    delta.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{path}/delta/batch_id={batch_id}")


def stored(df: DataFrame, path: str, batch_id: int, keys: tuple[str, ...]) -> DataFrame | None:
    """All keys of other batches than ``batch_id``, with their ``bucket``; None without a store."""
    spark, upto = df.sparkSession, _upto(df.sparkSession, path)
    delta = _read(spark, f"{path}/delta", _schema(df, keys, "batch_id"))
    parts = [] if delta is None else [delta.filter((F.col("batch_id") > upto) & (F.col("batch_id") != batch_id)).select(*keys, "bucket")]
    if upto >= 0:
        parts.append(_read(spark, f"{path}/base", _schema(df, keys, "upto")).filter(F.col("upto") == upto).select(*keys, "bucket"))
    return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])


def known(df: DataFrame, path: str, batch_id: int, keys: tuple[str, ...]) -> DataFrame | None:
    """Those keys of ``df`` that other batches have stored; None without a store."""
    everything = stored(df, path, batch_id, keys)
    if everything is None:
        return None
    wanted = written(df.select(*keys).distinct().withColumn("bucket", bucket(keys)), "batch-keys")
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]  # at most BUCKETS
    renamed = wanted.select(*[F.col(k).alias(f"_w_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_w_{k}"))
    return everything.filter(F.col("bucket").isin(buckets)).join(renamed, same, "left_semi").select(*keys).distinct()


def compact(df: DataFrame, path: str, upto: int, keys: tuple[str, ...]) -> None:
    """Make a base of the keys of all batches up to ``upto``, which no one may repeat any more."""
    spark = df.sparkSession
    if _upto(spark, path) >= upto:
        return
    everything = stored(df, path, upto + 1, keys)
    base = everything.distinct().repartition("bucket").sortWithinPartitions("bucket", *keys)
    base.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{path}/base/upto={upto}")
    spark.range(1).select(F.col("id").alias("n")).write.mode("overwrite").parquet(f"{path}/bases/upto={upto}")
