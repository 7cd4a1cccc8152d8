"""Dated snapshots: one JSON file per sector and day, and the partitioned table of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..session import written
from ..functions.fields import published_ts, source_name


def _exploded(files: DataFrame) -> DataFrame:
    """One row per article; a snapshot without articles keeps one row with a NULL url."""
    rows = files.select(
        F.col("query").alias("sector"),
        F.col("date").alias("snapshot_raw"),
        F.col("snapshot_file"),
        F.posexplode_outer("articles").alias("provider_rank", "a"),
    )
    return rows.select(
        "sector",
        F.col("a.source").alias("source"),
        F.col("provider_rank").cast("long").alias("provider_rank"),
        F.col("a.url").alias("url"),
        F.col("a.title").alias("title"),
        F.col("a.description").alias("description"),
        F.col("a.content").alias("content"),
        F.when(F.col("provider_rank").isNotNull(), source_name("a.source")).alias("source_name"),
        F.col("a.author").alias("author"),
        F.col("a.urlToImage").alias("image_url"),
        F.col("a.publishedAt").alias("published_raw"),
        published_ts("a.publishedAt").alias("published_ts"),
        published_ts("snapshot_raw").alias("snapshot_ts"),
        F.to_date(published_ts("snapshot_raw")).alias("snapshot_date"),
        "snapshot_file",
    )


#: Holds what could not be read of a record.
CORRUPT = "_corrupt"
_SCHEMA = T.StructType([*schema.SNAPSHOT_FILE.fields, T.StructField(CORRUPT, T.StringType())])


def _records(reader, path: str, multi_line: bool) -> DataFrame:
    """Records of snapshot files, readable or not, with the file that each is from."""
    files = (
        reader.schema(_SCHEMA)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    return files.withColumn("snapshot_file", F.col("_metadata.file_path"))


def _readable(records: DataFrame) -> DataFrame:
    return _exploded(records.filter(F.col("query").isNotNull() & F.col(CORRUPT).isNull()))


def _unreadable(records: DataFrame) -> DataFrame:
    """(snapshot_file, reason, record) of the records that give no rows."""
    reason = (
        F.when(F.col(CORRUPT).isNull(), "no sector")
        .when(F.trim(F.regexp_replace(CORRUPT, r"\s+", " ")) == "", "empty")
        .otherwise("unreadable")
    )
    # what is wrong with the articles shows only where they are parsed
    parsed = F.coalesce(F.size("articles"), F.lit(0)) >= -1
    bad = records.filter((F.col("query").isNull() | F.col(CORRUPT).isNotNull()) & parsed)
    return bad.select("snapshot_file", reason.alias("reason"), F.col(CORRUPT).alias("record"))


def read_snapshots(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Articles of snapshot files.  Unreadable ones give no rows; ``bad_snapshots`` lists them."""
    return _readable(_records(spark.read, path, multi_line))


def bad_snapshots(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """What ``read_snapshots`` leaves out: (snapshot_file, reason, record).

    ``reason`` is ``unreadable`` (no JSON, cut off, or not of the schema), ``no sector`` or
    ``empty``.  Files without any record, which no reader reports, are found by comparing
    the listed files with those that were read.  Readers do not even list files of no
    length; the driver looks for these, as it lists the folder for any reader.
    """
    records = _records(spark.read, path, multi_line)
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("snapshot_file"))
    seen = records.groupBy("snapshot_file").agg(F.count("query").alias("_n")).select("snapshot_file")
    nothing = spark.createDataFrame([(name,) for name in _empty_files(spark, path)], "snapshot_file string")
    empty = listed.join(seen, "snapshot_file", "left_anti").unionByName(nothing)
    return _unreadable(records).unionByName(empty.select("snapshot_file", F.lit("empty").alias("reason"), F.lit(None).cast("string").alias("record")))


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files of no length below a folder, hidden ones left out."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    found = []
    while files.hasNext():
        status = files.next()
        if status.getLen() == 0 and status.getPath().getName()[0] not in "._":
            found.append(status.getPath().toUri().toString())
    return found


def stream_snapshots(
    spark: SparkSession, path: str, files_per_batch: int = 1000, multi_line: bool = True
) -> DataFrame:
    """The same rows as ``read_snapshots`` from a folder that keeps growing; every file is read once."""
    return _readable(_records(spark.readStream.option("maxFilesPerTrigger", files_per_batch), path, multi_line))


def stream_bad_snapshots(
    spark: SparkSession, path: str, files_per_batch: int = 1000, multi_line: bool = True
) -> DataFrame:
    """The rows of ``bad_snapshots`` from a folder that keeps growing, but for files without
    any record, which streams pass over."""
    return _unreadable(_records(spark.readStream.option("maxFilesPerTrigger", files_per_batch), path, multi_line))


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace the (sector, day) partitions present in ``df``; leave all others alone.

    The rebalance hint lets adaptive execution cut a large sector into several files and
    pack small ones, so no task writes a whole hot sector.
    """
    (
        df.hint("rebalance", "sector", "snapshot_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("sector", "snapshot_date")
        .parquet(path)
    )


def read_snapshot_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_snapshot(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Rows of each sector's most recent snapshot, or of the one dated ``as_of``.

    The maximum is pre-aggregated per task and the few (sector, time) pairs are written, so
    their exact size decides the join: below the broadcast threshold no article row moves.
    """
    if as_of is not None:
        return df.filter(F.to_date("snapshot_ts") == F.to_date(as_of))
    newest = df.groupBy("sector").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return df.join(written(newest, "newest"), ["sector", "snapshot_ts"], "left_semi")


def fresh(df: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Snapshots younger than the time to live."""
    oldest = as_of - F.make_dt_interval(secs=F.lit(ttl_seconds))
    return df.filter((F.col("snapshot_ts") > oldest) & (F.col("snapshot_ts") <= as_of))
