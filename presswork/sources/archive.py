"""Archive of fetched articles: JSON arrays whose elements carry a ``_metadata`` record."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params, schema


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archived articles with ``meta`` (the stored record) and ``archive_file``.

    A file is either one JSON array, as archives arrive, or JSON lines, as ``write_archive``
    leaves them; the form of each file is told by its lines.  Each file is then parsed once, in
    its form: lines in as many splits as the file has, arrays as a whole.
    """
    lines = spark.read.text(path)
    lines = lines.select("value", lines.metadataColumn("_metadata").getField("file_path").alias("archive_file"))
    forms = lines.filter(F.trim("value") != "").groupBy("archive_file").agg(
        F.bool_and(F.trim("value").rlike(r"^\{.*\}$")).alias("by_line")
    ).collect()  # the names of the files, as the driver lists them for any reader
    parts = []
    for multi_line in (True, False):
        files = [unquote(r["archive_file"]) for r in forms if r["by_line"] != multi_line]
        if files:
            parts.append(_read(spark, files, multi_line))
    return reduce(DataFrame.unionByName, parts) if parts else _read(spark, path, False).limit(0)


def read_archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_archive`` wrote: JSON lines, splittable at any size."""
    return _read(spark, path, multi_line=False)


def _read(spark: SparkSession, path: str | list[str], multi_line: bool) -> DataFrame:
    """The stored field ``_metadata`` hides the file-source column, hence ``metadataColumn``."""
    raw = spark.read.schema(schema.ARCHIVE_ARTICLE).option("multiLine", multi_line).json(path)
    file_path = raw.metadataColumn("_metadata").getField("file_path")
    return raw.withColumn("archive_file", file_path).withColumnRenamed("_metadata", "meta")


def stamp(df: DataFrame, source: str | Column, now: Column) -> DataFrame:
    return df.withColumn(
        "_metadata",
        F.struct(
            (F.lit(source) if isinstance(source, str) else source).alias("source"),
            F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"),
            F.lit(params.ARCHIVE_VERSION).alias("version"),
        ),
    )


def write_archive(df: DataFrame, source: str | Column, path: str, now: Column, drop: tuple[str, ...] | list[str] = ()) -> None:
    """Append a stamped batch as JSON lines; an empty batch leaves nothing behind."""
    # A Parquet/JSON append of no rows still commits an empty file, so test for a first row.
    if df.isEmpty():
        return
    stamp(df, source, now).drop(*drop).write.mode("append").json(path)
