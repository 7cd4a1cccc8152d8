"""The finished digest as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_digest(df: DataFrame, path: str, issue_date: Column, fmt: str = "parquet") -> None:
    """Write deck rows under their issue date; writing an issue again replaces it."""
    (
        df.withColumn("issue_date", F.to_date(issue_date))
        .hint("rebalance", "issue_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("issue_date")
        .format(fmt)
        .save(path)
    )
