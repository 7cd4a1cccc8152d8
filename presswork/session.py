"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on.  They hold for a laptop and for a large cluster:
# partition counts are left to adaptive execution, not fixed here.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(app: str = "presswork", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting (unit tests, a laptop) gets a temporary
    folder, which is then remembered in the session; on a cluster it has to be set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "presswork.scratch.dir", None
    )
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="presswork-")
    spark.conf.set("presswork.scratch.dir", made)
    return made


#: Paths made since each of the open ``discarding`` blocks began.
_recording: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for record in _recording:
        record.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table made by this session, wherever the shared folder is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables that are made inside, when their result has been written."""
    record: list[str] = []
    _recording.append(record)
    try:
        yield
    finally:
        _recording[:] = [r for r in _recording if r is not record]
        for path in record:
            remove(spark, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind, as soon as each is complete."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """What ``make`` returns as a written table, and its path; the tables made on the way are removed."""
    path = scratch_path(spark, name)
    with discarding(spark):
        made = make()
        made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder.

    Cuts lineage in a way that survives lost executors, and gives the optimizer exact
    sizes: a later join broadcasts the table only if its files are small enough.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
