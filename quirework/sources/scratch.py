"""The folder that driver and executors share, for tables between steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go when the statement that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, or under the context's checkpoint folder. Where neither is set and executors
    run in the driver's own process (tests), under a temporary folder; on a cluster that is an error. What is written there goes when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            folder = found.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="quirework-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(drop, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """What lies at ``path`` goes, if the JVM still runs."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may have ended before
        pass


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with ``values``, and as it was afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def put(df: DataFrame, path: str, mode: str = "error", **options) -> None:
    """``df`` as a table at ``path``; the shuffle files behind it go as soon as it is written."""
    with settings(df.sparkSession, {CLEANUP: "true"}):
        df.write.mode(mode).options(**options).parquet(path)
