"""Where jobs put tables that later stages or runs read back."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# For a running session without that setting, which Spark takes at the start only.
SHARED_DIR = "msgspark.shared.dir"
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the session."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get(SHARED_DIR, None)
    if not folder:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    return folder.rstrip("/")


def give_local_folder(spark: SparkSession) -> None:
    """For tests and trials: a local session that names no folder gets one of its own.

    It goes when the process ends. A session on a cluster has to name one.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get(SHARED_DIR, None)
    if not named and spark.sparkContext.master.split("[")[0] == "local":
        own = tempfile.mkdtemp(prefix="run-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set(SHARED_DIR, own)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go with each job, not when the driver collects its garbage."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, path: str) -> None:
    """Have a written folder removed when the driver ends in good order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage at a table that survives lost executors, so work that is
    used more than once is done once. The table goes when the application ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    temporary(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def files_of(spark: SparkSession, path: str) -> list[str]:
    """Addresses of the Parquet files of a folder, for ``read_file`` in a task."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return sorted(s.getPath().toString() for s in listed if s.getPath().getName().endswith(".parquet"))


def read_file(address: str) -> pa.Table:
    """One file of the shared folder as a task reads it, from a disk, HDFS or an object store."""
    system, path = pa_fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", address))
    return pq.read_table(path, filesystem=system)


def fingerprint(spark: SparkSession, path: str) -> int:
    """Changes when files below a path do: their names, sizes and times."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = [], system.listFiles(place, True)
    while files.hasNext():
        one = files.next()
        found.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return hash(tuple(sorted(found)))
