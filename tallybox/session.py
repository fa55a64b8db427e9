"""Getting this package to the workers of a running session, and the folder that all of them share."""

from __future__ import annotations

import os
import shutil
import tempfile
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_local: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files once, so that tasks import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        name = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tallybox")
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(here), "tallybox"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Where it is unset, a temporary one in local mode; on a cluster an error, since executors
    would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="spark-"))


def cut(df):
    """`df` checkpointed in the shared folder: its lineage ends there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df):
    """`df` as a Parquet table in the shared folder: like `cut`, where later passes read few of its columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark keeps it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def freed(spark: SparkSession):
    """Shuffle files of what runs inside go when it has run, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)
