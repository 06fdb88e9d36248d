"""Tables written to the folder that driver and executors share: recovery points that cut a plan."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()
_within = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where that setting is absent a temporary folder is made and set, if all runs on one machine; elsewhere this raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="factloom-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _in_store(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _in_store(spark, path)
    return store.exists(target)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; unique, so reruns never meet half-written output.  Goes when the session's JVM does."""
    folder = f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        store, target = _in_store(spark, folder)
        store.mkdirs(target)
        store.deleteOnExit(target)
        _folders.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    for paths in getattr(_within, "open", []):
        paths.append(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.scratch = path
    return again


def remove(table: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing that is still to run reads it."""
    store, target = _in_store(table.sparkSession, table.scratch)
    store.delete(target, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what this thread has written within: for long sessions, once results are out."""
    paths: list[str] = []
    _within.open = [*getattr(_within, "open", []), paths]
    try:
        yield
    finally:
        _within.open = _within.open[:-1]
        for path in paths:
            store, target = _in_store(spark, path)
            store.delete(target, True)
