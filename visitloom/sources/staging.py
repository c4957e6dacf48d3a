"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: set[str] = set()
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a session whose executors are
    the driver itself gets a folder of its own without the setting; anywhere
    else (``local-cluster`` too) a machine-local folder would be lost with its
    machine, so there the setting is required."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.conf.get("spark.app.id")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="visitloom-")
    return _own[app]


def _files(spark: SparkSession, folder: str):
    """Hadoop's file system and path; None on a session without a JVM of its own."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return None
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def app_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, removed when its driver ends
    (a remote session leaves that to whoever empties the shared folder)."""
    folder = f"{shared_folder(spark)}/visitloom-{spark.conf.get('spark.app.id')}"
    if folder not in _made:
        if found := _files(spark, folder):
            found[0].mkdirs(found[1])
            found[0].deleteOnExit(found[1])
        _made.add(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{app_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    if found := _files(spark, path):
        found[0].delete(found[1], True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in the folder; none if it does not exist."""
    found = _files(spark, path)
    if found is None:
        raise RuntimeError("folders can only be listed by a session with a JVM of its own")
    system, folder = found
    return [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []


def rename_folder(spark: SparkSession, path: str, new: str) -> None:
    system, folder = _files(spark, path)
    if not system.rename(folder, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{path} could not be renamed to {new}")


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was staged inside, so that a long-lived job keeps
    the shared folder small. Results must be written or collected before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove_folder(spark, path)


def stage(df: DataFrame) -> DataFrame:
    """Writes the rows and reads them back (eager).

    Cuts the lineage in a way that survives lost executors, and unlike a
    checkpoint gives readers column pruning and the planner the true size.
    """
    spark = df.sparkSession
    path = new_path(spark, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
