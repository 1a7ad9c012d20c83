"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_announced: set[str] = set()
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Only in a session on this machine alone (a local master, as in tests) that
    lacks the setting, a temporary folder is made, and removed when the
    interpreter ends. On a cluster its absence is an error: a local folder
    would be another one on each machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        made = tempfile.mkdtemp(prefix="folioscan-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own_dirs[app] = "file://" + made
    return _own_dirs[app]


def hadoop(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and the path as an object of it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: one without stands for the same place in Spark and outside it."""
    system, at = hadoop(spark, path)
    return system.makeQualified(at).toString()


def shared_path(spark: SparkSession, name: str) -> str:
    """The path of a given name in this application's part of the shared folder, which goes when the driver's JVM ends."""
    app = f"{shared_dir(spark)}/folioscan-{spark.sparkContext.applicationId}"
    if app not in _announced:
        system, at = hadoop(spark, app)
        system.mkdirs(at)
        system.deleteOnExit(at)
        _announced.add(app)
    return f"{app}/{name}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else has."""
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it back.

    A lost executor then costs only a re-read, and every later use sees the
    same rows. What is written stays until ``discard``, ``clean_up`` or the
    end of the driver's JVM.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what ``materialise`` wrote for ``df``; nothing may read it afterwards."""
    if path := _places.pop(df, None):
        system, at = hadoop(df.sparkSession, path)
        system.delete(at, True)


def clean_up(spark: SparkSession) -> None:
    """Removes everything that this application has materialised; call it when no result is to be read any more."""
    system, at = hadoop(spark, f"{shared_dir(spark)}/folioscan-{spark.sparkContext.applicationId}")
    system.delete(at, True)
    _announced.clear()
