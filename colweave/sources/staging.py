"""Frames written once to shared storage, so that later passes and retries read the same rows."""

from __future__ import annotations

import re
import uuid
import warnings

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, types as T

FOLDER = "colweave-staging"
_unnamed: dict[str, list[str]] = {}  # by application


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one in the warehouse.

    Every executor must reach it. A warehouse is a folder of the driver's own unless it is set, so
    on a cluster a local path of it is warned of.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if re.match("(file:)?/", warehouse) and not spark.sparkContext.master.startswith("local"):
        warnings.warn(f"spark.checkpoint.dir is not set; executors may not reach {warehouse}", stacklevel=2)
    return f"{warehouse}/_colweave"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system for code that runs in a task, and the path of ``uri`` in it."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def staging_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{FOLDER}"


def staging_path(spark: SparkSession, name: str | None = None) -> str:
    return f"{staging_root(spark)}/{name or uuid.uuid4().hex}"


def stage(
    df: DataFrame,
    name: str | None = None,
    schema: T.StructType | None = None,
    partition_by: str | None = None,
) -> DataFrame:
    """Write ``df`` and return the written rows. Under a ``name`` already written, only read them,
    with ``schema`` where it is not that of ``df``.

    The rows of each value of ``partition_by`` go to a folder of their own. A copy without a name belongs to the application and goes when that ends.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    if name is None or not is_staged(spark, name):
        df.write.mode("overwrite").parquet(path, partitionBy=partition_by)
    if name is None:
        files, folder = hadoop_path(spark, path)
        files.deleteOnExit(folder)
        _unnamed.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def is_staged(spark: SparkSession, name: str) -> bool:
    """Whether the write under ``name`` was committed; one that broke off does not count."""
    files, marker = hadoop_path(spark, f"{staging_path(spark, name)}/_SUCCESS")
    return files.exists(marker)


def unstage(spark: SparkSession, name: str) -> None:
    """Delete what was written under ``name``, if anything."""
    drop_folder(spark, staging_path(spark, name))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one, if it is there."""
    files, folder = hadoop_path(spark, path)
    files.delete(folder, True)


def scratch_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder in the shared one for files of the caller's own; it goes with the application."""
    path = f"{shared_folder(spark)}/{prefix}-{uuid.uuid4().hex}"
    files, folder = hadoop_path(spark, path)
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def staged_names(spark: SparkSession, prefix: str) -> list[str]:
    """The staged names that begin with ``prefix``."""
    files, folder = hadoop_path(spark, staging_root(spark))
    if not files.exists(folder):
        return []
    names = (status.getPath().getName() for status in files.listStatus(folder))
    return [name for name in names if name.startswith(prefix)]


def release_staged(spark: SparkSession) -> None:
    """Delete the copies without a name now. What reads them cannot be read after that."""
    for path in _unnamed.pop(spark.sparkContext.applicationId, []):
        files, folder = hadoop_path(spark, path)
        files.delete(folder, True)


def move_files(spark: SparkSession, source: str, target: str) -> None:
    """Move the data files of a finished write to another folder of the same file system."""
    files, folder = hadoop_path(spark, source)
    _, into = hadoop_path(spark, target)
    files.mkdirs(into)
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            _, moved = hadoop_path(spark, f"{target.rstrip('/')}/{name}")
            if not files.rename(status.getPath(), moved):
                raise OSError(f"{name} could not be moved to {target}")
    files.delete(folder, True)


def hadoop_path(spark: SparkSession, path: str):
    """The file system of ``path``, as the driver sees it, and the path in it."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location
