"""Package files, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """``(ssis_file_path, ssis_file_name, content)`` of every file under a folder or glob, as UTF-8 text.

    The path is that of the folder; both are names as a file system lists them.
    """
    # as an argument: text() sets the option of this name itself and would undo one set before
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return _named(files, F.col("_metadata.file_path"), F.col("value"))


def read_package_bytes(spark: SparkSession, path: str) -> DataFrame:
    """The same with the content as bytes, so that a document is read in the encoding it declares."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return _named(files, F.col("_metadata.file_path"), F.col("content"))


def _named(files: DataFrame, path: Column, content: Column) -> DataFrame:
    whole = F.regexp_replace(_decoded(path), "^file:/+", "/")
    return files.select(
        F.regexp_replace(whole, "/[^/]*$", "").alias("ssis_file_path"),
        _decoded(F.col("_metadata.file_name")).alias("ssis_file_name"),
        content.alias("content"),
    )


def _decoded(encoded: Column) -> Column:
    """A name without its percent signs; a plus sign stands for itself in a path."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
