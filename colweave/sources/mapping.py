"""Mapping and config tables by name or path, and the CSV form of a mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.checks import refuse_violations
from ..operators.ids import allocate_ids
from ..schemas import MAPPING, MAPPING_CSV, SOURCE_CONFIG, conform


def read_mapping(spark: SparkSession, source: str) -> DataFrame:
    return conform(_read(spark, source), MAPPING, source)


def read_source_config(spark: SparkSession, source: str, config_id: int | None = None) -> DataFrame:
    config = conform(_read(spark, source), SOURCE_CONFIG, source)
    return config if config_id is None else config.filter(config["config_id"] == config_id)


def read_mapping_csv(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    """Mapping rows from headed CSV; a line that does not fit the declared schema is an error.

    No column may be NULL: an empty cell is empty text, and a row without a number fails the read.
    With a ``position`` a column of that name numbers the rows from 1 as they stand in the file, or in the
    files of a folder by their names. A file that is read in several stretches is numbered over
    all of them; for that the rows are written once to the shared folder.
    """
    rows = spark.read.csv(path, header=True, schema=MAPPING_CSV, mode="FAILFAST", escape='"')
    texts = [field.name for field in MAPPING_CSV.fields if field.dataType == T.StringType()]
    numbers = [field.name for field in MAPPING_CSV.fields if field.name not in texts]
    if position is None:
        return refuse_violations(rows.fillna("", texts), numbers)
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),  # ascends inside a stretch
    )
    numbered = allocate_ids(placed, "_file", "_block", "_place", id_column=position)
    return refuse_violations(numbered.drop("_file", "_block", "_place").fillna("", texts), numbers)


def mapping_of_csv(rows: DataFrame, position: str | None = None) -> DataFrame:
    """Rows of the CSV form as mapping rows, in the form that a compile by source column takes.

    Every row is active and transformed; its source column is its target too. The file keeps no
    mapping ids: they are the ``position`` of the rows, so entries are in the order of the file. Without
    one they come from a hash of the row, and entries are in no order of the file.
    """
    hashed = F.xxhash64("config_id", *(f.name for f in MAPPING_CSV.fields[1:]))
    return conform(
        rows.select(
            F.col("config_id").cast("bigint").alias("config_id"),
            (hashed if position is None else F.col(position)).alias("custom_column_mapping_id"),
            *(F.lit(None).cast("string").alias(f"source_{part}_name") for part in ("database", "schema", "table")),
            "source_column_name",
            F.col("source_column_name").alias("target_column_name"),
            F.lit(1).alias("active_ind"),
            F.lit(0).alias("derived_ind"),
            F.lit(1).cast("bigint").alias("transformation_function_id"),
            F.col("f_definition").alias("transformation_function_def"),
            F.col("f_parameter_text").alias("transformation_parameter_text"),
            F.col("transform_data_type").alias("transform_func_data_type"),
        ),
        MAPPING,
        "mapping csv",
    )


def is_path(source: str) -> bool:
    """Whether a location is a path and not the name of a table."""
    return "/" in source


def _read(spark: SparkSession, source: str) -> DataFrame:
    return spark.read.parquet(source) if is_path(source) else spark.read.table(source)
