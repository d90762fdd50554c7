"""Row-level operators over the mapping: filters, projections and reject reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import has_parameters
from ..functions.text import null_cast_item, qualified_table_name, quote_identifier
from ..functions.types import is_known_type, normalize_type

# The audit column of current rows, and in the queries the value it has there.
ACTIVE_ROW_COLUMN = "AUDIT_ACTIVE_ROW_IND"


def is_raw() -> Column:
    """NULL when ``derived_ind`` is, so such a row is neither raw nor derived."""
    function_id = F.col("transformation_function_id")
    derived = F.col("derived_ind")
    return (derived == 0) | ((derived == 1) & function_id.isNull())


def is_derived() -> Column:
    return (F.col("derived_ind") == 1) & is_transformed()


def is_transformed() -> Column:
    return F.col("transformation_function_id").isNotNull()


def active_mapping(mapping: DataFrame, config_id: int | None = None) -> DataFrame:
    active = mapping.filter(F.col("active_ind") == 1)
    return active if config_id is None else active.filter(F.col("config_id") == config_id)


def raw_column_rows(mapping: DataFrame) -> DataFrame:
    return mapping.filter(is_raw())


def derived_column_rows(mapping: DataFrame) -> DataFrame:
    return mapping.filter(is_derived())


def transformed_rows(mapping: DataFrame) -> DataFrame:
    return mapping.filter(is_transformed())


def active_source_rows(source: DataFrame) -> DataFrame:
    return source.filter(F.col(ACTIVE_ROW_COLUMN) == "Y")


def source_table() -> Column:
    """The qualified table name from the three source columns of a row."""
    return qualified_table_name(
        F.col("source_database_name"), F.col("source_schema_name"), F.col("source_table_name")
    )


def quoted_columns(mapping: DataFrame, style: str = "backtick") -> DataFrame:
    return mapping.select(
        "config_id",
        "custom_column_mapping_id",
        quote_identifier(F.col("source_column_name"), style).alias("quoted_name"),
    )


def null_cast_items(mapping: DataFrame, style: str = "backtick") -> DataFrame:
    return derived_column_rows(mapping).select(
        "config_id",
        "custom_column_mapping_id",
        null_cast_item(F.col("source_column_name"), style).alias("item"),
    )


def reject_reason() -> Column:
    """Why a row cannot be used; NULL when it can. All but the first concern transformed rows."""
    definition = F.col("transformation_function_def")
    parameters = F.col("transformation_parameter_text")
    return (
        F.when(F.col("source_column_name").isNull(), "null_source_column")
        .when(~is_transformed(), None)
        .when(F.col("target_column_name").isNull(), "null_target_column")
        .when(~is_known_type(normalize_type(F.col("transform_func_data_type"))), "unknown_type")
        .when(definition.isNull(), "null_definition")
        .when(parameters.isNull() & has_parameters(definition), "null_parameters")
    )


def function_definitions(mapping: DataFrame) -> DataFrame:
    """Named columns of the transformed rows, types normalised, nothing bound yet."""
    return transformed_rows(mapping).select(
        "config_id",
        "custom_column_mapping_id",
        "source_column_name",
        "target_column_name",
        F.col("transformation_function_def").alias("f_definition"),
        F.col("transformation_parameter_text").alias("f_parameter_text"),
        normalize_type(F.col("transform_func_data_type")).alias("transform_data_type"),
    )
