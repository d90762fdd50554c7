"""Declared schemas of every input and output, and the check made on entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_STR, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()

# The column names of the tables that are read and written.
MAPPING = _struct(
    ("config_id", _LONG, False),
    ("custom_column_mapping_id", _LONG, False),
    ("source_database_name", _STR, True),
    ("source_schema_name", _STR, True),
    ("source_table_name", _STR, True),
    ("source_column_name", _STR, False),
    ("target_column_name", _STR, False),
    ("active_ind", _INT, True),
    ("derived_ind", _INT, True),
    ("transformation_function_id", _LONG, True),
    ("transformation_function_def", _STR, True),
    ("transformation_parameter_text", _STR, True),
    ("transform_func_data_type", _STR, True),
)

SOURCE_CONFIG = _struct(
    ("config_id", _LONG, False),
    ("active_ind", _INT, True),
    ("source_database_name", _STR, True),
    ("source_schema_name", _STR, True),
    ("source_table_name", _STR, True),
)

MAPPING_CSV = _struct(
    ("config_id", _INT, False),
    ("source_column_name", _STR, False),
    ("f_definition", _STR, False),
    ("f_parameter_text", _STR, False),
    ("transform_data_type", _STR, False),
)

PACKAGES = _struct(
    ("ssis_file_path", _STR, False),
    ("ssis_file_name", _STR, False),
    ("content", _STR, True),
)

PACKAGES_BYTES = T.StructType([*PACKAGES.fields[:-1], T.StructField("content", T.BinaryType())])

CONVERSION_ROW = _struct(
    ("api_provider", _STR, False),
    ("model_name", _STR, False),
    ("ssis_file_path", _STR, False),
    ("ssis_file_name", _STR, False),
    ("system_prompt", _STR, True),
    ("prompt_prefix", _STR, True),
    ("ssis_component", _STR, True),
    ("llm_response", _STR, True),
)

CONVERSION_LOG = T.StructType([T.StructField("id", _LONG, False), *CONVERSION_ROW.fields])

_WIDENS_TO = {
    T.LongType: (T.ByteType, T.ShortType, T.IntegerType),
    T.IntegerType: (T.ByteType, T.ShortType),
    T.StringType: (T.CharType, T.VarcharType),
}


def required_columns(schema: T.StructType) -> list[str]:
    return [field.name for field in schema.fields if not field.nullable]


def conform(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """Project ``df`` to the declared columns, in order.

    Only casts that lose nothing are made; a missing column or another type is an error now,
    not a NULL later. Extra columns are dropped, so they are never read from the source.
    """
    actual = {field.name: field.dataType for field in df.schema.fields}
    missing = [field.name for field in schema.fields if field.name not in actual]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    columns = []
    for field in schema.fields:
        have = actual[field.name]
        if type(have) is type(field.dataType):
            columns.append(F.col(field.name))
        elif isinstance(have, _WIDENS_TO.get(type(field.dataType), ())):
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            raise TypeError(
                f"{what}: column {field.name} is {have.simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    return df.select(*columns)
