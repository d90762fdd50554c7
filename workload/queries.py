"""One query per operator: ``(spark, sf_dir) -> DataFrame`` over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import colweave as cw
from colweave.functions import binding, text, types
from colweave.operators import checks, columns, enrich, items, lists, rows
from colweave.plans.compile import collect_mapping, source_entries
from colweave.sources.staging import stage, staging_path

from . import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.active_mapping(inputs.mapping(spark, sf_dir))


# --- scans, sources, sinks


@query
def scan_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs.mapping(spark, sf_dir).createOrReplaceTempView("vw_column_mapping")
    return cw.read_mapping(spark, "vw_column_mapping")


@query
def scan_source_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs.config(spark, sf_dir).createOrReplaceTempView("source_config")
    config = cw.read_source_config(spark, "source_config").filter("active_ind = 1")
    return config.select("config_id", "source_database_name", "source_schema_name", "source_table_name")


def written_csv(spark: SparkSession, sf_dir: str) -> str:
    """The transformed rows as CSV, those of great mapping ids first, in several files."""
    path = staging_path(spark)
    mapping = rows.transformed_rows(inputs.mapping(spark, sf_dir))
    written = mapping.orderBy(F.desc("custom_column_mapping_id"), "config_id").selectExpr(
        "cast(config_id as int) as config_id",
        "source_column_name",
        "transformation_function_def as f_definition",
        "coalesce(transformation_parameter_text, '') as f_parameter_text",
        "transform_func_data_type as transform_data_type",
    )
    written.withColumn("transform_data_type", types.normalize_type(F.col("transform_data_type"))).write.csv(
        path, header=True, escape='"'
    )
    return path


@query
def read_mapping_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cw.read_mapping_csv(spark, written_csv(spark, sf_dir))


@query
def read_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = inputs.package_folder(spark, sf_dir, cut=True)
    folder = F.replace("ssis_file_path", F.lit(root.removeprefix("file:").replace("//", "")), F.lit("root"))
    return cw.read_packages(spark, root).withColumn("ssis_file_path", folder)


@query
def append_conversion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = inputs.two_batches(spark, sf_dir)
    return log.read()


@query
def log_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = inputs.log_rows(spark, sf_dir).withColumns(
        {
            "model_name": F.when(F.col("doc_id") % 7 != 0, F.col("model_name")),
            "ssis_file_name": F.when(F.col("doc_id") % 5 != 0, F.col("ssis_file_name")),
        }
    )
    return checks.log_violations(broken)


@query
def allocate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = cw.explode_components(inputs.packages(spark, sf_dir))
    keys = stage(components.select("ssis_file_name", "component_index"))
    return cw.allocate_ids(keys, "ssis_file_name", "component_index", after=1000)


@query
def log_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, mark = inputs.two_batches(spark, sf_dir)
    return log.since(mark)


@query
def log_for_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = inputs.two_batches(spark, sf_dir)
    return log.for_package("src0", ("id", "ssis_file_name", "llm_response"))


# --- filters


@query
def active_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active(spark, sf_dir)


def _keys(frame: DataFrame) -> DataFrame:
    return frame.select("config_id", "custom_column_mapping_id", "source_column_name")


@query
def raw_column_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(rows.raw_column_rows(active(spark, sf_dir)))


@query
def derived_column_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(rows.derived_column_rows(active(spark, sf_dir)))


@query
def transformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(rows.transformed_rows(active(spark, sf_dir)))


@query
def active_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = rows.active_source_rows(inputs.source(spark, sf_dir))
    return source.select("l_orderkey", "l_linenumber", "l_partkey", "AUDIT_ACTIVE_ROW_IND")


# --- projections and scalar functions


@query
def normalize_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = types.normalize_type(F.col("transform_func_data_type"))
    return inputs.mapping(spark, sf_dir).select(
        "config_id", "custom_column_mapping_id", kind.alias("transform_data_type")
    )


@query
def null_cast_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.null_cast_items(active(spark, sf_dir))


@query
def qualified_table_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.config(spark, sf_dir).select("config_id", rows.source_table().alias("source_table"))


@query
def quote_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # no name of the mapping holds a backtick, so some of these do
    odd = F.expr("concat('P', '#', l_partkey, if(l_partkey % 3 = 0, '`', '$'))")
    return inputs.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        text.quote_identifier(odd).alias("backtick"),
        text.quote_identifier(odd, "bracket").alias("bracket"),
    )


@query
def bind_source_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = binding.bind_source_column(F.col("transformation_function_def"), F.col("source_column_name"))
    return rows.transformed_rows(active(spark, sf_dir)).select(
        "config_id", "custom_column_mapping_id", bound.alias("f_definition")
    )


@query
def bind_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = binding.bind_parameters(
        F.col("transformation_function_def"),
        F.col("source_column_name"),
        F.col("transformation_parameter_text"),
    )
    return rows.transformed_rows(active(spark, sf_dir)).select(
        "config_id", "custom_column_mapping_id", bound.alias("f_definition")
    )


@query
def quoted_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = items.typed_lists(collect_mapping(inputs.mapping(spark, sf_dir)))
    return lists.joined_lists(lists.quoted_lists(lists.padded_lists(typed, 3)), ",")


@query
def typed_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = types.normalize_type(F.col("transform_func_data_type"))
    return active(spark, sf_dir).select(
        "config_id",
        "custom_column_mapping_id",
        types.null_text(kind).alias("null_text"),
        *[types.typed_null(k).cast("string").alias(f"null_{k.prefix}") for k in types.LOGICAL_TYPES],
        *[F.typeof(types.typed_null(k)).alias(f"type_{k.prefix}") for k in types.LOGICAL_TYPES],
    )


@query
def render_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = enrich.render_prompts(
        inputs.table(spark, sf_dir, "documents"), "text", "Digest this", "You digest."
    )
    return rendered.select("doc_id", "prompt", "system_prompt")


@query
def conversion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.log_rows(spark, sf_dir)


@query
def function_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.function_definitions(active(spark, sf_dir))


# --- aggregations


@query
def distinct_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = columns.distinct_columns(active(spark, sf_dir))
    return distinct.select(
        "config_id",
        F.array_join("raw_columns", ",").alias("raw_columns"),
        F.array_join("derived_columns", ",").alias("derived_columns"),
    )


@query
def ordered_column_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.ordered_text(
        rows.raw_column_rows(active(spark, sf_dir)),
        "config_id",
        ("custom_column_mapping_id",),
        text.quote_identifier(F.col("source_column_name"), "bracket"),
        ", ",
        "column_list",
    )


@query
def joined_column_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.ordered_text(
        rows.derived_column_rows(active(spark, sf_dir)),
        "config_id",
        ("custom_column_mapping_id",),
        F.col("source_column_name"),
        ",",
        "column_list",
    )


@query
def typed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = items.typed_lists(collect_mapping(inputs.mapping(spark, sf_dir)))
    return lists.joined_lists(lists.padded_lists(typed, 0))


@query
def padded_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = items.typed_lists(collect_mapping(inputs.mapping(spark, sf_dir)))
    return lists.joined_lists(lists.padded_lists(typed, 3))


@query
def last_mapping_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = items.bind_items(items.last_item_wins(items.entry_items(active(spark, sf_dir))))
    return entries.select(
        "config_id",
        F.col("slot").alias("transform_data_type"),
        F.col("name").alias("target_column_name"),
        "pos",
        F.col("text").alias("expression"),
    )


@query
def joined_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = inputs.mapping(spark, sf_dir)
    configurations = active(spark, sf_dir).select("config_id").distinct()
    joined = lists.laid_out_lists(source_entries(mapping), ",")
    return lists.pad_joined(configurations.join(joined, "config_id", "left"), 5, ",")


@query
def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = inputs.two_batches(spark, sf_dir)
    return log.high_water_mark()


@query
def mapping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.mapping_counts(active(spark, sf_dir))


@query
def single_source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.single_source_table(active(spark, sf_dir))


# --- join, concatenation


@query
def attach_source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    attached = columns.attach_source_table(active(spark, sf_dir), inputs.config(spark, sf_dir))
    return attached.select("config_id", "custom_column_mapping_id", "source_table", "table_reject")


@query
def source_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    collected = collect_mapping(inputs.mapping(spark, sf_dir))
    listed = columns.source_columns(order="mapping", style="none")
    return collected.select("config_id", F.array_join(listed, ", ").alias("source_columns"))


# --- components and enrichment


@query
def explode_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cw.explode_components(inputs.packages(spark, sf_dir)).drop("ssis_file_path")


@query
def explode_encoded_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cw.read_package_bytes(spark, inputs.package_folder(spark, sf_dir, encoded=True))
    return cw.explode_components(files).drop("ssis_file_path")


@query
def component_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cw.component_rejects(inputs.packages(spark, sf_dir, cut=True)).drop("ssis_file_path")


@query
def enrich_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = inputs.table(spark, sf_dir, "conversations")
    rendered = enrich.render_prompts(turns, "text", "Digest this", "You digest.")
    tasks = spark.sparkContext.defaultParallelism
    spread = enrich.spread(rendered, tasks, "conv_id", "turn")
    return cw.enrich_rows(spread, inputs.digest).select("conv_id", "turn", "response", "error")


# --- composite operators


@query
def compile_source_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cw.compile_source_query(inputs.mapping(spark, sf_dir), inputs.config(spark, sf_dir))


@query
def compile_mapping_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cw.compile_mapping_arrays(inputs.mapping(spark, sf_dir), inputs.config(spark, sf_dir))


@query
def mapping_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cw.mapping_rejects(inputs.mapping(spark, sf_dir), inputs.config(spark, sf_dir))


@query
def apply_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cw.apply_mapping(inputs.lineitem_mapping(spark), inputs.source(spark, sf_dir), 1))


def shown(applied: DataFrame) -> DataFrame:
    """Times as text and numbers as plain ones, to be compared."""
    return applied.withColumns(
        {
            "l_shipdate": F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"),
            "ship_day": F.date_format("ship_day", "yyyy-MM-dd"),
            "ship_hour": F.date_format("ship_hour", "yyyy-MM-dd HH:mm"),
            "net_price": F.col("net_price").cast("decimal(18,2)").cast("double"),
            "whole_quantity": F.col("whole_quantity").cast("bigint"),
        }
    )


@query
def apply_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = cw.apply_mappings(inputs.lineitem_mappings(spark), inputs.source(spark, sf_dir), [1, 2, 3])
    return shown(applied).withColumn("line", F.col("line").cast("bigint"))


@query
def convert_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = cw.ConversionLog(spark, staging_path(spark))
    inputs.converted(spark, sf_dir, log)
    return log.read().drop("ssis_file_path")


@query
def convert_without_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.converted(spark, sf_dir, None).appended.drop("ssis_file_path")


@query
def convert_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.converted(spark, sf_dir, None).failures.drop("ssis_file_path")


@query
def convert_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.converted(spark, sf_dir, None, cut=True).rejects.drop("ssis_file_path")


@query
def retry_conversion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.retried(spark, sf_dir).read()


@query
def compile_from_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cw.compile_mapping_arrays(inputs.mapping(spark, sf_dir))


@query
def mapping_rejects_from_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cw.mapping_rejects(inputs.mapping(spark, sf_dir))


@query
def mapping_rejects_of_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cw.mapping_rejects(inputs.faulty_mapping(spark, sf_dir))


@query
def compile_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    csv = cw.read_mapping_csv(spark, written_csv(spark, sf_dir), position="place")
    return cw.compile_mapping_arrays(cw.mapping_of_csv(csv, position="place"), key="source")
