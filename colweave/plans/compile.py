"""Compile mappings: source query and typed lists of every configuration, and what was left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.columns import join_tables, source_columns, table_of
from ..operators.items import (
    DERIVED,
    KEYS,
    RAW,
    TABLE,
    all_items,
    bind_items,
    collect_items,
    column_items,
    entry_items,
    last_item_wins,
    typed_lists,
)
from ..operators.lists import (
    LIST_COLUMNS,
    joined_lists,
    laid_out_lists,
    pad_joined,
    padded_lists,
    quoted_lists,
)
from ..operators.rows import (
    ACTIVE_ROW_COLUMN,
    active_mapping,
    reject_reason,
    source_table,
)
from ..schemas import MAPPING, SOURCE_CONFIG, conform

DEFAULT_LENGTH = 8
RECORD_COLUMNS = (
    "config_id",
    "source_query",
    *LIST_COLUMNS,
)


def compile_source_query(
    mapping: DataFrame,
    config: DataFrame | None = None,
    config_id: int | None = None,
    order: str = "name",
    style: str = "backtick",
) -> DataFrame:
    """``(config_id, source_query)`` for every configuration with an active mapping row.

    The query is NULL for a configuration without columns, or without exactly one source table.
    Without a config table the mapping rows name the source table themselves.
    """
    active = _active(mapping, config_id)
    collected = collect_items(bind_items(last_item_wins(column_items(active, config is None))))
    return _with_source_query(collected, config, config_id, order, style).select(
        "config_id", "source_query"
    )


def compile_mapping_arrays(
    mapping: DataFrame,
    config: DataFrame | None = None,
    config_id: int | None = None,
    return_length: int = DEFAULT_LENGTH,
    *,
    key: str = "target",
    order: str = "name",
    style: str = "backtick",
    sep: str = ";",
    quote: bool = False,
) -> DataFrame:
    """The compiled record, one row per configuration with an active mapping row.

    ``key="source"`` names entries by source column and keeps every one of them, however many, in
    lists that are joined part by part; with ``"target"`` the last mapping of a target and type wins.
    Without a config table the mapping rows name the source table themselves. No job runs until the
    caller asks for rows, but for a sample that places the parts of ``key="source"``.
    """
    if key not in KEYS:
        raise ValueError(f"unknown key {key!r}, expected one of {KEYS}")
    if key == "source":
        columns = column_items(_active(mapping, config_id), config is None)
        collected = collect_items(bind_items(last_item_wins(columns)))
        queries = _with_source_query(collected, config, config_id, order, style)
        lists = laid_out_lists(source_entries(mapping, config_id), sep, quote)
        # both sides are laid out by configuration; one without entries has padding alone
        met = queries.select("config_id", "source_query").join(lists.hint("merge"), "config_id", "left")
        return pad_joined(met, return_length, sep, quote).select(*RECORD_COLUMNS)
    collected = collect_mapping(mapping, config_id, tables=config is None)
    lists = typed_lists(_with_source_query(collected, config, config_id, order, style))
    padded = padded_lists(lists, return_length, "source_query")
    if quote:
        padded = quoted_lists(padded)
    return joined_lists(padded, sep).select(*RECORD_COLUMNS)


def source_entries(mapping: DataFrame, config_id: int | None = None) -> DataFrame:
    """Every usable transformation as a row named by its source column: config_id, slot, pos, name, text."""
    entries = entry_items(_active(mapping, config_id), "source")
    return bind_items(entries.withColumnRenamed("id", "pos"))


def collect_mapping(
    mapping: DataFrame,
    config_id: int | None = None,
    *,
    tables: bool = False,
    bind_style: str = "none",
) -> DataFrame:
    """One row per configuration with the items of its columns and entries, the last mapping of a target
    and type winning.

    With ``tables`` the source tables that its mapping rows name are items too. ``bind_style``
    quotes the column put in for ``i0``.
    """
    active = _active(mapping, config_id)
    return collect_items(bind_items(last_item_wins(all_items(active, tables)), bind_style))


def mapping_rejects(
    mapping: DataFrame, config: DataFrame | None = None, config_id: int | None = None
) -> DataFrame:
    """``(config_id, custom_column_mapping_id, target_column_name, reason)``.

    A row reason keeps one mapping row out of the lists. A configuration reason leaves
    ``source_query`` NULL and is given once, without a mapping id.
    """
    # one scan: a row for each rejected mapping row, and salt 0 for its configuration as a whole
    rejected = F.struct(
        F.col("custom_column_mapping_id").alias("id"),
        F.col("target_column_name").alias("target"),
        reject_reason().alias("reason"),
        (F.pmod(F.xxhash64("custom_column_mapping_id"), F.lit(8)) + 1).cast("int").alias("salt"),
    )
    whole = F.struct(
        F.lit(None).cast("bigint").alias("id"),
        F.lit(None).cast("string").alias("target"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(0).alias("salt"),
    )
    name = source_table()
    found = (
        _active(mapping, config_id)
        .select("config_id", name.alias("name"), F.inline(F.array(rejected, whole)))
        .filter("salt = 0 or reason is not null")
        .groupBy("config_id", "id", "target", "reason", "salt")
        .agg(
            F.count("*").cast("int").alias("n"),
            F.min("name").alias("least"),
            F.max("name").alias("greatest"),
            F.bool_or(F.col("name").isNull()).alias("unnamed"),
        )
    )
    if config is None:
        _, reject = table_of(F.col("least"), F.col("greatest"), F.col("unnamed"))
        told = found.withColumn("table_reject", reject)
    else:
        # row rejects have no partner here and are spread by their salt
        told = join_tables(found, _config(config, config_id), salt="salt")
    reason = F.when(F.col("salt") == 0, F.col("table_reject")).otherwise(F.col("reason"))
    times = F.when(F.col("salt") == 0, 1).otherwise(F.col("n"))
    return (
        told.select("config_id", "id", "target", reason.alias("reason"), times.alias("n"))
        .filter(F.col("reason").isNotNull())
        .select(
            "config_id",
            F.col("id").alias("custom_column_mapping_id"),
            F.col("target").alias("target_column_name"),
            "reason",
            F.explode(F.sequence(F.lit(1), "n")).alias("n"),
        )
        .drop("n")
    )


def _active(mapping: DataFrame, config_id: int | None) -> DataFrame:
    return active_mapping(conform(mapping, MAPPING, "mapping"), config_id)


def _config(config: DataFrame, config_id: int | None) -> DataFrame:
    declared = conform(config, SOURCE_CONFIG, "source config")
    return declared if config_id is None else declared.filter(F.col("config_id") == config_id)


def _with_source_query(
    collected: DataFrame, config: DataFrame | None, config_id: int | None, order: str, style: str
) -> DataFrame:
    if config is None:
        names = F.transform(
            F.filter("items", lambda item: item["slot"] == TABLE), lambda item: item["name"]
        )
        unnamed = F.exists(names, lambda name: name.isNull())
        table, reject = table_of(F.array_min(names), F.array_max(names), unnamed)
        tabled = collected.withColumns({"source_table": table, "table_reject": reject})
    else:
        tabled = join_tables(collected, _config(config, config_id))
    text = F.concat(
        F.lit("select "),
        F.array_join(source_columns(order, style), ", "),
        F.lit(" from "),
        F.col("source_table"),
        F.lit(f" WHERE {ACTIVE_ROW_COLUMN}='Y'"),
    )
    has_columns = F.exists("items", lambda item: item["slot"].isin(RAW, DERIVED))
    return tabled.withColumn("source_query", F.when(has_columns, text))
