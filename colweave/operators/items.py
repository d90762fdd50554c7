"""Mapping rows as items, reduced per configuration in one pass.

A mapping row adds to at most two lists of its configuration: the columns of the source query (raw
or derived) and the entries of one type. Both are written as items of one frame, so a compile reads
the mapping once and needs two exchanges:

1. by ``(config_id, slot, name)``: repeated columns and superseded entries go, most of them before
   the exchange. A configuration with very many rows is spread over all tasks here.
2. by ``config_id``: what is left, one item per distinct column or target of the configuration.

Placeholders are bound between the two, on the rows that are kept only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import bind_parameters
from ..functions.text import quote_identifier
from ..functions.types import TYPE_NAMES, normalize_type
from .rows import is_derived, is_raw, is_transformed, reject_reason, source_table

RAW, DERIVED, NEITHER, TABLE = "raw", "derived", "neither", "table"
KEYS = ("target", "source")


def _item(slot: Column, name: Column, *text_parts: Column) -> Column:
    definition, source_column, parameters = text_parts or [F.lit(None).cast("string")] * 3
    return F.struct(
        slot.alias("slot"),
        name.alias("name"),
        F.col("custom_column_mapping_id").alias("id"),
        definition.alias("definition"),
        source_column.alias("source_column"),
        parameters.alias("parameters"),
    )


def _column_item() -> Column:
    """Item of the source query; a row that is neither raw nor derived only marks its configuration."""
    named = F.col("source_column_name").isNotNull()
    slot = F.when(is_raw() & named, RAW).when(is_derived() & named, DERIVED).otherwise(NEITHER)
    return _item(slot, F.when(slot != NEITHER, F.col("source_column_name")))


def _entry_item(key: str) -> Column:
    """Item of a typed list; slot NULL for a row without a usable transformation."""
    if key not in KEYS:
        raise ValueError(f"unknown key {key!r}, expected one of {KEYS}")
    usable = is_transformed() & reject_reason().isNull()
    return _item(
        F.when(usable, normalize_type(F.col("transform_func_data_type"))),
        F.col(f"{key}_column_name"),
        F.col("transformation_function_def"),
        F.col("source_column_name"),
        F.col("transformation_parameter_text"),
    )


def _table_item() -> Column:
    """Item of the source table that the row names; the name is NULL where a part of it is."""
    return _item(F.lit(TABLE), source_table())


def column_items(active: DataFrame, tables: bool = False) -> DataFrame:
    """Column items, and with ``tables`` those of the source tables, of one scan."""
    found = [_column_item(), *([_table_item()] if tables else [])]
    return active.select("config_id", F.inline(F.array(*found)))


def entry_items(active: DataFrame, key: str = "target") -> DataFrame:
    return active.select("config_id", F.inline(F.array(_entry_item(key)))).filter("slot is not null")


def all_items(active: DataFrame, tables: bool = False) -> DataFrame:
    """Column and entry items, and with ``tables`` those of the source tables, of one scan."""
    found = [_column_item(), _entry_item("target"), *([_table_item()] if tables else [])]
    return active.select("config_id", F.inline(F.array(*found))).filter("slot is not null")


def last_item_wins(items: DataFrame) -> DataFrame:
    """One row per (configuration, slot, name): the first id as position, the text of the last.

    Rows that share an id are told apart by their texts, so the result never depends on the order
    in which rows arrive.
    """
    last = F.max(F.struct("id", "definition", "source_column", "parameters")).alias("last")
    reduced = items.groupBy("config_id", "slot", "name").agg(F.min("id").alias("pos"), last)
    return reduced.select("config_id", "slot", "name", "pos", "last.*").drop("id")


def bind_items(items: DataFrame, style: str = "none") -> DataFrame:
    """Items with their text in place of its parts; ``style`` quotes what is put in for ``i0``."""
    text = bind_parameters(
        F.col("definition"), quote_identifier(F.col("source_column"), style), F.col("parameters")
    )
    return items.select("config_id", "slot", "name", "pos", text.alias("text"))


def collect_items(bound: DataFrame) -> DataFrame:
    """One row per configuration with its items.

    The rows are distinct by now, so a partial list before the exchange would only be copied;
    laying them out by configuration first does without.
    """
    item = F.struct("slot", "pos", "name", "text")
    return bound.repartition("config_id").groupBy("config_id").agg(F.collect_list(item).alias("items"))


def items_of(slot: str, *order: str) -> Column:
    """The items of one slot as an array of structs led by the ``order`` fields and sorted by them."""
    fields = [*order, *(name for name in ("pos", "name", "text") if name not in order)]
    chosen = F.filter("items", lambda item: item["slot"] == slot)
    return F.sort_array(F.transform(chosen, lambda item: F.struct(*[item[f].alias(f) for f in fields])))


def typed_lists(collected: DataFrame) -> DataFrame:
    """One array of ``(pos, name, text)`` per type, in mapping order; never NULL."""
    return collected.withColumns({name: items_of(name, "pos") for name in TYPE_NAMES})
