"""The ten key and value lists of a configuration: split, pad, quote, join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import wrap_quotes
from ..functions.types import LOGICAL_TYPES, LogicalType
from .columns import listagg

LIST_COLUMNS = tuple(f"{kind.prefix}{part}" for kind in LOGICAL_TYPES for part in ("keys", "vals"))


def pad_keys(kind: LogicalType, size: Column, length: int) -> Column:
    """``_<prefix><n>`` for n = size + 1 ... length; empty for a list of the length or longer."""
    names = F.array(*[F.lit(f"_{kind.prefix}{n}") for n in range(1, length + 1)]).cast("array<string>")
    return F.slice(names, size + 1, F.lit(length))


def pad_values(kind: LogicalType, size: Column, length: int) -> Column:
    return F.array_repeat(F.lit(kind.null_text), F.lit(length) - size)


def padded_lists(lists: DataFrame, length: int, *carry: str) -> DataFrame:
    """Ten string arrays per configuration, each at least ``length`` long, none ever cut."""
    columns = []
    for kind in LOGICAL_TYPES:
        size = F.size(kind.name)
        keys = F.transform(kind.name, lambda entry: entry["name"])
        values = F.transform(kind.name, lambda entry: entry["text"])
        columns.append(F.concat(keys, pad_keys(kind, size, length)).alias(f"{kind.prefix}keys"))
        columns.append(F.concat(values, pad_values(kind, size, length)).alias(f"{kind.prefix}vals"))
    return lists.select("config_id", *carry, *columns)


def quoted_lists(padded: DataFrame) -> DataFrame:
    """Every element of the ten arrays in double quotes."""
    return padded.withColumns({name: F.transform(name, wrap_quotes) for name in LIST_COLUMNS})


def joined_lists(padded: DataFrame, sep: str = ";") -> DataFrame:
    """The ten arrays as text. A NULL element counts as empty, so keys and values stay in step."""
    return padded.withColumns({name: F.array_join(name, sep, "") for name in LIST_COLUMNS})


def laid_out_lists(entries: DataFrame, sep: str = ";", quote: bool = False) -> DataFrame:
    """The ten joined lists of each configuration from its entries as rows, with the size of each pair.

    Entries ``(config_id, slot, pos, name, text)`` are laid out over ranges in the order of the lists,
    each partition joins what it holds of a list, and the parts are joined in the order of the
    partitions. A configuration of very many entries is so cut by their number, and no array holds
    them. A list without entries is NULL; ``pad_joined`` fills it.
    """
    order = ("pos", "name", "text")
    shown = lambda name: wrap_quotes(F.col(name)) if quote else F.col(name)
    laid = entries.repartitionByRange("config_id", "slot", "pos", "name").select(
        "config_id",
        "slot",
        *order,
        shown("name").alias("key"),
        F.coalesce(shown("text"), F.lit("")).alias("val"),
        F.spark_partition_id().alias("_part"),
    )
    parts = laid.groupBy("config_id", "slot", "_part").agg(
        F.count("*").cast("int").alias("n"),
        *(F.expr(listagg(name, sep, ", ".join(order))).alias(f"{name}s") for name in ("key", "val")),
    )
    columns = []
    for kind in LOGICAL_TYPES:
        own = f"slot = '{kind.name}'"
        columns.append(F.expr(f"sum(if({own}, n, 0))").cast("int").alias(f"{kind.prefix}size"))
        for name in ("keys", "vals"):
            columns.append(F.expr(listagg(f"if({own}, {name}, null)", sep, "_part")).alias(f"{kind.prefix}{name}"))
    return parts.groupBy("config_id").agg(*columns)


def pad_joined(joined: DataFrame, length: int, sep: str = ";", quote: bool = False) -> DataFrame:
    """Lists that are joined already, each filled up to ``length``; sizes go, other columns stay."""
    columns = {}
    for kind in LOGICAL_TYPES:
        size = F.coalesce(f"{kind.prefix}size", F.lit(0))
        for name, pads in (("keys", pad_keys(kind, size, length)), ("vals", pad_values(kind, size, length))):
            filler = F.transform(pads, wrap_quotes) if quote else pads
            whole = F.array_compact(F.array(f"{kind.prefix}{name}"))
            columns[f"{kind.prefix}{name}"] = F.array_join(F.concat(whole, filler), sep)
    return joined.withColumns(columns).drop(*(f"{kind.prefix}size" for kind in LOGICAL_TYPES))
