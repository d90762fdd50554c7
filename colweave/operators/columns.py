"""Per-configuration operators over source columns and source tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import null_cast_item, quote_identifier
from .items import DERIVED, RAW, items_of
from .rows import is_derived, is_raw, is_transformed, source_table

ORDERS = ("name", "mapping")


def distinct_columns(active: DataFrame) -> DataFrame:
    """Sorted distinct raw and derived column names per configuration."""
    distinct = (
        active.filter(is_raw() | is_derived())
        .groupBy("config_id", F.col("source_column_name").alias("name"))
        .agg(F.bool_or(is_raw()).alias("raw"), F.bool_or(is_derived()).alias("derived"))
    )
    names = lambda flag: F.sort_array(F.collect_list(F.when(F.col(flag), F.col("name"))))
    return distinct.groupBy("config_id").agg(
        names("raw").alias("raw_columns"), names("derived").alias("derived_columns")
    )


def ordered_text(
    rows: DataFrame, by: str, order: Sequence[str], item: Column, sep: str, alias: str
) -> DataFrame:
    """Text of all items of a group in the order of the ``order`` columns, duplicates kept.

    Rows are exchanged once, without their items, and the text of a group is made in one pass over the
    sorted partition that holds it; no text is exchanged. Groups that hold more rows than a task should
    get are counted when the plan is made. Those alone are laid out over ranges of group and order and so
    cut by their number, their text is made in each partition that holds some of it, and the finished texts
    are joined in the order of the partitions.
    """
    found = hot_groups(rows, by)
    named = [value for value in found if value is not None]
    is_hot = F.col(by).isin(named) if named else F.lit(False)
    is_hot = F.col(by).isNull() | is_hot if None in found else F.col(by).isNotNull() & is_hot
    keys = (by, *order, item)
    sorted_rows = lambda laid: laid.sortWithinPartitions(*keys).select(by, item.alias("_item"))
    schema = T.StructType(
        [rows.schema[by], T.StructField("_part", T.LongType()), T.StructField("_text", T.StringType())]
    )
    few = sorted_rows((rows.filter(~is_hot) if found else rows).repartition(by))
    whole = few.mapInArrow(partial(_run_texts, sep=sep, whole=True), schema).select(by, F.col("_text").alias(alias))
    if not found:
        return whole
    many = sorted_rows(rows.filter(is_hot).repartitionByRange(*keys))
    parts = many.mapInArrow(partial(_run_texts, sep=sep, whole=False), schema)
    return whole.unionByName(parts.groupBy(by).agg(F.expr(listagg("_text", sep, "_part")).alias(alias)))


def _run_texts(batches: Iterator[pa.RecordBatch], sep: str, whole: bool) -> Iterator[pa.RecordBatch]:
    """The joined texts of the runs of equal keys, NULL where all are.

    A run that goes on in the next batch is kept until it ends if they are to be ``whole``; otherwise it
    is given out with each batch, numbered in the order of partitions and batches.
    """
    first = TaskContext.get().partitionId() << 33
    kept_key, kept = None, []  # the run at the end of what was read

    def closed() -> list[tuple]:
        texts = [text for text in kept if text is not None]
        return [(kept_key, sep.join(texts) if texts else None)] if kept else []

    for number, batch in enumerate(batches):
        if not batch.num_rows:
            continue
        keys, texts = _joined_runs(*batch.columns, sep)
        if whole:
            before = []
            if kept and keys[0].as_py() != kept_key:
                before, kept = closed(), []
            kept.append(texts[0].as_py())
            kept_key = keys[0].as_py()
            if len(keys) > 1:
                before += closed()
                kept_key, kept = keys[-1].as_py(), [texts[-1].as_py()]
            keys = pa.concat_arrays([pa.array([key for key, _ in before], keys.type), keys[1:-1]])
            texts = pa.concat_arrays([pa.array([text for _, text in before], pa.string()), texts[1:-1]])
        yield _parts(batch.schema, keys, first + number, texts)
    if whole and kept:
        ((key, text),) = closed()
        yield _parts(batch.schema, pa.array([key], batch.schema.types[0]), first, pa.array([text], pa.string()))


def _joined_runs(keys: pa.Array, items: pa.Array, sep: str) -> tuple[pa.Array, pa.Array]:
    runs = pc.run_end_encode(keys)
    ends = np.asarray(runs.run_ends)
    before = np.concatenate([[0], np.cumsum(items.is_valid().to_numpy(zero_copy_only=False))])
    starts = before[np.concatenate([[0], ends])].astype(np.int32)  # among those that are not NULL
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), items.drop_null()), sep)
    return runs.values, pc.if_else(pa.array(np.diff(starts) > 0), joined, pa.scalar(None, pa.string()))


def _parts(schema: pa.Schema, keys: pa.Array, part: int, texts: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(np.full(len(keys), part, np.int64)), texts], names=[schema.names[0], "_part", "_text"]
    )


def listagg(item: str, sep: str, order: str) -> str:
    quoted = sep.replace("\\", "\\\\").replace("'", "\\'")
    return f"listagg({item}, '{quoted}') within group (order by {order})"


def source_columns(order: str = "name", style: str = "backtick") -> Column:
    """Raw items, then null casts for the derived ones, of a frame with an ``items`` column."""
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}, expected one of {ORDERS}")
    lead = "pos" if order == "mapping" else "name"
    raw = F.transform(items_of(RAW, lead), lambda item: quote_identifier(item["name"], style))
    derived = F.transform(items_of(DERIVED, lead), lambda item: null_cast_item(item["name"], style))
    return F.concat(raw, derived)


def mapping_counts(active: DataFrame) -> DataFrame:
    """Selected rows per configuration, and how many of them are raw, derived, transformed."""
    return active.groupBy("config_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if(is_raw()).alias("n_raw"),
        F.count_if(is_derived()).alias("n_derived"),
        F.count_if(is_transformed()).alias("n_transformed"),
    )


def single_source_table(rows: DataFrame) -> DataFrame:
    """The source table of each configuration: NULL unless its rows name exactly one."""
    names = rows.select("config_id", source_table().alias("name")).distinct()
    one = names.groupBy("config_id").agg(F.count("name").alias("n_tables"), F.min("name").alias("name"))
    return one.select(
        "config_id", "n_tables", F.when(F.col("n_tables") == 1, F.col("name")).alias("source_table")
    )


def table_of(least: Column, greatest: Column, unnamed: Column) -> tuple[Column, Column]:
    """The one table between the least and the greatest name, and why there is none.

    One name or several shows in the two, so one exchange does, where counting distinct names would
    need two. A row with a NULL part of its name is a reason of its own.
    """
    many = least != greatest
    reject = F.when(unnamed, "null_table_name").when(many, "many_source_tables")
    return F.when(~unnamed & ~many, least), reject


def config_tables(config: DataFrame) -> DataFrame:
    """One row per configuration of the config table: its table, or why it has none."""
    name = source_table()
    names = (
        config.filter(F.col("active_ind") == 1)
        .groupBy("config_id")
        .agg(
            F.min(name).alias("least"),
            F.max(name).alias("greatest"),
            F.bool_or(name.isNull()).alias("unnamed"),
        )
    )
    table, reject = table_of(F.col("least"), F.col("greatest"), F.col("unnamed"))
    return names.select("config_id", table.alias("source_table"), reject.alias("table_reject"))


#: At most so many configurations are looked for, and so many counters kept for each of them.
HOT, COUNTERS = 1_000, 100


def hot_configurations(rows: DataFrame) -> list[int]:
    """The configurations that hold more rows than a task should get, see ``hot_groups``."""
    return [config_id for config_id in hot_groups(rows, "config_id") if config_id is not None]


def hot_groups(rows: DataFrame, by: str) -> list:
    """The values of ``by`` that hold more rows than a task should get, found by one pass over them; None first.

    That share is one of ``spark.sql.shuffle.partitions``, so there are no more of them than of those,
    and at most ``HOT``. A frequent-items sketch of a fixed size, merged from the tasks, counts them: with
    ``COUNTERS`` for each none of that share is missed.
    """
    most = max(1, min(HOT, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sketch = F.expr(f"approx_top_k(`{by}`, {most}, {most * COUNTERS})")
    found = rows.agg(
        sketch.alias("frequent"), F.count(by).alias("n"), F.count_if(F.col(by).isNull()).alias("unnamed")
    ).first()
    frequent = (item for item in found["frequent"] or () if item["item"] is not None)
    named = sorted(item["item"] for item in frequent if item["count"] * most >= found["n"])
    return [None, *named] if found["unnamed"] * most > found["n"] + found["unnamed"] else named


def attach_source_table(
    rows: DataFrame,
    config: DataFrame,
    spread_by: str = "custom_column_mapping_id",
    salts: int = 8,
) -> DataFrame:
    """Each row with the table of its configuration and, if there is none, the reason.

    The config table grows with the configurations, so both sides are exchanged. The rows of a hot
    configuration are exchanged under a salt too, taken from ``spread_by``, and its config row is
    copied for each; all other config rows are exchanged once. Adaptive execution can split what is
    left of skew, and with one salt all of it. The hot ones are counted when the plan is made.
    """
    tables = config_tables(config)
    hot = hot_configurations(rows) if salts > 1 else None
    if hot == []:
        return _with_reject(rows.join(tables.hint("merge"), "config_id", "left"))
    is_hot = F.lit(True) if hot is None else F.col("config_id").isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    every = tables.withColumn("_salt", F.explode(copies))
    joined = rows.withColumn("_salt", salt).join(every.hint("merge"), ["config_id", "_salt"], "left")
    return _with_reject(joined.drop("_salt"))


def join_tables(per_config: DataFrame, config: DataFrame, salt: str | None = None) -> DataFrame:
    """The same for a frame with one row per configuration, laid out by ``config_id`` already.

    With a ``salt`` column the rows of salt 0 are those; others find no table and are spread by it.

    The merge join uses that layout and exchanges the config rows alone. Its hint keeps the
    optimizer from a broadcast by the size of the files, which says little of the rows in them.
    """
    tables = config_tables(config)
    keys = ["config_id"]
    if salt is not None:
        tables, keys = tables.withColumn(salt, F.lit(0)), ["config_id", salt]
    return _with_reject(per_config.join(tables.hint("merge"), keys, "left"))


def _with_reject(joined: DataFrame) -> DataFrame:
    reason = F.when(
        F.col("source_table").isNull(), F.coalesce(F.col("table_reject"), F.lit("no_config"))
    )
    return joined.withColumn("table_reject", reason)

