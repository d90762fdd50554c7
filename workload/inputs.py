"""Mapping, config, packages and source, each a projection of the given tables (FIXTURES.md)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from colweave.operators.columns import ordered_text
from colweave.operators.enrich import conversion_rows
from colweave.plans.convert import Conversion, convert_packages
from colweave.schemas import MAPPING
from colweave.sources.log import ConversionLog
from colweave.sources.packages import read_packages
from colweave.sources.staging import scratch_folder, stage, staging_path

NAMESPACE = "www.microsoft.com/SqlServer/Dts"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping rows from ``lineitem``. Ids come from the key columns, so no window is needed."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as config_id",
        "l_linenumber * 100000000000000000 + (l_partkey % 10000000000) * 10000000"
        " + l_suppkey % 10000000 as custom_column_mapping_id",
        "concat('db', l_orderkey % 3) as source_database_name",
        "'s' as source_schema_name",
        "concat('t_', l_orderkey % 100, if(l_partkey % 29 = 0, '_b', '')) as source_table_name",
        "concat('C', l_partkey % 50) as source_column_name",
        "concat('T', l_suppkey % 20) as target_column_name",
        "cast(l_quantity > 5 as int) as active_ind",
        "case when l_partkey % 17 = 0 then null when l_linestatus = 'O' then 1 else 0 end"
        " as derived_ind",
        "case when l_returnflag = 'N' then null else l_suppkey end as transformation_function_id",
        "case l_linenumber % 3 when 0 then 'f(i0,i1,i10)' when 1 then 'g(i2,i1)' else 'trim(i0)' end"
        " as transformation_function_def",
        "case when l_partkey % 13 = 0 then null else concat('i2|', l_partkey) end"
        " as transformation_parameter_text",
        "case l_linenumber when 1 then 'BOOLEAN' when 2 then 'date' when 3 then 'DateTime'"
        " when 4 then 'Bit' when 5 then 'decimal' when 6 then 'string' else 'geo' end"
        " as transform_func_data_type",
    )


def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Config rows from ``orders``."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as config_id",
        "cast(o_orderkey % 11 <> 0 as int) as active_ind",
        "concat('db', o_custkey % 3) as source_database_name",
        "lower(o_orderstatus) as source_schema_name",
        "concat('t_', o_custkey) as source_table_name",
    )


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a raw source table with its audit column."""
    return table(spark, sf_dir, "lineitem").withColumn(
        "AUDIT_ACTIVE_ROW_IND", F.expr("if(l_linestatus = 'O', 'Y', 'N')")
    )


@cache
def packages(
    spark: SparkSession, sf_dir: str, key: str = "l_orderkey", cut: bool = False
) -> DataFrame:
    """One XML document per order or supplier, two nested components per line of it.

    With ``cut`` the text of every 97th document is cut off, so it is no XML. A document is one
    value, as it is one file in a folder of packages. Made once in a session.
    """
    lines = table(spark, sf_dir, "lineitem")
    element = F.expr(
        "concat('<D:Executable n=\"', l_linenumber, '\" p=\"', l_partkey,"
        " '\"><D:Executable s=\"', l_suppkey, '\"/></D:Executable>')"
    )
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    whole = ordered_text(lines, key, order, element, "", "body")
    document = whole.select(
        key,
        F.concat(
            F.lit(f'<D:Executable xmlns:D="{NAMESPACE}">'), F.col("body"), F.lit("</D:Executable>")
        ).alias("document"),
    )
    short = F.expr("substring(document, 1, length(document) - 5)")
    content = F.when(F.col(key) % 97 == 0, short).otherwise(F.col("document")) if cut else F.col("document")
    made = document.select(
        F.lit("packages").alias("ssis_file_path"),
        F.concat(F.lit("pkg_"), F.col(key)).alias("ssis_file_name"),
        content.alias("content"),
    )
    return stage(made)


FOLDER = "batch 1+"


@cache
def package_folder(spark: SparkSession, sf_dir: str, cut: bool = False, encoded: bool = False) -> str:
    """The packages by supplier as files, in a folder and under names with signs; gives its parent.

    With ``encoded`` two of three files are in UTF-16 or Latin-1, as they declare. Made once in a session.
    """
    root = scratch_folder(spark, "packages")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root))
        system.create_dir(f"{path}/{FOLDER}", recursive=True)
        for batch in batches:
            for name, content in zip(batch["ssis_file_name"], batch["content"]):
                encoding = ("utf-8", "utf-16", "iso-8859-1")[len(content) % 3] if encoded else "utf-8"
                if encoding != "utf-8":
                    content = f'<?xml version="1.0" encoding="{encoding}"?>{content}'
                with system.open_output_stream(f"{path}/{FOLDER}/{name} 50%.dtsx") as file:
                    file.write(content.encode(encoding))
            yield batch[["ssis_file_name"]]

    rows = packages(spark, sf_dir, "l_suppkey", cut).select("ssis_file_name", "content")
    rows.mapInPandas(write, "ssis_file_name string").count()
    return root


def converted(spark: SparkSession, sf_dir: str, log: ConversionLog | None, cut: bool = False) -> Conversion:
    """The packages by supplier, converted by ``digest``."""
    return convert_packages(
        read_packages(spark, package_folder(spark, sf_dir, cut)),
        digest,
        log,
        api_provider="local",
        model_name="digest",
        prompt_prefix="Digest this",
        system_prompt="You digest.",
        partitions=spark.sparkContext.defaultParallelism,
    )


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows from ``documents``, with ``doc_id`` to order and split them by."""
    response = F.expr("concat(length(text), ':', md5(text))")
    return conversion_rows(
        table(spark, sf_dir, "documents"),
        api_provider="local",
        model_name="digest",
        system_prompt="You digest.",
        prompt_prefix="Digest this",
        file_path=F.lit("documents"),
        file_name="source",
        component="text",
        response=response,
        carry=("doc_id",),
    )


LOG_ORDER = ("ssis_file_path", "ssis_file_name", "doc_id")


def two_batches(spark: SparkSession, sf_dir: str) -> tuple[ConversionLog, int]:
    """A new log with the even and then the odd documents, and the mark between them."""
    log = ConversionLog(spark, staging_path(spark))
    rows = log_rows(spark, sf_dir)
    log.append(rows.filter("doc_id % 2 = 0"), LOG_ORDER)
    mark = log.max_id()
    log.append(rows.filter("doc_id % 2 = 1"), LOG_ORDER)
    return log, mark


def retried(spark: SparkSession, sf_dir: str) -> ConversionLog:
    """A log whose first run wrote every third of its rows and broke off, before another run appended
    and the first was taken up again."""
    log = ConversionLog(spark, staging_path(spark))
    rows = log_rows(spark, sf_dir)
    even, odd = rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1")
    broken = BreaksOff(spark, log.location)
    try:
        broken.append(even, LOG_ORDER, run="even")
    except ConnectionError:
        pass
    log.append(odd, LOG_ORDER, run="odd")
    log.append(even, LOG_ORDER, run="even")
    return log


class BreaksOff(ConversionLog):
    """A log whose write breaks off in the middle."""

    def _write(self, rows: DataFrame) -> DataFrame:
        super()._write(rows.filter("id % 3 = 0"))
        raise ConnectionError


def digest(prompt: str, system_prompt: str | None = None, model_name: str | None = None) -> str:
    """The local stand-in for an external call: length and digest, and now and then a failure."""
    if len(prompt) % 10 == 7:
        raise ValueError("length ends in 7")
    return f"{len(prompt)}:{hashlib.md5(prompt.encode()).hexdigest()}"


def faulty_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping with NULLs in the columns that a compile needs."""
    lost = {
        "source_column_name": "custom_column_mapping_id % 19 = 0",
        "target_column_name": "custom_column_mapping_id % 23 = 0",
        "transformation_function_def": "custom_column_mapping_id % 7 = 0",
        "source_schema_name": "config_id % 41 = 0",
    }
    return mapping(spark, sf_dir).withColumns(
        {name: F.expr(f"if({rule}, null, {name})") for name, rule in lost.items()}
    )


# Literal mapping rows of one configuration over the columns of ``source``: source column, target,
# derived, function id, definition, parameters, type.
LINEITEM_MAPPING = [
    ("l_orderkey", "l_orderkey", 0, None, None, None, None),
    ("l_linenumber", "l_linenumber", 0, None, None, None, None),
    ("l_partkey", "l_partkey", 1, None, None, None, None),
    ("l_suppkey", "is_near", 0, 1, "i0 % i1 = 0", "7", "Boolean"),
    ("l_shipdate", "ship_day", 0, 2, "date_add(cast(i0 as date), i1)", "2", "Date"),
    ("l_shipdate", "ship_hour", 0, 3, "date_trunc('i1', i0)", "HOUR", "DateTime"),
    ("l_extendedprice", "net_price", 0, 4, "cast(i0 as decimal(18,4)) * i1", "2|unused", "Decimal"),
    ("l_quantity", "whole_quantity", 0, 5, "cast(i0 as int)", "", "Bit"),
    ("l_returnflag", "flags", 0, 6, "concat(i0, 'i1', l_linestatus)", "/", "String"),
    ("NOT_THERE", "filled", 1, 7, "coalesce(i0, 'none')", None, "String"),
]


def lineitem_mapping(spark: SparkSession) -> DataFrame:
    rows = [
        (1, n, "db", "s", "lineitem", source_column, target, 1, *rest)
        for n, (source_column, target, *rest) in enumerate(LINEITEM_MAPPING, start=1)
    ]
    return spark.createDataFrame(rows, MAPPING)


# A second and a third configuration of it: the second derives a column that the source has.
OTHER_MAPPINGS = {
    2: [
        ("l_orderkey", "l_orderkey", 0, None, None, None, None),
        ("l_comment", "filled", 1, 1, "coalesce(i0, 'i1')", "hidden", "String"),
        ("l_returnflag", "flags", 1, 2, "coalesce(i0, l_linestatus)", None, "String"),
        ("l_quantity", "whole_quantity", 0, 3, "cast(i0 as int) * i1", "10", "Integer"),
    ],
    3: [
        ("l_orderkey", "l_orderkey", 0, None, None, None, None),
        ("l_linenumber", "line", 0, 1, "i0 + i1", "100", "Numeric"),
        ("l_linenumber", "flags", 0, 2, "concat('#', i0)", None, "String"),
    ],
}


def lineitem_mappings(spark: SparkSession) -> DataFrame:
    rows = [
        (config_id, n, "db", "s", "lineitem", source_column, target, 1, *rest)
        for config_id, own in OTHER_MAPPINGS.items()
        for n, (source_column, target, *rest) in enumerate(own, start=1)
    ]
    return lineitem_mapping(spark).unionByName(spark.createDataFrame(rows, MAPPING))
