"""Required columns: counting, splitting off and refusing rows that lack one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import CONVERSION_ROW, required_columns

LOG_REQUIRED = tuple(required_columns(CONVERSION_ROW))


def log_violations(rows: DataFrame, required: Sequence[str] = LOG_REQUIRED) -> DataFrame:
    """``(violated_column, n_rows)`` for every required column that is NULL in some row."""
    counts = rows.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in required])
    pairs = F.array(
        *[F.struct(F.lit(name).alias("violated_column"), F.col(name).alias("n_rows")) for name in required]
    )
    return counts.select(F.inline(pairs)).filter("n_rows > 0")


def violated_columns(required: Sequence[str] = LOG_REQUIRED) -> Column:
    """The names of the required columns that are NULL in a row."""
    return F.array_compact(F.array(*[F.when(F.col(name).isNull(), name) for name in required]))


def split_violations(
    rows: DataFrame, required: Sequence[str] = LOG_REQUIRED
) -> tuple[DataFrame, DataFrame]:
    """Complete rows, and the others with ``violated_columns``."""
    marked = rows.withColumn("violated_columns", violated_columns(required))
    complete = F.size("violated_columns") == 0
    return marked.filter(complete).drop("violated_columns"), marked.filter(~complete)


def refuse_violations(rows: DataFrame, required: Sequence[str] = LOG_REQUIRED) -> DataFrame:
    """The same rows; the job that computes one without a required column fails, naming it."""
    checked = {
        name: F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} must not be NULL"))).otherwise(
            F.col(name)
        )
        for name in required
    }
    return rows.withColumns(checked)
