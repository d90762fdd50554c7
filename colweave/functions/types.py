"""The five logical types: name normalisation, pad names, typed nulls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class LogicalType:
    name: str
    prefix: str  # of the output list columns and of the pad names
    null_text: str
    sql_type: str


# The types, their prefixes, their null texts and the Spark types they run as.
LOGICAL_TYPES = (
    LogicalType("Boolean", "b", "toBoolean(null())", "boolean"),
    LogicalType("Date", "d", "toDate(null())", "date"),
    LogicalType("Timestamp", "dt", "toTimestamp(null())", "timestamp"),
    LogicalType("Numeric", "n", "toDecimal(null())", "decimal(38,18)"),
    LogicalType("String", "s", "toString(null())", "string"),
)
TYPE_NAMES = tuple(kind.name for kind in LOGICAL_TYPES)

# Names (in initcap form) that stand for another type.
NUMERIC_NAMES = ("Numeric", "Bit", "Decimal", "Integer")
TIMESTAMP_NAMES = ("Timestamp", "Datetime")


def normalize_type(name: Column) -> Column:
    """One of the five type names, or the initcap form of an unknown one."""
    folded = F.initcap(name)
    return (
        F.when(folded.isin(*NUMERIC_NAMES), "Numeric")
        .when(folded.isin(*TIMESTAMP_NAMES), "Timestamp")
        .otherwise(folded)
    )


def is_known_type(normalized: Column) -> Column:
    """True or False, never NULL: an absent type is not a known one."""
    return F.coalesce(normalized.isin(*TYPE_NAMES), F.lit(False))


def null_text(normalized: Column) -> Column:
    """The text that stands for a null of the type; NULL for an unknown type."""
    texts = F.create_map(*[F.lit(v) for kind in LOGICAL_TYPES for v in (kind.name, kind.null_text)])
    return F.element_at(texts, normalized)


def typed_null(kind: LogicalType) -> Column:
    """The executable form of the same null."""
    return F.lit(None).cast(kind.sql_type)
