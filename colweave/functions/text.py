"""Column-level text building: quoting, qualified names, projection items, prompts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

QUOTE_STYLES = ("backtick", "bracket", "none")


def quote_identifier(name: Column, style: str = "backtick") -> Column:
    """``name`` as an identifier. ``backtick`` runs on Spark; ``bracket`` and ``none`` are text."""
    if style == "backtick":
        return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))
    if style == "bracket":
        return F.concat(F.lit("["), name, F.lit("]"))
    if style == "none":
        return name
    raise ValueError(f"unknown quote style {style!r}, expected one of {QUOTE_STYLES}")


def qualified_table_name(database: Column, schema: Column, table: Column) -> Column:
    """``database.schema.table``; NULL if any part is NULL."""
    return F.concat(database, F.lit("."), schema, F.lit("."), table)


def null_cast_item(name: Column, style: str = "backtick") -> Column:
    """Projection item for a column the source lacks: a null under its name."""
    return F.concat(F.lit("cast(null as string) as "), quote_identifier(name, style))


def wrap_quotes(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def render_prompt(prefix: str, source: Column) -> Column:
    return F.concat(F.lit(prefix), F.lit(":"), source)
