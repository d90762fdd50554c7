"""Columns and row forms that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, the only kind that separates words here; fixed values.
SPACE = r"[\x20\x09-\x0D]"
NO_SPACE = r"[^\x20\x09-\x0D]"


def whole_text(column: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Only A-Z change, unlike ``lower``."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space, in order; none for a blank text."""
    pieces = F.split(text, SPACE + "+", -1)
    return F.filter(pieces, lambda piece: piece != "")


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``: the fold of a row. A null id is in none."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus
