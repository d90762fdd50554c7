"""Exact duplicates by content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .text import SPACE, whole_text


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space becomes one space;
    a null text counts as empty. Rows are grouped by the 128-bit MD5 of that form, and inside a
    hash group by the form itself, so texts that only share a hash stay apart. Grouping combines
    copies in each task before anything is shuffled; a text leaves a task once, however often it
    occurs there.

    Of equal texts the smallest id stays. A null id stays only where all ids of the group are null.
    Where several rows have both the text and the id that stays, one of them is kept. Other columns
    of ``docs`` are not read, so their names cannot clash. No rows give no rows.
    """
    form = F.regexp_replace(whole_text(text_col), SPACE + "+", " ")
    rows = docs.select(F.col(id_col).alias("_id"), form.alias("_form"))
    hashed = rows.select("_id", "_form", F.unhex(F.md5("_form")).alias("_key"))
    # staged: both sides of the join below are then plain exchanges, whose hot keys can be split
    groups = stage(
        hashed.groupBy("_key", "_form")
        .agg(F.min("_id").alias("_keep"), F.count("*").alias("_size"))
        .select("_key", F.sha2("_form", 256).alias("_sha"), "_keep", "_size")
    )
    members = (
        hashed.select("_id", "_key", F.sha2("_form", 256).alias("_sha"))
        .groupBy("_id", "_key", "_sha")
        .agg(F.count("*").cast("int").alias("_rows"))
    )
    copies = members.join(groups, ["_key", "_sha"]).select(
        "*", F.explode(F.sequence(F.lit(1), "_rows")).alias("_nth")
    )
    return copies.select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_nth") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
