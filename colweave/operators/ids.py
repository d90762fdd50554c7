"""Dense increasing ids over a distributed frame, without a global window.

``lay_out`` puts rows in order over range partitions and marks each with its partition and place;
the marked rows are written once; ``ids_of`` reads the marks alone, counts them per partition and
adds what lies before. The order key takes part in the ranges, so a file with very many
components is cut over partitions like any other stretch of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage

MARK = "_mark"
PLACE_BITS = 33  # monotonically_increasing_id: partition above, place within it below


def lay_out(
    rows: DataFrame,
    *order: str,
    partitions: int | None = None,
    opened: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``rows`` in order over range partitions, with a mark for ``ids_of``.

    ``opened`` makes several rows of each, such as those of an array, once they lie in order.
    """
    ranges = (partitions, *order) if partitions else order
    laid = rows.repartitionByRange(*ranges).sortWithinPartitions(*order)
    return (opened(laid) if opened else laid).withColumn(MARK, F.monotonically_increasing_id())


def ids_of(marked: DataFrame, after: int | Column = 0, id_column: str = "id") -> DataFrame:
    """The rows of a written ``lay_out`` with ids ``after`` + 1, + 2, ... in its order."""
    partition = F.shiftright(F.col(MARK), PLACE_BITS)
    place = F.col(MARK) - F.shiftleft(partition, PLACE_BITS)
    sizes = marked.groupBy(partition.alias("_partition")).agg(F.count("*").alias("_rows"))
    # one row per partition of the layout, so this window and the broadcast are small by nature
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_partition", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    start = F.lit(after).cast("bigint") if isinstance(after, int) else after
    return (
        marked.withColumn("_partition", partition)
        .join(F.broadcast(offsets), "_partition")
        .withColumn(id_column, start + F.col("_before") + place + 1)
        .drop("_partition", "_before", MARK)
    )


def allocate_ids(rows: DataFrame, *order: str, after: int = 0, id_column: str = "id") -> DataFrame:
    """``rows`` with dense ids in the given order, first ``after`` + 1.

    Finding the ranges computes ``rows`` once more, so rows that are costly to compute should be
    staged before.
    """
    return ids_of(stage(lay_out(rows, *order)), after, id_column)
