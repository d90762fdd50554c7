"""Order-free comparison of two results, values as text, columns by name."""

from __future__ import annotations

import math
from collections import Counter


def _text(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def as_rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_text(row[i]) for i in order) for row in rows)


def assert_same(spark_df, duck_cursor) -> None:
    names = [column[0] for column in duck_cursor.description]
    assert sorted(spark_df.columns) == sorted(names)
    expected = as_rows(names, duck_cursor.fetchall())
    actual = as_rows(spark_df.columns, spark_df.collect())
    missing, extra = expected - actual, actual - expected
    assert not missing and not extra, (
        f"{sum(missing.values())} missing, e.g. {next(iter(missing), None)}; "
        f"{sum(extra.values())} extra, e.g. {next(iter(extra), None)}"
    )
