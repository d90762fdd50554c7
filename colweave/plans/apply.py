"""Run a mapping: the source table projected to its mapped columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from ..functions.types import LOGICAL_TYPES, typed_null
from ..operators.items import DERIVED, RAW
from ..operators.rows import active_source_rows
from .compile import collect_mapping


CONFIG = "config_id"


class Projection(NamedTuple):
    """What one configuration selects, over a source that has its derived columns as null strings."""

    derived: tuple[str, ...]
    columns: dict[str, Column]


def apply_mapping(
    mapping: DataFrame,
    source: DataFrame,
    config_id: int,
    strict: bool = True,
    return_length: int = 0,
) -> DataFrame:
    """The current rows of ``source`` with the raw columns and the targets of one configuration.

    Definitions are Spark SQL expressions over what the compiled query selects: the raw columns,
    and the derived ones as null strings, also where the source has a column of that name; a derived
    column that no target takes the place of is given as such. Other columns of the source can be
    used too. A target takes the place of a column of its name. ``strict=False`` turns a failing
    cast into NULL. ``return_length`` adds the typed null columns that fill each list up to that length.

    The reduced mapping rows of the one configuration are read when the plan is made; the source
    stays on the executors and is read only in the columns that are used.
    """
    items = _plan_items(mapping, [config_id]).get(config_id, [])
    chosen = _projection(items, config_id, strict, return_length)
    return _current(source, chosen.derived).select(*chosen.columns.values())


def apply_mappings(
    mapping: DataFrame,
    source: DataFrame,
    config_ids: Sequence[int],
    strict: bool = True,
    return_length: int = 0,
) -> DataFrame:
    """What ``apply_mapping`` gives for each of several configurations, stacked, ``config_id`` in front.

    A row has the columns of all of them, in the order in which they first come; those that a
    configuration does not have are NULL. A name must have one type in all of them. The source is
    scanned once, and each of its rows turned into one of each configuration. Only configurations
    that hide different columns of the source, by deriving one of that name, need a scan for each
    such set. The mapping rows of the configurations, which are all part of the plan, are read when
    it is made; a configuration without any gives no rows, and one that is named twice counts once.
    """
    items = _plan_items(mapping, list(config_ids))
    by_hidden: dict[frozenset, dict[int, Projection]] = {}
    types: dict[str, T.DataType] = {}
    for config_id in dict.fromkeys(config_ids):
        if config_id not in items:
            continue
        chosen = _projection(items[config_id], config_id, strict, return_length)
        _refuse_repeats(config_id, "a column with the name of the configuration's", [CONFIG, *chosen.columns])
        shape = _current(source, chosen.derived).select(*chosen.columns.values()).schema
        for name, field in zip(chosen.columns, shape.fields):
            if types.setdefault(name, field.dataType) != field.dataType:
                known, here = types[name].simpleString(), field.dataType.simpleString()
                raise ValueError(f"column {name} is {here} in configuration {config_id}, not {known}")
        hidden = frozenset(map(str.lower, chosen.derived)) & frozenset(map(str.lower, source.columns))
        by_hidden.setdefault(hidden, {})[config_id] = chosen
    _refuse_repeats(None, "columns whose names differ in case", list(types))
    if not types:
        return source.sparkSession.createDataFrame([], f"{CONFIG} bigint")
    stacked = []
    for group in by_hidden.values():
        derived = {name.lower(): name for chosen in group.values() for name in chosen.derived}
        rows = [
            F.struct(
                F.lit(config_id).cast("bigint").alias(CONFIG),
                *(chosen.columns.get(name, F.lit(None).cast(kind)).cast(kind).alias(name) for name, kind in types.items()),
            )
            for config_id, chosen in group.items()
        ]
        stacked.append(_current(source, derived.values()).select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, stacked)


def _projection(items: list[Row], config_id: int, strict: bool, return_length: int) -> Projection:
    raw = sorted({item.name for item in items if item.slot == RAW})
    derived = sorted({item.name for item in items if item.slot == DERIVED} - set(raw))
    by_type = {kind.name: [] for kind in LOGICAL_TYPES}
    for item in items:
        if item.slot in by_type:
            by_type[item.slot].append(item)

    targets: dict[str, Column] = {}
    pads: list[str] = []
    for kind in LOGICAL_TYPES:
        for item in sorted(by_type[kind.name], key=lambda entry: entry.pos):
            targets[item.name] = _typed(item.text, kind.sql_type, strict).alias(item.name)
        for n in range(len(by_type[kind.name]) + 1, return_length + 1):
            pad = f"_{kind.prefix}{n}"
            pads.append(pad)
            targets[pad] = typed_null(kind).alias(pad)
    named = [item.name for entries in by_type.values() for item in entries]
    _refuse_repeats(config_id, "targets with more than one type", named)
    _refuse_repeats(config_id, "columns with the name of a padding", [*{*named, *raw, *derived}, *pads])
    replaced = {name.lower() for name in targets}
    kept = {name: F.col(_quoted(name)) for name in [*raw, *derived] if name.lower() not in replaced}
    return Projection(tuple(derived), kept | targets)


def _current(source: DataFrame, derived: Iterable[str]) -> DataFrame:
    return active_source_rows(source).withColumns({name: F.lit(None).cast("string") for name in derived})


def _plan_items(mapping: DataFrame, config_ids: list[int]) -> dict[int, list[Row]]:
    """The items of the grouped rows of the configurations, the rows that a compile gives too."""
    own = mapping.filter(F.col("config_id").isin(config_ids))
    return {row["config_id"]: row["items"] for row in collect_mapping(own, bind_style="backtick").collect()}


def _typed(text: str, sql_type: str, strict: bool) -> Column:
    value = F.expr(text)
    return value.cast(sql_type) if strict else value.try_cast(sql_type)


def _refuse_repeats(config_id: int | None, what: str, names: list[str]) -> None:
    repeated = sorted(name for name, n in Counter(map(str.lower, names)).items() if n > 1)
    if repeated:
        where = "" if config_id is None else f"configuration {config_id}: "
        raise ValueError(f"{where}{what}: {repeated}")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
