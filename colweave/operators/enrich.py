"""Prompts, and one response per row from a function of the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import render_prompt
from ..sources.journal import Journal, TaskJournal

# Takes one prompt, gives its response; with a batch size: prompts, gives as many responses, where an
# exception object in place of one fails that row only.
PromptFunction = Callable[..., "str | None"]
BatchFunction = Callable[..., Sequence["str | Exception | None"]]


def render_prompts(rows: DataFrame, source: str, prefix: str, system_prompt: str) -> DataFrame:
    """``rows`` with the prompt of each and the system prompt beside it."""
    return rows.withColumns(
        {"prompt": render_prompt(prefix, F.col(source)), "system_prompt": F.lit(system_prompt)}
    )


def spread(rows: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Lay rows out over ``partitions`` tasks by the hash of their key.

    By a key that is unique no task gets more than its share, and a task that is run again gets
    the same rows, which a round-robin layout does not promise.
    """
    return rows.repartition(partitions, *keys)


def enrich_rows(
    rows: DataFrame,
    function: PromptFunction | BatchFunction,
    prompt: str = "prompt",
    batch_size: int | None = None,
    resend: bool = False,
    journal: Journal | None = None,
    **arguments: str | None,
) -> DataFrame:
    """``rows`` with ``response`` and ``error``, exactly one of them NULL for a prompt that is not.

    The function runs in the tasks; the partitions of ``rows`` are the degree of parallelism. It
    takes one prompt, and what it raises is the error of that row. With a ``batch_size`` it takes up
    to so many prompts; what it raises is the error of all of them, since nothing is known of what a
    broken batch did, unless ``resend`` lets each be sent again alone. ``arguments`` are passed to it
    by name. A response that is no text is the error of its row. A NULL prompt is not sent and has
    neither.

    With a ``journal`` answers are kept while they come, under the whole numbers of its key column.
    They must be unique, ascend in each partition, and lie in the same partition in every attempt, as
    after ``spread(rows, n, key)`` and ``sortWithinPartitions(key)``. A task that is run again sends
    what its journal does not hold.
    """
    fields = [T.StructField("response", T.StringType()), T.StructField("error", T.StringType())]
    schema = T.StructType([*rows.schema.fields, *fields])
    position = rows.columns.index(prompt)

    def send(prompts: list[str]) -> list:
        return list(function(prompts, **arguments))

    place = rows.columns.index(journal.key) if journal else None

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = journal.of_task(TaskContext.get().partitionId()) if journal else None
        for batch in batches:
            prompts = batch.column(position).to_pylist()
            keys = batch.column(place).to_pylist() if kept else None
            responses: list = [None] * len(prompts)
            errors: list = [None] * len(prompts)
            wanted = [n for n, text in enumerate(prompts) if text is not None]
            if kept and kept.holds_more:
                wanted = [n for n in wanted if not _recalled(kept, keys[n], n, responses, errors)]
            noted = 0  # so many of the wanted are in the journal, or wait for it
            if batch_size is None:
                for done, n in enumerate(wanted, start=1):
                    try:
                        response = function(prompts[n], **arguments)
                        if type(response) is str:
                            responses[n] = response
                        else:
                            responses[n], errors[n] = _answer(response)
                    except Exception as error:
                        responses[n], errors[n] = _failed(error)
                    if kept and kept.is_due():
                        kept.keep(wanted[noted:done], keys, responses, errors)
                        kept.flush()
                        noted = done
            else:
                for start in range(0, len(wanted), batch_size):
                    part = wanted[start : start + batch_size]
                    for n, answer in zip(part, _call(send, [prompts[n] for n in part], resend)):
                        responses[n], errors[n] = answer
                    if kept and kept.is_due():
                        noted, before = start + len(part), noted
                        kept.keep(wanted[before:noted], keys, responses, errors)
                        kept.flush()
            if kept:
                kept.keep(wanted[noted:], keys, responses, errors)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(responses, pa.string()), pa.array(errors, pa.string())],
                names=schema.names,
            )

    return rows.mapInArrow(call, schema)


def _recalled(kept: TaskJournal, key: int, n: int, responses: list, errors: list) -> bool:
    """Take the answer of a key from the journal, if it holds one."""
    known = kept.recall(key)
    if known is not None:
        responses[n], errors[n] = known
    return known is not None


def _call(send: Callable[[list[str]], list], prompts: list[str], resend: bool) -> list[tuple]:
    try:
        results = send(prompts)
        if len(results) != len(prompts):
            raise ValueError(f"{len(results)} responses to {len(prompts)} prompts")
    except Exception as error:
        if resend and len(prompts) > 1:
            return [answer for prompt in prompts for answer in _call(send, [prompt], False)]
        return [_failed(error)] * len(prompts)
    return [_answer(result) for result in results]


def _answer(result) -> tuple:
    if isinstance(result, Exception):
        return _failed(result)
    if result is None:
        return None, "no response"
    if not isinstance(result, str):
        return None, f"TypeError: a response of type {type(result).__name__}"
    return result, None


def _failed(error: Exception) -> tuple:
    return None, f"{type(error).__name__}: {error}"


def conversion_rows(
    rows: DataFrame,
    *,
    api_provider: str,
    model_name: str,
    system_prompt: str,
    prompt_prefix: str,
    file_path: Column | str = "ssis_file_path",
    file_name: Column | str = "ssis_file_name",
    component: Column | str = "ssis_component",
    response: Column | str = "response",
    carry: Sequence[str] = (),
) -> DataFrame:
    """The eight columns of a log row in their order, the constants of the run put in."""
    # fixed values: the column names of the log
    as_column = lambda value: F.col(value) if isinstance(value, str) else value
    return rows.select(
        F.lit(api_provider).alias("api_provider"),
        F.lit(model_name).alias("model_name"),
        as_column(file_path).alias("ssis_file_path"),
        as_column(file_name).alias("ssis_file_name"),
        F.lit(system_prompt).alias("system_prompt"),
        F.lit(prompt_prefix).alias("prompt_prefix"),
        as_column(component).alias("ssis_component"),
        as_column(response).alias("llm_response"),
        *carry,
    )
