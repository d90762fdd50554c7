"""Packages to logged responses: read, explode, prompt, enrich, append."""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..operators.checks import refuse_violations
from ..operators.components import NAMESPACE, TAG, components_of_stretches, parse_stretches, rejects_of
from ..operators.enrich import (
    BatchFunction,
    PromptFunction,
    conversion_rows,
    enrich_rows,
    render_prompts,
    spread,
)
from ..operators.ids import MARK, PLACE_BITS, lay_out
from ..schemas import CONVERSION_ROW
from ..sources.journal import Journal
from ..sources.log import ConversionLog
from ..sources.staging import drop_folder, scratch_folder, stage, staging_path

WAVE = "_wave"
#: Components are laid out in ranges of about so many at most, which a task sorts in its memory.
RANGE_ROWS = 500_000


class Conversion(NamedTuple):
    """All three frames read staged rows, which stay until ``ConversionLog.release(run)``; without a
    log until the application ends."""

    run: str
    appended: DataFrame  # the new log rows with their ids; without a log the rows alone
    failures: DataFrame  # components whose response is an error; logged without a response
    rejects: DataFrame  # packages that are no XML


def convert_packages(
    packages: DataFrame,
    function: PromptFunction | BatchFunction,
    log: ConversionLog | None,
    *,
    api_provider: str,
    model_name: str,
    prompt_prefix: str,
    system_prompt: str,
    partitions: int | None = None,
    waves: int = 8,
    batch_size: int | None = None,
    journal_seconds: float = 5.0,
    tag: str = TAG,
    namespace: str = NAMESPACE,
    run: str | None = None,
) -> Conversion:
    """Send every component of every package to ``function`` and append one log row for each.

    ``function`` takes a prompt, or with a ``batch_size`` prompts, and ``system_prompt`` and
    ``model_name`` by name. Components are laid out in (file, index) order and staged before the
    calls, in ``waves`` stretches of that order. The calls of a wave run in ``partitions`` parallel
    tasks, as many as there are cores by default, however the components are spread over files; each
    wave reads its own stretch alone and is written when it ends.

    With a ``run`` name a repeated call takes up what was written: no prompt of a written wave is sent
    again. Inside a wave each task keeps its answers in a journal every ``journal_seconds``, so a task that
    is lost, and with the same ``partitions`` a repeated call too, asks only for those of that time
    again. Without a log nothing is saved.
    """
    order = ("ssis_file_path", "ssis_file_name", "component_index")
    if api_provider is None or model_name is None:
        raise ValueError("api_provider and model_name are required columns of the log")
    if log is None:
        part = lambda name: None  # copies without a name
        run = ""
    else:
        run = run or uuid.uuid4().hex
        part = lambda name: log.part(run, name)
        log.claim(
            run,
            api_provider=api_provider,
            model_name=model_name,
            prompt_prefix=prompt_prefix,
            system_prompt=system_prompt,
            tag=tag,
            namespace=namespace,
            waves=str(waves),
        )
    named = refuse_violations(packages, ("ssis_file_path", "ssis_file_name"))
    parsed = stage(parse_stretches(named, tag, namespace), part("stretches"))
    rejects = stage(rejects_of(parsed), part("rejects"))
    spark = packages.sparkSession
    tasks = partitions or spark.sparkContext.defaultParallelism
    most = max(tasks, waves, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = parsed.agg(F.sum("n_components")).first()[0] or 0
    ranges = max(most, -(-total // RANGE_ROWS))
    first = parsed.filter("component_index = 1")
    if first.groupBy(*order[:2]).count().filter("count > 1").isEmpty():
        # documents have names of their own, so whole stretches lie in the order of their components
        laid = lay_out(parsed.filter("error is null"), *order, partitions=ranges, opened=components_of_stretches)
    else:
        laid = lay_out(components_of_stretches(parsed), *order, partitions=ranges)
    # a range past the last, where something made more of them, is of the last wave
    wave_of = F.least(F.floor(F.shiftright(MARK, PLACE_BITS) * waves / ranges), F.lit(waves - 1)).cast("int")
    placed = stage(laid.withColumn(WAVE, wave_of), part("placed"), partition_by=WAVE)
    staged = []
    for wave in range(waves):
        name = part(f"journal{wave}-{tasks}")
        folder = staging_path(spark, name) if name else scratch_folder(spark, "journal")
        own = placed.filter(F.col(WAVE) == wave).drop(WAVE)
        laid = spread(own, tasks, MARK).sortWithinPartitions(MARK)
        prompts = render_prompts(laid, "ssis_component", prompt_prefix, system_prompt)
        answered = enrich_rows(
            prompts.drop("system_prompt"),
            function,
            batch_size=batch_size,
            journal=Journal(folder, MARK, journal_seconds),
            system_prompt=system_prompt,
            model_name=model_name,
        )
        # what is the same in all rows is not written with them here
        rows = answered.select(*order, "ssis_component", F.col("response").alias("llm_response"), "error", MARK)
        staged.append(stage(rows, part(f"wave{wave}")))
        drop_folder(spark, folder)
    answers = conversion_rows(
        reduce(DataFrame.unionByName, staged),
        api_provider=api_provider,
        model_name=model_name,
        system_prompt=system_prompt,
        prompt_prefix=prompt_prefix,
        response="llm_response",
        carry=("component_index", "error", MARK),
    )
    failures = answers.filter("error is not null").select(*order, "error")
    if log is None:
        return Conversion(run, answers.select(*CONVERSION_ROW.names), failures, rejects)
    return Conversion(run, log.append_marked(answers, run), failures, rejects)
