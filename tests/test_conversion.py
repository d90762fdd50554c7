"""Packages, enrichment, ids and the log on small hand-made data."""

import os
import random
import time
import tracemalloc
import uuid
from concurrent.futures import ThreadPoolExecutor
from unittest import mock
from xml.etree import ElementTree

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from colweave import (
    ConversionLog,
    allocate_ids,
    component_rejects,
    convert_packages,
    enrich_rows,
    explode_components,
    read_mapping_csv,
    read_packages,
    release_staged,
)
from colweave.operators import components, enrich
from colweave.operators.checks import log_violations, refuse_violations, split_violations
from colweave.operators.ids import MARK, lay_out
from colweave.schemas import CONVERSION_ROW, PACKAGES
from colweave.sources.claims import BROKEN, Claims
from colweave.sources.journal import Journal
from colweave.sources.staging import staged_names, staging_path, unstage

NS = "www.microsoft.com/SqlServer/Dts"
NESTED = (
    f'<D:Executable xmlns:D="{NS}">\n <D:Executable a="1">in<D:Executable a="2"/>tail</D:Executable>\n'
    f' <other><D:Executable a="3"/></other></D:Executable>\n'
)
RUN = dict(api_provider="local", model_name="m", prompt_prefix="do", system_prompt="sys")


def packages(spark, **documents):
    rows = [("dir", name, content) for name, content in documents.items()]
    return spark.createDataFrame(rows, PACKAGES)


def echo(prompt, system_prompt, model_name):
    assert (system_prompt, model_name) == ("sys", "m")
    return f"<{prompt[-20:]}>"


def test_nested_components_in_document_order(spark):
    frame = packages(spark, good=NESTED, bad="<a>", flat=f'<Executable xmlns="{NS}"/>', empty=None)
    found = explode_components(frame).orderBy("component_index").collect()
    assert [(r.ssis_file_name, r.component_index) for r in found] == [("good", 1), ("good", 2), ("good", 3)]
    text = [r.ssis_component for r in found]
    assert text[0].startswith(f'<ns0:Executable xmlns:ns0="{NS}" a="1">in<ns0:Executable a="2" />tail')
    assert text[1] == f'<ns0:Executable xmlns:ns0="{NS}" a="2" />tail'
    assert text[2] == f'<ns0:Executable xmlns:ns0="{NS}" a="3" />'
    rejects = {r.ssis_file_name: r.error for r in component_rejects(frame).collect()}
    assert set(rejects) == {"bad", "empty"} and "no element found" in rejects["bad"]


def test_other_tags_and_a_large_document(spark):
    many = "<r>" + "".join(f"<x>{n}</x>" for n in range(20_000)) + "</r>"
    found = explode_components(packages(spark, many=many), tag="x", namespace="")
    assert found.count() == 20_000
    assert found.filter("component_index = 12345").first().ssis_component == "<x>12344</x>"


def test_package_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.dtsx").write_text(NESTED)
    (tmp_path / "b.dtsx").write_text("one\r\ntwo\n\n", newline="")
    (tmp_path / "c.txt").write_text("no")
    found = {r.ssis_file_name: r for r in read_packages(spark, f"{tmp_path}/*.dtsx").collect()}
    assert set(found) == {"a.dtsx", "b.dtsx"}
    assert found["a.dtsx"].content == NESTED and found["b.dtsx"].content == "one\r\ntwo\n\n"
    assert found["a.dtsx"].ssis_file_path == str(tmp_path)


def test_names_of_files_and_folders_are_decoded(spark, tmp_path):
    (tmp_path / "my folder+").mkdir()
    (tmp_path / "my folder+" / "ODS - Rows 5%+a.dtsx").write_text(NESTED)
    row = read_packages(spark, str(tmp_path)).first()
    assert (row.ssis_file_path, row.ssis_file_name) == (f"{tmp_path}/my folder+", "ODS - Rows 5%+a.dtsx")


def test_failures_stay_with_their_rows(spark):
    def picky(prompts):
        if any("boom" in prompt for prompt in prompts):
            raise RuntimeError("boom seen")
        special = {"none": None, "bad": KeyError("k")}
        return [special[prompt] if prompt in special else prompt.upper() for prompt in prompts]

    rows = [(1, "a"), (2, "boom"), (3, "bad"), (4, None), (5, "none"), (6, "b")]
    frame = spark.createDataFrame(rows, "n int, prompt string").coalesce(1)
    found = {r.n: (r.response, r.error) for r in enrich_rows(frame, picky, batch_size=4, resend=True).collect()}
    assert found[1] == ("A", None) and found[6] == ("B", None)
    assert found[2] == (None, "RuntimeError: boom seen")
    assert found[3] == (None, "KeyError: 'k'")
    assert found[4] == (None, None) and found[5] == (None, "no response")


def test_wrong_number_of_responses_is_an_error(spark):
    frame = spark.createDataFrame([("a",), ("b",)], "prompt string")
    found = enrich_rows(frame.coalesce(1), lambda prompts: [], batch_size=2).collect()
    assert all(r.response is None and "0 responses to 2 prompts" in r.error for r in found)


def test_no_prompt_is_sent_twice(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def broken(prompts):
        with open(calls, "a") as file:
            file.write("".join(prompts))
        raise RuntimeError("down")

    frame = spark.createDataFrame([("a",), ("b",), ("c",)], "prompt string").coalesce(1)
    found = enrich_rows(frame, broken, batch_size=2).collect()
    assert open(calls).read() == "abc" and {r.error for r in found} == {"RuntimeError: down"}


def test_one_prompt_and_responses_that_are_no_text(spark):
    def one(prompt, model_name):
        return {"dict": {}, "none": None}.get(prompt, f"{model_name}:{prompt}")

    frame = spark.createDataFrame([("dict",), ("none",), ("x",)], "prompt string")
    found = {r.prompt: (r.response, r.error) for r in enrich_rows(frame, one, model_name="m").collect()}
    assert found == {
        "dict": (None, "TypeError: a response of type dict"),
        "none": (None, "no response"),
        "x": ("m:x", None),
    }


def test_ids_are_dense_in_order_and_hot_keys_are_split(spark):
    # one file holds nearly all rows
    file = "if(id < 19000, 'hot', concat('f', id % 7)) as f"
    frame = spark.range(20_000).selectExpr(file, "20000 - id as n")
    found = allocate_ids(frame, "f", "n", after=5)
    rows = found.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(6, 20_006))
    assert [(r.f, r.n) for r in rows] == sorted((r.f, r.n) for r in rows)
    placed = lay_out(frame, "f", "n", partitions=8).groupBy(F.shiftright(MARK, 33)).count()
    assert placed.agg(F.max("count")).first()[0] < 10_000


def test_ids_of_nothing(spark):
    assert allocate_ids(spark.range(0), "id", id_column="n").count() == 0


def rows_of(spark, *names):
    rows = [("p", "m", "dir", name, None, None, name, "r") for name in names]
    return spark.createDataFrame(rows, CONVERSION_ROW)


def test_log_appends_and_reads_above_the_mark(spark):
    log = ConversionLog(spark, staging_path(spark))
    assert log.max_id() == 0 and log.since(None).count() == 0 and log.for_package("x").count() == 0
    log.append(rows_of(spark, "b", "a"), ["ssis_file_name"])
    mark = log.max_id()
    appended = log.append(rows_of(spark, "c", "a"), ["ssis_file_name"])
    assert mark == 2 and sorted(r.id for r in appended.collect()) == [3, 4]
    assert [(r.id, r.ssis_file_name) for r in log.since(mark).collect()] == [(3, "a"), (4, "c")]
    assert [r.id for r in log.for_package("a").collect()] == [1, 3]
    assert log.for_package("a", ["llm_response"]).columns == ["llm_response"]
    assert log.read().count() == 4


def test_log_as_a_table(spark):
    spark.sql("drop table if exists conversion_log_test")
    log = ConversionLog(spark, "conversion_log_test")
    try:
        assert log.max_id() == 0
        log.append(rows_of(spark, "a"), ["ssis_file_name"])
        log.append(rows_of(spark, "b"), ["ssis_file_name"])
        assert [r.id for r in log.since(0).collect()] == [1, 2]
    finally:
        spark.sql("drop table if exists conversion_log_test")


def test_a_run_is_appended_once(spark):
    log = ConversionLog(spark, staging_path(spark))
    run = staging_path(spark).rsplit("/", 1)[1]
    log.append(rows_of(spark, "a", "b"), ["ssis_file_name"], run=run)
    log.append(rows_of(spark, "a", "b"), ["ssis_file_name"], run=run)
    assert [r.id for r in log.since(0).collect()] == [1, 2]


def breaking_off(monkeypatch, condition):
    """The next write of a log keeps the rows of ``condition`` and fails."""
    write = ConversionLog._write

    def broken(log, rows):
        monkeypatch.setattr(ConversionLog, "_write", write)
        write(log, rows.filter(condition))
        raise ConnectionError

    monkeypatch.setattr(ConversionLog, "_write", broken)


def test_a_half_written_run_is_completed(spark, monkeypatch):
    log = ConversionLog(spark, staging_path(spark))
    log.append(rows_of(spark, "z"), ["ssis_file_name"])
    breaking_off(monkeypatch, "id = 3")
    with pytest.raises(ConnectionError):
        log.append(rows_of(spark, "a", "b", "c"), ["ssis_file_name"], run="half")
    for _ in range(2):
        appended = log.append(rows_of(spark, "ignored"), ["ssis_file_name"], run="half")
    found = [(r.id, r.ssis_file_name) for r in log.since(0).collect()]
    assert found == [(1, "z"), (2, "a"), (3, "b"), (4, "c")]
    assert sorted(r.ssis_file_name for r in appended.collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("kept", ["false", "id = 2"])
def test_rows_of_another_run_do_not_count(spark, monkeypatch, kept):
    log = ConversionLog(spark, staging_path(spark))
    names = lambda: [r.ssis_file_name for r in log.since(0).collect()]
    breaking_off(monkeypatch, kept)
    with pytest.raises(ConnectionError):
        log.append(rows_of(spark, "A1", "A2", "A3"), ["ssis_file_name"], run="a")
    log.append(rows_of(spark, "B1", "B2"), ["ssis_file_name"])
    breaking_off(monkeypatch, "ssis_file_name = 'A3'")
    with pytest.raises(ConnectionError):
        log.append(rows_of(spark, "A1", "A2", "A3"), ["ssis_file_name"], run="a")
    log.append(rows_of(spark, "C1"), ["ssis_file_name"])
    for _ in range(2):
        log.append(rows_of(spark, "A1", "A2", "A3"), ["ssis_file_name"], run="a")
    assert sorted(names()) == ["A1", "A2", "A3", "B1", "B2", "C1"]
    ids = [r.id for r in log.since(0).collect()]
    assert len(set(ids)) == 6


def test_run_names_belong_to_a_log(spark):
    one, two = (ConversionLog(spark, staging_path(spark)) for _ in range(2))
    one.append(rows_of(spark, "a"), ["ssis_file_name"], run="day")
    two.append(rows_of(spark, "b"), ["ssis_file_name"], run="day")
    assert [r.ssis_file_name for r in two.since(0).collect()] == ["b"]
    one.release("day")
    assert staged_names(spark, one.part("day", "")) == [] and staged_names(spark, two.part("day", ""))


def test_a_run_with_other_settings_is_refused(spark):
    log = ConversionLog(spark, staging_path(spark))
    frame = packages(spark, good=NESTED)
    convert_packages(frame, echo, log, run="day", **RUN)
    with pytest.raises(ValueError, match="model_name"):
        convert_packages(frame, echo, log, run="day", **RUN | {"model_name": "m2"})
    assert log.read().count() == 3


def test_without_a_log_nothing_is_saved(spark):
    result = convert_packages(packages(spark, good=NESTED, bad="<a>"), echo, None, **RUN)
    assert result.appended.columns == CONVERSION_ROW.names and result.appended.count() == 3
    assert result.rejects.count() == 1


def test_a_stopped_run_resumes_with_the_written_waves(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def stops(prompt, **_):
        with open(calls, "a") as file:
            file.write(prompt[-12:-11])
        return "ok"

    log = ConversionLog(spark, staging_path(spark))
    frame = packages(spark, **{f"f{n}": NESTED for n in range(20)})
    convert_packages(frame, stops, log, partitions=4, waves=4, run="day", **RUN)
    first = len(open(calls).read())
    for name in ("wave2", "done", "try0"):  # as if it had stopped in the third wave
        unstage(spark, log.part("day", name))
    convert_packages(frame, stops, log, partitions=4, waves=4, run="day", **RUN)
    assert first == 60 and 60 < len(open(calls).read()) < 100


def test_unnamed_copies_are_released(spark):
    before = set(staged_names(spark, ""))
    allocate_ids(spark.range(10), "id", id_column="n").count()
    ConversionLog(spark, staging_path(spark)).append(rows_of(spark, "a"), ["ssis_file_name"])
    release_staged(spark)
    after = set(staged_names(spark, "")) - before
    assert len(after) <= 1  # the log itself


def test_a_row_without_a_required_column_fails_the_append(spark):
    broken = rows_of(spark, "a", "b").withColumn("model_name", F.when(F.col("ssis_file_name") == "a", "m"))
    log = ConversionLog(spark, staging_path(spark))
    with pytest.raises(Exception, match="model_name must not be NULL"):
        log.append(broken, ["ssis_file_name"])
    assert log.read().count() == 0
    assert [tuple(r) for r in log_violations(broken).collect()] == [("model_name", 1)]
    good, bad = split_violations(broken)
    assert good.count() == 1 and bad.first().violated_columns == ["model_name"]
    with pytest.raises(Exception, match="model_name"):
        refuse_violations(broken).collect()


def test_convert_packages(spark):
    log = ConversionLog(spark, staging_path(spark))
    frame = packages(spark, good=NESTED, bad="<a>")
    result = convert_packages(frame, echo, log, partitions=2, **RUN)
    stored = log.since(0).collect()
    assert [r.id for r in stored] == [1, 2, 3]
    assert stored[2].llm_response == '<' + f'do:{stored[2].ssis_component}'[-20:] + '>'
    assert {(r.api_provider, r.prompt_prefix, r.ssis_file_path) for r in stored} == {("local", "do", "dir")}
    assert result.failures.count() == 0
    assert [r.ssis_file_name for r in result.rejects.collect()] == ["bad"]
    assert result.appended.count() == 3
    log.release(result.run)
    assert staged_names(spark, log.part(result.run, "")) == [] and log.read().count() == 3


def test_a_repeated_run_makes_no_second_call(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def counting(prompt, **_):
        with open(calls, "a") as file:
            file.write("x")
        if 'a="2" />tail' == prompt[-12:]:
            raise ValueError("no")
        return "ok"

    log = ConversionLog(spark, staging_path(spark))
    run = staging_path(spark).rsplit("/", 1)[1]
    frame = packages(spark, good=NESTED)
    for _ in range(2):
        result = convert_packages(frame, counting, log, partitions=1, run=run, **RUN)
    assert open(calls).read() == "xxx"
    assert [r.llm_response for r in log.since(0).collect()] == ["ok", None, "ok"]
    assert [(r.component_index, r.error) for r in result.failures.collect()] == [(2, "ValueError: no")]


def test_mapping_csv(spark, tmp_path):
    head = "config_id,source_column_name,f_definition,f_parameter_text,transform_data_type\n"
    (tmp_path / "m.csv").write_text(head + '1,A,"f(i0,""x"",i1)",\\d|b,String\n2,B,g,,Date\n')
    found = [tuple(r) for r in read_mapping_csv(spark, f"{tmp_path}/m.csv").orderBy("config_id").collect()]
    assert found == [(1, "A", 'f(i0,"x",i1)', "\\d|b", "String"), (2, "B", "g", "", "Date")]
    (tmp_path / "bad.csv").write_text(head + "one,A,f,p,String\n")
    with pytest.raises(Exception):
        read_mapping_csv(spark, f"{tmp_path}/bad.csv").collect()


def many_components(spark, n, files=1):
    body = "".join(f'<D:Executable k="{k}"/>' for k in range(n))
    document = f'<D:Executable xmlns:D="{NS}">{body}</D:Executable>'
    return packages(spark, **{f"f{k}": document for k in range(files)})


def test_as_many_calls_under_way_as_partitions(spark, tmp_path):
    """With the default waves too: every call notes when it began and ended."""
    folder = str(tmp_path)

    def slow(prompt, **_):
        began = time.time()
        time.sleep(0.05)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            file.write(f"{began} {time.time()}")
        return "ok"

    convert_packages(many_components(spark, 320), slow, None, partitions=8, **RUN)
    calls = [tuple(map(float, file.read_text().split())) for file in tmp_path.iterdir()]
    under_way = [sum(a <= began < b for a, b in calls) for began, _ in calls]
    assert len(calls) == 320 and max(under_way) == 8
    assert sum(under_way) / len(calls) > 4  # not only for a moment


def test_a_wave_reads_its_own_components_alone(spark):
    read = []

    def noting(rows, *args, **kwargs):
        read.append(rows)
        return enrich.enrich_rows(rows, *args, **kwargs)

    with mock.patch("colweave.plans.convert.enrich_rows", noting):
        result = convert_packages(many_components(spark, 100), echo, None, waves=4, **RUN)
    assert result.appended.count() == 100 and len(read) == 4
    files = [set(rows.select("ssis_component", "_mark").inputFiles()) for rows in read]
    parts = [{file.split("_wave=")[1].split("/")[0] for file in own} for own in files]
    plans = [rows._jdf.queryExecution().executedPlan().toString() for rows in read]
    assert all("PartitionFilters" in plan and f"_wave#" in plan for plan in plans)
    scanned = [rows.count() for rows in read]
    assert sum(scanned) == 100 and max(scanned) < 60 and set.union(*parts) == {"0", "1", "2", "3"}


def test_a_lost_task_does_not_repeat_its_calls(spark, tmp_path):
    """Each of two tasks dies once in the middle of its calls, the worker with it."""
    folder = str(tmp_path)

    def deadly(prompt, **_):
        part = TaskContext.get().partitionId()
        with open(f"{folder}/calls{part}", "a") as file:
            file.write(prompt[-5:])
        made = os.path.getsize(f"{folder}/calls{part}") // 5
        if made == 20 and TaskContext.get().attemptNumber() == 0:
            os._exit(1)
        if prompt.endswith('"77" />'):
            raise ValueError("seven")
        return prompt[-12:]

    result = convert_packages(many_components(spark, 100), deadly, None, partitions=2, waves=1, journal_seconds=0, **RUN)
    rows = result.appended.collect()
    assert len(rows) == 100 and all((r.llm_response or "") == r.ssis_component[-12:] or r.llm_response is None for r in rows)
    assert [r.error for r in result.failures.collect()] == ["ValueError: seven"]
    assert sum(os.path.getsize(f"{folder}/calls{part}") for part in (0, 1)) // 5 == 100 + 2  # the two that died


def test_a_stopped_run_goes_on_inside_a_wave(spark, tmp_path):
    calls = tmp_path / "calls"

    def stops(prompt, **_):
        if not (tmp_path / "again").exists() and calls.exists() and calls.stat().st_size >= 30:
            os._exit(1)  # however often it is tried
        with open(calls, "a") as file:
            file.write("x")
        return "ok"

    log = ConversionLog(spark, staging_path(spark))
    frame = many_components(spark, 60)
    settings = dict(partitions=1, waves=1, journal_seconds=0, run="day", **RUN)
    with pytest.raises(Exception):
        convert_packages(frame, stops, log, **settings)
    (tmp_path / "again").touch()
    convert_packages(frame, stops, log, **settings)
    assert log.read().count() == 60 and calls.stat().st_size == 60
    assert not [name for name in staged_names(spark, log.part("day", "")) if "journal" in name]


def test_a_journal_is_read_in_step(tmp_path):
    kept = Journal(str(tmp_path), "k", 0).of_task(3)
    for key in (2, 5, 9):
        kept.add(key, (f"r{key}", None))
        kept.flush()
    again = Journal(str(tmp_path), "k", 0).of_task(3)
    assert [again.recall(key) for key in (1, 2, 4, 5)] == [None, ("r2", None), None, ("r5", None)]
    again.add(7, (None, "e"))  # another attempt answered between
    again.flush(now=True)
    (tmp_path / "part-000003" / "broken.arrow.tmp").write_text("x")
    third = Journal(str(tmp_path), "k", 100).of_task(3)
    assert [third.recall(key) for key in (2, 5, 7, 9)] == [("r2", None), ("r5", None), (None, "e"), ("r9", None)]
    third.add(11, ("late", None))
    third.flush()  # not yet time
    assert Journal(str(tmp_path), "k").of_task(3).recall(11) is None


def at_once(content, name):
    """The components of a document by the whole tree."""
    found = ElementTree.fromstring(content).iterfind(f".//{name}")
    return [(n, ElementTree.tostring(element, encoding="unicode"), None) for n, element in enumerate(found, 1)]


def made_up(draw, depth=0):
    inner = "".join(made_up(draw, depth + 1) for _ in range(draw.randrange(4 if depth < 6 else 1)))
    tag = draw.choice(["x", "y", "p:x", "p:z"])
    return f'<{tag} a="{draw.randrange(99)}">é{draw.choice(["a", "b", "&amp;"])}{inner}</{tag}>{draw.choice(["", " tail ", "<!-- c -->"])}'


@pytest.mark.parametrize("piece", [1, 7, 100, 10_000])
def test_pieces_give_what_the_whole_tree_gives(monkeypatch, piece):
    monkeypatch.setattr(components, "_PIECE", piece)
    draw = random.Random(piece)
    for _ in range(60):
        text = f'<x xmlns:p="urn:p">{"".join(made_up(draw) for _ in range(3))}</x>'
        for name in ("x", "{urn:p}x", "nothing"):
            assert list(components._components(text, name)) == at_once(text, name)
        declared = f'<?xml version="1.0" encoding="utf-16"?>{text}'.encode("utf-16")
        assert list(components._components(declared, "x")) == at_once(text, "x")
        broken = text[: draw.randrange(5, len(text) - 3)]
        (index, _, error), = components._components(broken, "x")
        assert index is None and error


def test_unreadable_documents_are_rows(spark):
    rows = [("d", "utf16", '<?xml version="1.0" encoding="utf-16"?><r><x>é</x></r>'.encode("utf-16"))]
    rows += [("d", "odd", b'<?xml version="1.0" encoding="klingon"?><r><x/></r>'), ("d", "none", None), ("d", "empty", b"")]
    rows += [("d", "wrong", b'<?xml version="1.0" encoding="utf-8"?><r><x>\xff</x></r>')]
    frame = spark.createDataFrame(rows, "ssis_file_path string, ssis_file_name string, content binary")
    found = explode_components(frame, tag="x", namespace="").collect()
    assert [(r.ssis_file_name, r.ssis_component) for r in found] == [("utf16", "<x>é</x>")]
    errors = {r.ssis_file_name: r.error for r in component_rejects(frame, tag="x", namespace="").collect()}
    assert set(errors) == {"odd", "none", "empty", "wrong"} and all(errors.values())


def test_a_large_document_is_not_held_as_a_tree():
    body = "<g>" + "".join(f'<x a="{k}">some text<y/></x><z>{k}</z>' for k in range(1_000)) + "</g>"
    content = ("<r>" + body * 100 + "</r>").encode()
    tracemalloc.start()
    n = sum(1 for _ in components._components(content, "x"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_000 and peak < len(content)  # the tree alone would be many times that


def test_interleaved_appends_have_their_own_ids(spark, monkeypatch):
    """One writer appends while another is about to write, with and without a run."""
    one, two = (ConversionLog(spark, path) for path in [staging_path(spark)] * 2)
    write = ConversionLog._write

    def between(log, rows):
        monkeypatch.setattr(ConversionLog, "_write", write)
        two.append(rows_of(spark, "B1", "B2"), ["ssis_file_name"])
        return write(log, rows)

    for run in (None, "day"):
        monkeypatch.setattr(ConversionLog, "_write", between)
        one.append(rows_of(spark, "A1", "A2", "A3"), ["ssis_file_name"], run=run)
    found = [(r.id, r.ssis_file_name[0]) for r in one.since(0).collect()]
    assert found == list(enumerate("AAABBAAABB", start=1))
    assert one.max_id() == 10


def test_appends_at_the_same_time(spark):
    path = staging_path(spark)

    def append(k):
        log = ConversionLog(spark, path)
        for n in range(3):
            log.append(rows_of(spark, *(f"{k}-{n}-{m}" for m in range(4))), ["ssis_file_name"])

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(append, range(4)))
    rows = ConversionLog(spark, path).read().collect()
    assert sorted(r.id for r in rows) == list(range(1, 49))
    assert len({r.ssis_file_name for r in rows}) == 48


def test_an_append_does_not_read_the_log(spark, monkeypatch):
    log = ConversionLog(spark, staging_path(spark))
    log.append(rows_of(spark, "a", "b"), ["ssis_file_name"])

    def unread(log):
        raise AssertionError("the log is read")

    monkeypatch.setattr(ConversionLog, "read", unread)
    log.append(rows_of(spark, "c"), ["ssis_file_name"])
    log.append(rows_of(spark, "d"), ["ssis_file_name"], run="day")
    assert log.max_id() == 4
    monkeypatch.undo()
    assert [(r.id, r.ssis_file_name) for r in log.since(0).collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_rows_from_before_the_claims_are_counted(spark):
    log = ConversionLog(spark, staging_path(spark))
    log._write(rows_of(spark, "old").selectExpr("100L as id", "*"))
    log.append(rows_of(spark, "new"), ["ssis_file_name"])
    assert [r.id for r in log.since(0).collect()] == [100, 101]


def test_only_one_writer_makes_a_claim(spark):
    claims = Claims(spark, staging_path(spark))
    nothing = claims.known()
    assert claims.take(nothing, 1, 5, "a") and claims.take(nothing, 1, 7, "b") is None
    later = claims.claim(3, "b", lambda: pytest.fail("looked up"))
    assert (later.first, later.last) == (6, 8)
    claims.end(later, BROKEN)  # from where the log is, but above what another is at
    assert claims.claim(1, "c", lambda: 2).first == 6 and claims.claim(1, "c", lambda: 0).first == 7


def made_up_element(draw, depth=0):
    namespaces = ["", "{urn:p}", '{a&"b}', "{http://www.w3.org/XML/1998/namespace}", "{http://www.w3.org/2001/XMLSchema}"]
    texts = [None, "", " ", 'a&b<c>d"e\r\n\t', "ünï\U0001f600", "plain"]
    element = ElementTree.Element(draw.choice(namespaces) + draw.choice("xy"))
    for _ in range(draw.randrange(4)):
        element.set(draw.choice(namespaces) + draw.choice("ab"), draw.choice(texts) or "")
    element.text, element.tail = draw.choice(texts), draw.choice(texts)
    element.extend(made_up_element(draw, depth + 1) for _ in range(draw.randrange(4 if depth < 4 else 1)))
    return element


def test_components_are_written_in_one_pass_as_the_library_does():
    draw = random.Random(5)
    for _ in range(300):
        tree = made_up_element(draw)
        for name in {element.tag for element in tree.iter()}:
            texts = components._Texts(name)  # one for all of a document
            for element in tree.iter(name):
                assert texts.of(element) == ElementTree.tostring(element, encoding="unicode")


def test_prompts_are_made_behind_the_exchange_of_a_wave(spark):
    read = []

    def noting(rows, *args, **kwargs):
        read.append(rows)
        return enrich.enrich_rows(rows, *args, **kwargs)

    with mock.patch("colweave.plans.convert.enrich_rows", noting):
        convert_packages(many_components(spark, 20), echo, None, waves=2, **RUN)
    plans = [rows._jdf.queryExecution().optimizedPlan().toString() for rows in read]
    assert len(plans) == 2
    for plan in plans:  # printed from the last step to the first
        assert "AS prompt" in plan.split("RepartitionByExpression")[0]
        assert "prompt" not in plan.split("RepartitionByExpression")[1]


def test_stretches_hold_the_components_of_a_parse(spark):
    frame = many_components(spark, 40, files=2).unionByName(packages(spark, nested=NESTED, bad="<a>", none=f'<a xmlns="{NS}"/>'))
    stretches = components.parse_stretches(frame)
    rows = stretches.collect()
    assert sorted((r.ssis_file_name, r.component_index, r.n_components) for r in rows if r.error is None) == [
        *((f"f{k}", first, n) for k in (0, 1) for first, n in ((1, 16), (17, 16), (33, 8))), ("nested", 1, 3)
    ]
    assert [(r.ssis_file_name, r.n_components) for r in components.rejects_of(stretches).join(stretches, "ssis_file_name").collect()] == [("bad", 0)]
    opened = components.components_of_stretches(stretches)
    expected = explode_components(frame)
    assert opened.columns == expected.columns and sorted(opened.collect()) == sorted(expected.collect())


def test_a_stretch_is_closed_by_its_size(spark):
    text = "x" * 100_000
    body = "".join(f'<D:Executable k="{k}">{text}</D:Executable>' for k in range(7))
    frame = packages(spark, big=f'<D:Executable xmlns:D="{NS}">{body}</D:Executable>')
    rows = components.parse_stretches(frame).orderBy("component_index").collect()
    assert [(r.component_index, r.n_components) for r in rows] == [(1, 3), (4, 3), (7, 1)]


@pytest.mark.parametrize("names", [["a", "b", "c"], ["a", "b", "a"]])
def test_ids_follow_files_and_indices_over_stretches(spark, names):
    """With two documents of one name too, whose components then lie between each other."""
    body = "".join(f'<D:Executable k="{k}"/>' for k in range(50))
    rows = [("dir", name, f'<D:Executable xmlns:D="{NS}">{body}</D:Executable>') for name in names]
    log = ConversionLog(spark, staging_path(spark))
    convert_packages(spark.createDataFrame(rows, PACKAGES), echo, log, waves=3, **RUN)
    found = log.since(0).collect()
    assert [r.id for r in found] == list(range(1, 151))
    index = [(r.ssis_file_name, int(r.ssis_component.split('k="')[1].split('"')[0])) for r in found]
    assert index == sorted((name, k) for name in names for k in range(50))


def test_components_in_ranges_past_the_last_are_sent_too(spark):
    """Where a repartition makes more ranges than it was asked for."""
    kind = type(spark.range(0))
    laid = kind.repartitionByRange
    with mock.patch.object(kind, "repartitionByRange", lambda self, n, *by: laid(self, 40, *by)):
        result = convert_packages(many_components(spark, 200, files=4), echo, None, waves=2, **RUN)
    assert result.appended.count() == 800


def test_what_all_rows_share_is_not_staged_with_them(spark):
    log = ConversionLog(spark, staging_path(spark))
    result = convert_packages(packages(spark, good=NESTED), echo, log, waves=1, run="day", **RUN)
    staged = spark.read.parquet(staging_path(spark, log.part("day", "wave0")))
    assert not {"api_provider", "model_name", "system_prompt", "prompt_prefix"} & set(staged.columns)
    assert {(r.api_provider, r.model_name, r.system_prompt, r.prompt_prefix) for r in result.appended.collect()} == {
        ("local", "m", "sys", "do")
    }


def test_nested_components_are_stretches_of_the_text_around_them():
    draw = random.Random(6)
    for _ in range(300):
        tree = made_up_element(draw)
        texts = components._Texts(tree.tag)
        for _ in range(2):  # the names kept are the same the second time
            assert list(texts.of_all(tree)) == [ElementTree.tostring(e, encoding="unicode") for e in tree.iter(tree.tag)]
