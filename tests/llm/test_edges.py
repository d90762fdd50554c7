"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colweave.llm import (
    decontamination,
    exact_dedup,
    html_extraction,
    language_model,
    mixing,
    quality,
    secrets,
    simhash,
    token_files,
    toxicity,
)
from colweave.llm.queries import tokenizer_file

CLASHING = (
    "_id _form _key _row id fp form text_ row token times style least _text _words _lines _s_upper score predicted "
    "keep_id kept _source _size _slots hash at n w item matched slot place block y missing order_0 label"
).split()
ROWS = [
    (1, "Hello wide world of words.", "src0"),
    (1, "Hello wide world of words.", "src0"),  # the same row again
    (2, None, "src0"),
    (3, "", None),
    (None, "A text without an id", None),
    (4, " \n\t ", "src1"),
    (5, "long " * 40_000, "src1"),
    (6, "Hello  wide\nworld of words.", "src1"),
    (7, "ünïcödé 中文 👍 text", "src2"),
]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, source string"
    return spark.createDataFrame(ROWS, schema).withColumns({name: F.lit("x") for name in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 0, 0), (5, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumns(
        {name: F.lit("x") for name in ("y", "text", "id", "_y")}
    )


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "Hello wide world of words."), (2, None), (3, ""), (4, "two words"), (None, "A text without an id")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumns(
        {name: F.lit("x") for name in ("item", "whole", "at", "_text", "_size")}
    )


def operators(spark, docs, labels, benchmark, folder):
    nothing = quality.RuleModel(0.0)
    return {
        "quality": lambda d: quality.score_quality(d, quality.train_quality(d, labels)),
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.train_toxicity(d, labels)),
        "language_model": language_model.score_texts,
        "mixing": mixing.mix,
        "mixed_rows": mixing.mixed_rows,
        "token_files": lambda d: token_files.read_token_files(
            token_files.write_token_files(d, f"{folder}/{d.rdd.id()}", tokenizer_file())
        ),
        "simhash": simhash.simhash_groups,
        "exact_dedup": exact_dedup.exact_duplicates,
        "secrets": secrets.find_secrets,
        "keep_good": lambda d: quality.keep_good(d, nothing),
    }


NAMES = list(operators(None, None, None, None, None))


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_its_result(spark, docs, labels, benchmark, name, tmp_path):
    rows = operators(spark, docs, labels, benchmark, tmp_path)[name](docs).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == sorted((r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_no_rows_give_no_rows(spark, docs, labels, benchmark, name, tmp_path):
    empty = spark.createDataFrame([], docs.schema)
    assert operators(spark, docs, labels, benchmark, tmp_path)[name](empty).collect() == []


def test_models_without_labels_are_constant(spark, docs, labels):
    none = labels.limit(0)
    scores = quality.score_quality(docs, quality.train_quality(docs, none)).select("score").distinct().collect()
    assert [r[0] for r in scores] == [0.5]
    scores = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, none)).select("score").distinct().collect()
    assert [r[0] for r in scores] == [0.5]


def test_exact_duplicates_of_edge_rows(spark, docs):
    rows = exact_dedup.exact_duplicates(docs).collect()
    of = lambda i: [r for r in rows if r["doc_id"] == i]
    assert [r["kept"] for r in sorted(of(1), key=lambda r: r["kept"])] == [False, True]  # one of two like rows
    assert of(6)[0]["keep_id"] == 1 and of(6)[0]["group_size"] == 3 and not of(6)[0]["kept"]
    assert of(3)[0]["keep_id"] == 2 and of(4)[0]["keep_id"] == 4  # null is empty; a space is not
    assert of(None)[0]["kept"] and of(None)[0]["keep_id"] is None


def test_near_duplicates_of_edge_rows(spark, docs):
    rows = {r["doc_id"]: r for r in simhash.simhash_groups(docs).collect()}
    assert rows[2]["fingerprint"] == rows[3]["fingerprint"] == rows[4]["fingerprint"] == "0" * 16
    assert rows[2]["component_id"] == rows[3]["component_id"] == 2
    assert rows[6]["component_id"] == 1 and rows[None]["component_id"] is None
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 5, 7]


def test_leaks_of_edge_rows(spark, docs, benchmark):
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, benchmark).collect()}
    assert found == {(1, 1), (6, 1), (None, None)}
    left = decontamination.drop_leaks(docs, benchmark)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4, 5, 7]
    assert decontamination.find_leaks(docs.limit(0), benchmark).collect() == []
    assert decontamination.find_leaks(docs, benchmark.limit(0)).collect() == []
    assert decontamination.drop_leaks(docs, benchmark.limit(0)).count() == len(ROWS)


def test_pages_of_edge_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (3, "u", "<p>"), (3, "u", "no markup at all"), (4, "u", "<div" * 5_000), (5, "u", "a<b" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    labeller = html_extraction.BlockLabeller()
    got = html_extraction.extract_text(pages, labeller).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got][:3] == ["", "", ""]
    assert html_extraction.extract_text(pages.limit(0), labeller).collect() == []
    assert pages.schema["html"].dataType == T.StringType()
