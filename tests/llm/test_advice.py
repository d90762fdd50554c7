"""Cases of the second round of advice."""

import numpy as np
import pytest

from colweave.llm import decontamination, html_blocks, mixing, queries, token_files


def leaks(spark, docs, items):
    rows = decontamination.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    return {(r["doc_id"], r["item_id"]): r["coverage"] for r in rows.collect()}


def test_one_edit_of_a_repeated_number_keeps_the_item(spark):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "vo") for b in ("ban", "dor", "fil", "gum", "hes", "jal", "nop", "rix", "sut", "zem")]
    item = " ".join([*words[:15], "12 boxes", *words[15:45], "12 boxes", *words[45:58]])
    assert len(item.split()) == 62
    edited = "15".join(item.rsplit("12", 1))
    found = leaks(spark, [(1, f"start here {edited} and on"), (2, " ".join(words[::-1]))], [(7, item)])
    assert set(found) == {(1, 7)} and found[1, 7] == 53 / 58


def test_verbatim_copies_in_another_form(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(40).collect()]
    items.append((-1, "In the spring of 1962 Anna Weber and Boris Lange met near Lake Constance. They walked to Bregenz with Clara Fink, "
                      "who bought three maps for $20 from Otto Braun. Later Anna drove 15 km to Lindau."))
    forms = {
        "lower": str.lower,
        "upper": str.upper,
        "wrapped": lambda t: "\n ".join(t.split()),
        "bare": lambda t: "".join(c for c in t if c.isalnum() or c.isspace() or c in "%°€$£"),
    }
    docs, of = [], {}
    for k, (item, text) in enumerate(items):
        for n, form in enumerate(forms):
            docs.append((k * 10 + n, "something before it " + forms[form](text) + " and something after it"))
            of[k * 10 + n] = (item, form)
    found = leaks(spark, docs, items)
    assert [of[i] for i in of if (i, of[i][0]) not in found] == []


@pytest.mark.parametrize(
    "weights",
    [dict.fromkeys("abc", 1.0), {f"s{k}": (900 if k == 0 else k) ** 0.5 for k in range(20)}, {"a": 0.0004, "b": 0.9996}, {"a": 0.1, "b": 0.7, None: 0.2}],
)
def test_given_weights_hold_within_a_block(weights):
    rows = mixing.phases(dict.fromkeys(weights, 30_000), weights)
    end, total = rows[0][4], sum(weights.values())
    assert end >= 30_000
    for s, first, _, start, _, _, slots in rows[: len(weights)]:
        assert (first, start) == (0, 0)
        had = np.searchsorted(np.array(slots), np.arange(end), "right")
        assert (np.abs(had - weights[s] / total * (np.arange(end) + 1)) < 1 + 1e-6).all()
    placed = [t for s, _, own in mixing.slot_table(rows) for t in own]
    assert sorted(placed) == list(range(30_000 * len(weights)))


def test_added_tokens_in_a_text_are_the_library_s():
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(queries.tokenizer_file())
    encoder = token_files.PieceEncoder(queries.tokenizer_file())
    for text in ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>é", "<|endoftext", "plain text"]:
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == untouched.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><title>T</title><meta charset=u><body><p>One</p><p>Two", ["One", "Two"]),
        ("<head>\n<script>var a = '<p>no</p>';</script><!-- x --><link rel=a><p>One</p>", ["One"]),
        ("<head><title>T</title><noscript><p>x</p></noscript></head><p>One", ["One"]),
        ("<head><title>T</title>Bare text<p>One", ["Bare text", "One"]),
        ("<header>Top</header><p>One", ["Top", "One"]),
        ("<p>One <svg width='1' height=2 /> two</p><p>Three <svg><path d='m'/><text>no</text></svg>four", ["One two", "Three four"]),
        ("<template-card>In</template-card><p>One <svg-icon>icon</svg-icon> two", ["In", "One icon two"]),
        ("<p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", ["Where x=2 holds"]),
        ("<p>a<script>b</script>c<template><p>d</p></template>e", ["ace"]),
    ],
)
def test_hidden_elements_end_where_they_end(page, texts):
    assert [b.text for b in html_blocks.split_blocks(page)] == texts
