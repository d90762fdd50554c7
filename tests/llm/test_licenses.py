"""License scans against brute force: places by regular expression, expressions by recursive descent."""

import random
import re

import pytest

from colweave.llm import licenses
from colweave.llm.queries import op11_license_scan

TEXTS = [
    None,
    "",
    " \n",
    "Released under the MIT License.",
    "mit license MIT-LICENSE mit\nlicensemit license",
    "Licensed under the Apache License, Version 2.0 or the MIT license.",
    "GNU General Public License, version 2, with the Classpath exception",
    "// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) AND BSD-3-Clause\ncode",
    "SPDX-License-Identifier: MIT. And so on",
    "SPDX-License-Identifier: ((MIT",
    "SPDX-License-Identifier: MIT AND AND",
    'license = "MIT OR Apache-2.0"',
    "Our license: we like it",
    "Licensed under CC BY-NC 4.0.",
    "émit license MIT LICENSE  mit license",
    "GNU Lesser General Public License",
]


def base_of(text):
    """The base columns by the letter of the contract."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [
        (k, label)
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
        for k in range(len(words))
        if words[k : k + len(phrase.split())] == phrase.split()
    ]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in places}))


def rank_of(tokens):
    """Recursive descent over a well-formed expression: the rank."""

    def either():
        value = both()
        while tokens[:1] == ["or"]:
            tokens.pop(0)
            value = min(value, both())
        return value

    def both():
        value = single()
        while tokens[:1] == ["and"]:
            tokens.pop(0)
            value = max(value, single())
        return value

    def single():
        token = tokens.pop(0)
        if token == "(":
            value = either()
            assert tokens.pop(0) == ")"
        else:
            value = licenses.identifiers()[token].rank
        if tokens[:1] == ["with"]:
            del tokens[:2]
            value = 1 if value in (2, 3) else value
        return value

    return either()


def made_up(draw, depth=0):
    if depth > 4 or draw.random() < 0.3:
        names = [name for name, licence in licenses.identifiers().items() if not licence.exception]
        own = [draw.choice(names)]
        return [*own, "with", "classpath-exception-2.0"] if draw.random() < 0.3 else own
    inner = [*made_up(draw, depth + 1), draw.choice(["and", "or"]), *made_up(draw, depth + 1)]
    return ["(", *inner, ")"] if draw.random() < 0.5 else inner


def test_expressions_against_recursive_descent():
    draw = random.Random(3)
    for _ in range(500):
        tokens = made_up(draw)
        value = licenses.evaluate(tokens)
        assert value.rank == rank_of(list(tokens))
        assert value.labels == {t for t in tokens if t in licenses.identifiers()}
        line = " ".join(tokens).replace("( ", "(").replace(" )", ")")
        found = licenses.scan(f"x\n# SPDX-License-Identifier: {line}\n y")
        assert found.restriction == value.rank and found.score == licenses.BY_TAG


@pytest.mark.parametrize("line", ["", "(", "mit mit", "mit or", "and mit", "mit)", "mit with mit", "classpath-exception-2.0", "( )"])
def test_no_expressions(line):
    assert licenses.evaluate(line.split()) is None


def test_base_columns_against_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op11_license_scan(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    found = 0
    for r in rows:
        base = base_of(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base
        assert set(filter(None, base[4].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == bool(r["labels"])
        found += base[1]
    assert found


def test_labels_of_the_method():
    found = {text: licenses.scan(text or "") for text in TEXTS}
    labels = lambda k: found[TEXTS[k]].labels
    assert [labels(k) for k in (0, 1, 2, 9, 10, 12)] == ["", "", "", "", "mit", ""]
    assert labels(5) == "apache,apache-2.0,mit" and found[TEXTS[5]].expressions == "apache-2.0 OR mit"
    assert found[TEXTS[6]].restriction == licenses.WEAK and labels(6) == "classpath-exception-2.0,gpl,gpl-2.0"
    assert labels(7) == "bsd-3-clause,classpath-exception-2.0,gpl-2.0-only,mit" and found[TEXTS[7]].restriction == 0
    assert labels(8) == "mit" and labels(11) == "apache-2.0,mit" and labels(13) == "cc-by-nc-4.0"
    assert labels(15) == "gpl,lgpl" and found[TEXTS[15]].restriction == licenses.WEAK


def test_edges(spark):
    rows = [(k, text, "x") for k, text in enumerate(TEXTS)]
    rows += [(None, "mit license", "x"), (3, TEXTS[3], "x"), (3, TEXTS[3], "x")]
    rows.append((99, "mit license or " * 30_000 + "license: " * 30_000 + "SPDX-License-Identifier: mit and " * 10_000, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = licenses.scan_licenses(docs).collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    for (_, text, _), r in zip(rows, got, strict=True):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_of(text)
    assert licenses.scan_licenses(docs.limit(0)).collect() == []
