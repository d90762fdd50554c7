"""Placeholders: whole words, bound at the same time, parameters taken literally."""

import random
import re

import pytest
from pyspark.sql import functions as F

from colweave.functions.binding import bind_parameters, bind_source_column

CASES = [
    ("f(i0)", "A", None, "f(A)"),
    ("f(i1,i10)", "A", "p", "f(p,i10)"),
    ("f(i1,i2)", "A", "i2|q", "f(i2,q)"),
    ("bi1(i1)", "A", "p", "bi1(p)"),
    ("f(i1)", "A", r"\d$1", r"f(\d$1)"),
    ("f(i1)", "A", "", "f()"),
    ("f(i1,i2,i3)", "A", "a||c", "f(a,,c)"),
    ("f(i0,i1)", "i1", "p", "f(i1,p)"),
    ("i0", "A", "p", "A"),
    ("i1i0 i01 xi0", "A", "p", "i1i0 i01 xi0"),
    ("i12345678901234567890(i1)", "A", "p", "i12345678901234567890(p)"),
    ("f(i" + "1" * 10 + ")", "A", "p", "f(i" + "1" * 10 + ")"),
    ("", "A", "p", ""),
    ("no placeholder", "A", "p", "no placeholder"),
    (",".join(f"i{n}" for n in range(13)), "A", "|".join("abcdefghijkl"), "A,a,b,c,d,e,f,g,h,i,j,k,l"),
    (None, "A", "p", None),
]


def test_bind_parameters(spark):
    rows = [(n, *case) for n, case in enumerate(CASES)]
    frame = spark.createDataFrame(rows, "n int, d string, s string, p string, expected string")
    bound = bind_parameters(F.col("d"), F.col("s"), F.col("p"))
    for row in frame.withColumn("bound", bound).collect():
        assert row.bound == row.expected, row


@pytest.mark.parametrize("definition, expected", [("f(i0,i1,i0)", "f(A,i1,A)"), ("i00 i0x", "i00 i0x")])
def test_bind_source_column(spark, definition, expected):
    frame = spark.createDataFrame([(definition, "A")], "d string, s string")
    assert frame.select(bind_source_column(F.col("d"), F.col("s"))).first()[0] == expected


def test_bind_parameters_like_one_pass_of_a_regular_expression(spark):
    chance = random.Random(7)
    pieces = ["i0", "i1", "i2", "i3", "i12", "i01", "bi1", "_i1", "é"]
    pieces += ["f(", ")", ",", " ", "'", "$1", "\\", "|"]
    word = lambda n: "".join(chance.choice(pieces) for _ in range(chance.randrange(n)))
    rows = [(word(12), f"c{n}", None if n % 9 == 0 else word(6)) for n in range(3000)]

    def expected(definition, source, parameters):
        values = [source, *(parameters.split("|") if parameters is not None else [])]
        place = lambda m: values[int(m[1])] if int(m[1]) < len(values) else m[0]
        return re.sub(r"\bi(0|[1-9][0-9]*)\b", place, definition)

    frame = spark.createDataFrame(rows, "d string, s string, p string")
    bound = frame.withColumn("bound", bind_parameters(F.col("d"), F.col("s"), F.col("p")))
    for row in bound.collect():
        assert row.bound == expected(row.d, row.s, row.p), row
