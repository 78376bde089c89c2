import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand.llm.splitting import first_line, oversized_pieces, split


def unit_by_hand(text, limit):
    paragraphs, run = [], []
    for line in text.split("\n") + [""]:
        if line.strip(" \t\r"):
            run.append(line)
        elif run:
            paragraphs.append("\n".join(run))
            run = []
    for name, parts in (("paragraph", paragraphs), ("line", text.split("\n")), ("word", re.findall(r"\S+", text))):
        if all(len(p) <= limit for p in parts):
            return name
    return "char"


def check(text, limit, overlap):
    unit, pieces = split(text, limit, overlap)
    assert unit == unit_by_hand(text, limit)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, _), (c, d, repeated) in zip(pieces, pieces[1:]):
        assert b - repeated == c <= b < d and 0 <= repeated <= overlap and a < c or repeated == 0
    assert all(b - a <= limit for a, b, _ in pieces)
    assert text[: pieces[0][1]] + "".join(text[a + r : b] for a, b, r in pieces[1:]) == text
    return unit, pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \t\n\r\u00e9\U0001f600", max_size=400), st.integers(3, 60), st.integers(0, 9))
def test_pieces_cover_the_text(text, limit, overlap):
    check(text, limit, min(overlap, limit - 1))


def test_cuts_at_paragraphs_where_they_fit():
    text = "\n\n".join("word " * n for n in (40, 90, 60, 120, 10, 80))
    unit, pieces = check(text, 700, 50)
    assert unit == "paragraph"
    assert all(re.search(r"\n\s*$", text[:b]) for _, b, _ in pieces[:-1])


def test_hard_cut_and_long_text():
    assert check("x" * 5000, 1500, 150)[0] == "char"
    check("line of text\n" * 100_000, 1500, 150)


def test_first_line():
    assert [first_line(*x) for x in ((5, 9, 5), (9, 5, 5), (-1, 9, 5), (None, 2, 5), (7, None, 3), (-1, -1, 2), (None, None, 2))] == [5, 5, 5, 1, 7, None, None]


def test_operator(spark):
    body = "\n".join(f"line {i} " + "x" * 40 for i in range(100))
    rows = [("a", body, 11, 110), ("b", body, 110, 11), ("c", body, -1, -1), ("d", "short", 1, 1), ("e", None, 1, 2), ("f", "", None, None), ("g", body, None, None), ("a", body, 11, 110)]
    df = spark.createDataFrame(rows, "id string, content string, line_start int, line_end int").withColumn("piece", F.lit("?"))
    got = oversized_pieces(df).collect()
    assert {r.id for r in got} == {"a", "b", "c", "g"}
    for r in got:
        if r.id in "ab":
            lines = body.split("\n")[r.line_start - 11 : r.line_end - 10]
            assert r.content.rstrip("\n") in "\n".join(lines) and len(lines) - r.content.rstrip("\n").count("\n") == 1
        else:
            assert r.line_start == r.line_end == -1
    assert sum(r.id == "a" for r in got) == 2 * sum(r.id == "b" for r in got)
    assert oversized_pieces(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        oversized_pieces(df, 10, 10)
