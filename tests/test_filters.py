import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand.operators.filters import Filter, all_of, any_of, checked_field, escaped_like, fetch, from_dict, list_entities, name_matches, query, safe_pattern, where


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("1", 5, "abc"), ("2", None, "a%c"), ("3", 7, None), ("4", 7, "ABC"), ("5", 1, "")], "id string, n int, s string").cache()


def ids(df):
    return "".join(sorted(r.id for r in df.collect()))


@pytest.mark.parametrize(
    "filters,expected",
    [
        (where("n", ">", 4), "134"), (~where("n", ">", 4), "5"), (where("n", "IN", [1, 5]), "15"), (where("n", "NOT IN", [1, 5]), "34"), (where("n", "IN", []), ""), (where("n", "NOT IN", []), "12345"),
        (where("n", "IS NULL"), "2"), (where("s", "LIKE", "a%"), "12"), (where("s", "ILIKE", "a%"), "124"), (where("s", "LIKE", escaped_like("a%c")), "2"), (~where("s", "LIKE", "a%"), "45"),
        (all_of(), "12345"), (any_of(), ""), (all_of(where("n", "=", 7), None, where("s", "IS NOT NULL")), "4"), (from_dict({"OR": [{"n": 1}, {"s": None}]}), "35"), (from_dict({"n": [5, 7], "NOT": {"s": "abc"}}), "4"),
        (from_dict({"n": (">=", 5), "s": ("!=", "abc")}), "4"), (from_dict(None), "12345"),
    ],
)
def test_trees(rows, filters, expected):
    assert ids(rows.filter(filters.column())) == expected


def test_two_valued(rows):
    assert ids(rows.filter((~where("n", ">", 4)).column(two_valued=True))) == "25"


@pytest.mark.parametrize("bad", [lambda: where("a b", "=", 1), lambda: where("n", "~", 1), lambda: where("n", "=", None), lambda: where("n", "=", [1]), lambda: where("s", "LIKE", 3), lambda: Filter("not"), lambda: Filter("is_null", "n", 1), lambda: checked_field("x; drop")])
def test_refused(bad):
    with pytest.raises((ValueError, TypeError)):
        bad()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="a%_\\'\"\n ;-", max_size=8))
def test_escaped_like_matches_the_text_only(text):
    import re

    pattern = escaped_like(text)
    assert re.sub(r"\\(.)", r"\1", pattern, flags=re.S) == text


def test_injection_is_data(spark, rows):
    assert ids(rows.filter(where("s", "=", "' OR 1=1 --").column())) == ""


def test_query_sorts_before_it_cuts(rows):
    assert [r.id for r in query(rows, order=["-n"], limit=2).collect()] == ["3", "4"]
    assert [r.id for r in query(rows, order=["-n"], offset=2, limit=2).collect()] == ["1", "5"]
    assert query(rows, {"n": 7}, columns=["s"]).columns == ["id", "s"]
    with pytest.raises(ValueError):
        query(rows, limit=-1)


def test_entities(spark):
    e = spark.createDataFrame([("1", "loadRow", "Function", "src/a.py", "p"), ("1", "loadRow", "Function", "src/a.py", "p"), ("2", "saveRow", "class", "b/src/a.py", "p"), ("3", "x", "class", "c.py", "q")], "id string, name string, type string, file_path string, project_id string")
    page = list_entities(e, projects="p", path="src/a.py", pattern="*row", limit=1).collect()
    assert [(r.id, r.total, r.has_more) for r in page] == [("1", 2, True)]
    assert [r.id for r in list_entities(e, pattern="^save.*$").collect()] == ["2"]
    with pytest.raises(ValueError):
        name_matches(F.col("name"), "^(a+)+$")
    assert not safe_pattern("(") and safe_pattern("^a.*b$")
    chunks = spark.createDataFrame([("9", "f", "p", "text"), ("1", "f", "p", "text")], "id string, file_path string, project_id string, content string")
    got = {r.id: (r.found, r.place, r.content) for r in fetch([e, chunks], ["1", "9", "nope"]).collect()}
    assert got == {"1": (True, 0, None), "9": (True, 1, "text"), "nope": (False, None, None)}
    with pytest.raises(ValueError):
        fetch([e], [])
