import pytest
from pyspark.sql import functions as F

from lodestrand.operators.hierarchy import containment_links, descendants, hierarchy


def brute(links):
    up = {}
    for p, c in links:
        if p and c:
            up[c] = min(up.get(c, p), p)
    out = {}
    for node in {x for pair in links for x in pair if pair[0] and pair[1]} :
        path, at = [node], node
        while at in up and up[at] not in path:
            at = up[at]
            path.append(at)
        if at not in up:
            out[node] = (at, len(path) - 1, path[::-1])
        else:
            out[node] = ("", -1 if up[at] == node else -2, [])
    return out


def run(spark, links, **options):
    df = spark.createDataFrame(links, "parent string, child string")
    return {r.node_id: (r.root_id, r.depth, r.path) for r in hierarchy(df, **options).collect()}


CASES = {
    "chain": [(f"n{i}", f"n{i + 1}") for i in range(150)],
    "hub": [("hub", f"c{i}") for i in range(400)] + [(f"c{i}", f"d{i}") for i in range(100)],
    "ring": [(f"r{i}", f"r{(i + 1) % 37}") for i in range(37)] + [("r5", "x0")] + [(f"x{i}", f"x{i + 1}") for i in range(40)],
    "self": [("s", "s"), ("s", "t"), ("a", "b")],
    "pairs": [("a", "b"), ("b", "a"), ("b", "c"), ("p", "q"), ("p", "q")],
    "two parents": [("a", "c"), ("b", "c"), ("c", "d")],
    "blank and null": [("", "x"), ("y", ""), (None, "z"), ("z", None), ("k", "l")],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("every", [1, 3, 1_000_003])
def test_matches_a_walk_from_every_node(spark, case, every):
    links = CASES[case]
    expected = brute([x for x in links if None not in x])
    assert run(spark, links, every=every) == expected


def test_empty_links(spark):
    assert run(spark, []) == {}


def test_without_paths_and_with_other_columns(spark):
    df = spark.createDataFrame(CASES["hub"] + CASES["ring"], "parent string, child string").withColumn("node_id", F.lit(1)).withColumn("at", F.lit("?"))
    got = {r.node_id: (r.root_id, r.depth) for r in hierarchy(df, paths=False).collect()}
    assert got == {k: v[:2] for k, v in brute(CASES["hub"] + CASES["ring"]).items()}


def test_links_are_normalised(spark):
    rows = [("a", "b", " Contains "), ("c", "b", "CONTAINED_IN"), ("a", "b", "contains"), ("", "q", "contains"), ("a", "q", "calls"), ("a", "z", None), (None, "z", "contains")]
    df = spark.createDataFrame(rows, "source_id string, target_id string, type string")
    assert sorted(set(map(tuple, containment_links(df).collect()))) == [("a", "b"), ("b", "c")]


def test_descendants_of_a_hub_come_in_blocks(spark):
    nodes = hierarchy(spark.createDataFrame(CASES["hub"], "parent string, child string"))
    rows = descendants(nodes, block=50).collect()
    hub = [r for r in rows if r.node_id == "hub"]
    assert len(hub) == 10 and sorted(x for r in hub for x in r.descendants) == sorted({c for _, c in CASES["hub"]})
    assert {len(r.descendants) for r in rows if r.node_id.startswith("d")} == {0}
    assert [r for r in rows if r.node_id == "c7"][0].descendants == ["d7"]
