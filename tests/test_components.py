import random

from pyspark.sql import functions as F

from lodestrand.operators.components import components


def brute(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {n: top(n) for n in list(up)}


def run(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string").withColumn("node", F.lit(0))
    return {r.node: r.component for r in components(df).collect()}


def test_chain_star_and_loops(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(120)]
    random.Random(1).shuffle(chain)
    star = [("hub", f"leaf{i}") for i in range(300)]
    for edges in (chain, star, [("x", "x"), ("y", "x"), ("x", "y")], chain + star + [("hub", "n050")]):
        assert run(spark, edges) == brute(edges)


def test_random_graph(spark):
    rng = random.Random(7)
    edges = [(f"v{rng.randrange(300)}", f"v{rng.randrange(300)}") for _ in range(170)]
    assert run(spark, edges) == brute(edges)


def test_empty_and_null(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, "a"), ("b", None), ("c", "d")]) == {"c": "c", "d": "c"}
