"""Connected components by contraction, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.plans.scratch import Scratch


def components(edges: DataFrame) -> DataFrame:
    """node, component for every end of `edges` (a, b: strings, undirected); component is the smallest node in reach.

    Each round sends every node to the smallest node among its neighbours and itself, follows these pointers to
    their ends by doubling, and contracts the edges to the ends; nodes at least halve each round, so the rounds
    grow as the logarithm of the number of nodes. A node with a third of all edges is only ever aggregated over,
    with partial sums before the shuffle. Null ends are ignored, loops and repeats are harmless.
    """
    scratch = Scratch(edges.sparkSession)
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    edges = scratch.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges0")
    labels = scratch.write(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels0")
    turn = 0
    live = edges.filter("a < b")
    while live.count():
        turn += 1
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        pointers, hop = scratch.write(pointers, f"to{turn}_0"), 0
        while True:  # pointers only lead to smaller nodes, so they end
            ahead = pointers.select(F.col("node").alias("to"), F.col("to").alias("far"))
            hop += 1
            moved = scratch.write(pointers.join(ahead, "to").select("node", "to", "far"), f"to{turn}_{hop}")
            going = moved.filter("to <> far").limit(1).count()
            pointers = moved.select("node", F.col("far").alias("to"))
            if not going:
                break
        ends = pointers.select(F.col("node").alias("component"), F.col("to").alias("end"))
        labels = scratch.write(labels.join(ends, "component", "left").select("node", F.coalesce("end", "component").alias("component")), f"labels{turn}")
        first, second = (pointers.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        live = live.join(first, "a").join(second, "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).filter("a < b").distinct()
        live = scratch.write(live, f"edges{turn}")
    return labels
