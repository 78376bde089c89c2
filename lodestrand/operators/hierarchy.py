"""Parent-child links of unknown depth to root, depth, full path and descendants.

Deterministic hash splitters cut every way to the root into short stretches. Each node first chases its
pointer to the next splitter or root, doubling its stride but never passing a splitter; then the graph of
splitters alone is chased to the roots; at last each node adds what its splitter found. A join works on
open rows only, and no step depends on the depth other than by its logarithm. Nodes still open when a
round closes none run into a cycle. Nothing is gathered: pointers, paths and cycles stay distributed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.plans.scratch import Scratch

OPEN, AT_ROOT, AT_SPLITTER = 0, 1, 2
#: Up to so many counted open rows, the ids they point at are broadcast (some 100 bytes each).
FEW = 50_000


def containment_links(relationships: DataFrame) -> DataFrame:
    """(parent, child) of links `contains` and `contained_in`, whatever their case and outer blanks.

    Links with an empty, blank or null end or a null type don't count.
    """
    kind = F.lower(F.trim("type"))
    down = kind == "contains"
    return (
        relationships.filter(kind.isin("contains", "contained_in"))
        .select(
            F.when(down, F.col("source_id")).otherwise(F.col("target_id")).alias("parent"),
            F.when(down, F.col("target_id")).otherwise(F.col("source_id")).alias("child"),
        )
        .filter((F.trim("parent") != "") & (F.trim("child") != ""))
    )


def _splitter(node: Column, every: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(every)) == 0


def _chase(scratch: Scratch, state: DataFrame, name: str, path: bool) -> tuple[DataFrame, int]:
    """Double strides until no row is open or a round closes none; (state, number of open rows left).

    state: node, at, steps, kind and way (the nodes from `at` down to the parent's side, node excluded). A round writes the
    rows that were open, no others; while these are few, only what they point at is looked up.
    """
    rows = scratch.write(state, f"{name}0")
    closed, going, left, turn = [rows.filter(F.col("kind") != OPEN)], rows.filter(F.col("kind") == OPEN), -1, 0
    while (still := going.count()) and still != left:
        left, turn = still, turn + 1
        known = reduce(DataFrame.unionByName, [*closed, going])
        ahead = known.select(F.col("node").alias("at"), *(F.col(c).alias(f"a_{c}") for c in ("at", "steps", "kind", "way")))
        if still <= FEW:
            ahead = ahead.join(F.broadcast(going.select("at").distinct()), "at", "left_semi")
        none = F.col("a_at").isNull()
        moved = going.join(ahead, "at", "left").select(
            "node",
            F.coalesce("a_at", "at").alias("at"),
            (F.col("steps") + F.coalesce("a_steps", F.lit(0))).alias("steps"),
            F.when(none, AT_ROOT).otherwise(F.col("a_kind")).alias("kind"),
            (F.when(none, F.col("way")).otherwise(F.concat("a_way", "way")) if path else F.col("way")).alias("way"),
        )
        moved = scratch.write(moved.coalesce(2) if still <= FEW else moved, f"{name}{turn}")  # few rows, few files
        closed.append(moved.filter(F.col("kind") != OPEN))
        going = moved.filter(F.col("kind") == OPEN)
    return reduce(DataFrame.unionByName, [*closed, going]), still


def _on_cycle(scratch: Scratch, caught: DataFrame, name: str, count: int) -> DataFrame:
    """Nodes on cycles among `caught` (node, at), where every way runs into a cycle: the images of a long enough walk."""
    caught, stride, turn = scratch.write(caught, f"{name}0"), 1, 0
    while stride < count:
        ahead = caught.select(F.col("node").alias("at"), F.col("at").alias("a_at"))
        turn += 1
        caught = scratch.write(caught.join(ahead, "at").select("node", F.col("a_at").alias("at")), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
        stride *= 2
    return caught.select(F.col("at").alias("node")).distinct()


def hierarchy(links: DataFrame, every: int = 8, paths: bool = True) -> DataFrame:
    """One row for each id that occurs in `links` (parent, child): node_id, root_id, depth, path.

    path holds the ids from the root to the node itself. Roots have depth 0. An id on a cycle has root_id ''
    and depth -1, one below a cycle root_id '' and depth -2, both with an empty path. A child given several
    parents keeps the smallest id among them, so the result is a forest. Null and empty ends are ignored,
    repeated links count once, other columns of `links` are ignored; empty links give no rows.
    every: one node in so many is a splitter. paths=False leaves the path column null and carries no paths
    between splitters.
    """
    spark = links.sparkSession
    scratch = Scratch(spark)
    links = links.select("parent", "child").filter((F.col("parent") != "") & (F.col("child") != ""))
    tree = scratch.write(links.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("at")), "tree")
    state = tree.select(
        "node",
        "at",
        F.lit(1).cast("long").alias("steps"),
        F.when(_splitter(F.col("at"), every), AT_SPLITTER).otherwise(OPEN).alias("kind"),
        F.array("at").alias("way"),
    )
    state, caught = _chase(scratch, state, "walk", True)

    reduced = state.filter(_splitter(F.col("node"), every))
    # splitters that reached a root or a cycle without a further splitter need no chase
    short = reduced.filter(F.col("kind") != OPEN).withColumn("kind", F.when(F.col("kind") == AT_ROOT, AT_ROOT).otherwise(OPEN))
    solved, looped = _chase(scratch, short, "leap", paths)

    cycles = []
    if caught:
        rest = state.filter(F.col("kind") == OPEN).join(tree.withColumnRenamed("at", "up"), "node").select("node", F.col("up").alias("at"))
        cycles.append(_on_cycle(scratch, rest, "ring", caught))
    if looped:
        rest = solved.filter(F.col("kind") == OPEN).select("node").join(reduced.select("node", "at"), "node")
        marks = _on_cycle(scratch, rest, "loop", looped)
        cycles.append(reduced.join(marks, "node", "left_semi").select(F.explode("way").alias("node")).distinct())

    if caught:
        # a splitter may lead into a cycle that holds no splitter
        bad = reduced.filter(F.col("kind") == OPEN)
        solved = solved.unionByName(bad)
        dead = bad.select(F.col("node").alias("at"), F.lit(True).alias("dead"))
        solved = solved.join(dead, "at", "left").withColumn("kind", F.when(F.col("dead"), OPEN).otherwise(F.col("kind"))).drop("dead")

    tops = solved.select(F.col("node").alias("at"), F.col("at").alias("t_at"), F.col("steps").alias("t_steps"), F.col("kind").alias("t_kind"), F.col("way").alias("t_way"))
    found = state.join(tops, "at", "left")
    lost = (F.col("kind") == OPEN) | F.coalesce(F.col("t_kind") == OPEN, F.lit(False))
    beyond = (F.col("kind") == AT_SPLITTER) & F.col("t_at").isNotNull()
    none = F.array().cast("array<string>")
    path = F.when(lost, none).otherwise(F.concat(F.when(beyond, F.col("t_way")).otherwise(none), F.col("way"), F.array("node"))) if paths else F.lit(None).cast("array<string>")
    rows = found.select(
        F.col("node").alias("node_id"),
        F.when(lost, F.lit("")).when(beyond, F.col("t_at")).otherwise(F.col("at")).alias("root_id"),
        F.when(lost, F.lit(-2)).otherwise(F.col("steps") + F.when(beyond, F.col("t_steps")).otherwise(0)).cast("int").alias("depth"),
        path.alias("path"),
    )
    if cycles:
        marked = cycles[0] if len(cycles) == 1 else cycles[0].union(cycles[1]).distinct()
        rows = rows.join(marked.select(F.col("node").alias("node_id"), F.lit(True).alias("ring")), "node_id", "left")
        rows = rows.withColumn("depth", F.when(F.col("ring"), -1).otherwise(F.col("depth"))).drop("ring")
    roots = links.select(F.col("parent").alias("node_id")).distinct().join(tree.select(F.col("node").alias("node_id")), "node_id", "left_anti")
    return rows.unionByName(
        roots.select(
            "node_id",
            F.col("node_id").alias("root_id"),
            F.lit(0).alias("depth"),
            (F.array("node_id") if paths else F.lit(None).cast("array<string>")).alias("path"),
        )
    )


def descendants(nodes: DataFrame, block: int = 100_000) -> DataFrame:
    """All descendants of each node of hierarchy(paths=True): node_id, n_descendants, block, descendants (sorted ids).

    A node has one row while it has at most `block` descendants; beyond that its descendants are spread by
    hash over more rows of about that size, so that no task gathers an unbounded list. Leaves have one row
    with an empty list, as have nodes on or below cycles, whose path is empty.
    """
    links = nodes.select(F.explode(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))).alias("up"), F.col("node_id").alias("down"))
    sizes = links.groupBy("up").agg(F.count("*").alias("n"))
    spread = links.join(sizes, "up").withColumn("block", F.pmod(F.xxhash64("down"), F.ceil(F.col("n") / block)).cast("int"))
    lists = spread.groupBy("up", "block").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("down")).alias("d"))
    return nodes.select("node_id").join(lists.withColumnRenamed("up", "node_id"), "node_id", "left").select(
        "node_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_descendants"),
        F.coalesce("block", F.lit(0)).alias("block"),
        F.coalesce("d", F.array().cast("array<string>")).alias("descendants"),
    )
