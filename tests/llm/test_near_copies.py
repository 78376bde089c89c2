import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodestrand.llm.near_copies import NearCopies


def shingles(text, width):
    w = re.findall("[a-z0-9_]+", (text or "").lower())
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(rows, width, threshold):
    sets = {i: s for i, t in rows if i is not None and (s := shingles(t, width))}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def corpus(n=120, seed=3):
    rng, words = random.Random(seed), [f"w{i}" for i in range(400)] + ["naïve", "Ünder", "x_1"]
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 12)):
                base[rng.randrange(len(base))] = rng.choice(words)
            text = " ".join(base)
        else:
            text = "licensed under the same old words as ever " + " ".join(rng.choice(words) for _ in range(rng.randrange(8, 90)))
        rows.append((f"d{i:03}", text))
    return rows + [("short", "two words"), ("none", None), ("blank", ""), (None, rows[0][1]), ("copy", rows[0][1].upper()), ("copy2", rows[0][1])]


@pytest.mark.parametrize("width,threshold", [(3, 0.5), (5, 0.8), (1, 0.3), (3, 1.0)])
def test_pairs_are_those_of_brute_force(spark, width, threshold):
    rows = corpus()
    df = spark.createDataFrame(rows, "id string, content string").repartition(5).withColumn("k", F.lit(1)).withColumn("text", F.lit("no"))
    got = {tuple(r) for r in NearCopies(df, width=width, threshold=threshold).pairs().collect()}
    assert got == brute(rows, width, threshold)


def test_hot_group_of_copies_is_one_class(spark):
    rows = corpus(60) + [(f"hot{i:04}", "the very same text again and again in a third of all the rows " * 3) for i in range(300)]
    found = NearCopies(spark.createDataFrame(rows, "id string, content string"))
    assert found.pairs(copies=16).filter("id_1 like 'hot%'").count() == 299
    groups = {r.id: r for r in found.groups().collect()}
    assert groups["hot0200"].leader == "hot0000" and groups["hot0200"].size == 300 and groups["hot0200"].links == 0
    assert groups["copy"].group_id == groups["d000"].group_id == groups["copy2"].group_id


def test_different_texts_of_a_hot_class_keep_their_links(spark):
    words = "one same set of runs for very many texts that differ in signs only".split()
    sign = lambda i: "".join(w + (", " if i >> k & 1 else " ") for k, w in enumerate(words))
    rows = [(f"s{i:03}", sign(i)) for i in range(90)] + [(f"t{i:03}", sign(5)) for i in range(90)] + [("near", sign(0) + "of all")]
    found = NearCopies(spark.createDataFrame(rows, "id string, content string"), width=3, threshold=0.5)
    got = {tuple(r) for r in found.pairs(copies=64).collect()}
    stand = [i for i, _ in rows if i[0] != "t"]  # s005 stands for its 90 copies
    assert got == {(min(a, b), max(a, b)) for a, b in combinations(stand, 2)} | {("s005", f"t{i:03}") for i in range(90)}


def test_counts_of_discards(spark):
    found = NearCopies(spark.createDataFrame(corpus(), "id string, content string"), width=3, threshold=0.5, measure=True)
    links = found.links().count()
    assert found.counts["made"] >= found.counts["after coarse sums"] >= found.counts["after all counts"] >= links > 0


def test_very_long_text_and_empty_table(spark):
    long = " ".join(f"t{i}" for i in range(200_000))
    df = spark.createDataFrame([("a", long), ("b", long + " more"), ("c", "x")], "id string, content string")
    assert [tuple(r) for r in NearCopies(df).pairs().collect()] == [("a", "b")]
    empty = NearCopies(df.filter("false"))
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        NearCopies(spark.createDataFrame([("a", "b")], "id string, content string"), threshold=0)
