import random

from pyspark.sql import functions as F

from lodestrand.llm import leaks as module
from lodestrand.llm.leaks import leaks, words

rng = random.Random(5)
VOCABULARY = [f"v{i}" for i in range(60)]


def brute(docs, items, width):
    def windows(text):
        w = words(text)
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    sets = {}
    for i, t in items:
        sets.setdefault(i, set()).update(windows(t))
    own = {i: s - set().union(*(o for j, o in sets.items() if j != i)) for i, s in sets.items()}
    return {(d, i, len(windows(t) & s)) for d, t in docs for i, s in own.items() if windows(t) & s}


def data():
    shared = " ".join(rng.choice(VOCABULARY) for _ in range(20))
    items = [(i, (shared + ". " if i % 3 == 0 else "") + " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(3, 60)))) for i in range(25)]
    items += [(90, items[1][1]), (91, None), (92, "")]
    docs = []
    for d in range(150):
        text = [rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 80))]
        if d % 2:
            source = words(rng.choice(items[:25])[1])
            at = rng.randrange(0, len(source))
            part = source[at : at + rng.randrange(1, 40)]
            place = rng.randrange(0, len(text) + 1)
            text[place:place] = [w.upper() + rng.choice([",", " ", "_", "é"]) for w in part]
        docs.append((d, " ".join(text)))
    return docs + [(500, None), (501, ""), (502, shared)], items


def run(spark, docs, items, width):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")).repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    return {(r.doc_id, r.item_id, r.windows) for r in leaks(d, i, width=width).collect()}


def test_equals_brute_force(spark):
    docs, items = data()
    for width in (2, 5, 13):
        assert run(spark, docs, items, width) == brute(docs, items, width)


def test_in_portions(spark, monkeypatch):
    monkeypatch.setattr(module, "PORTION", 3_000)
    docs, items = data()
    assert run(spark, docs, items, 6) == brute(docs, items, 6)


def test_repeats_long_texts_and_empty_tables(spark):
    docs, items = data()
    assert run(spark, docs * 2, items * 2, 13) == brute(docs, items, 13)
    long = [(1, "filler words here " * 100_000 + items[2][1] + " and so on" * 1000)]
    assert run(spark, long, items, 5) == brute(long, items, 5)
    assert run(spark, docs[:0], items, 13) == set() == run(spark, docs, items[:0], 13)
