import os
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand.llm.packing import TOKENIZER, pack, plan, slots, token_lengths


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 300), max_size=30))
def test_plan_holds_every_item_once(histogram):
    patterns = plan(histogram, 50)
    held = defaultdict(int)
    for pattern, times in patterns:
        assert times > 0 and sum(n * c for n, c in pattern) <= 50
        for n, c in pattern:
            held[n] += c * times
    assert dict(held) == {n: c for n, c in histogram.items() if c}
    rows = slots(patterns)
    for n in held:
        spans = sorted((a, b) for m, a, b, _, _ in rows if m == n)
        assert spans[0][0] == 0 and spans[-1][1] == held[n] and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_plan_is_tight_and_small():
    rng = random.Random(5)
    histogram = defaultdict(int)
    for _ in range(200_000):
        histogram[min(2048, int(rng.lognormvariate(5.2, 1)) + 1)] += 1
    patterns = plan(histogram)
    total = sum(n * c for n, c in histogram.items())
    assert sum(t for _, t in patterns) <= 1.003 * total / 2048 + 1 and len(patterns) < 4 * len(histogram)
    with pytest.raises(ValueError):
        plan({3000: 1})


def check(rows, packed, capacity):
    used, seen = defaultdict(int), defaultdict(list)
    for r in packed:
        used[r.container] += r.tokens
        seen[r.doc_id].append((r.part, r.first_token, r.tokens))
    assert sorted(used) == list(range(len(used))) and max(used.values(), default=0) <= capacity
    wanted = defaultdict(int)
    for i, n in rows:
        wanted[i] += n or 0
    assert {i: sum(t for _, _, t in p) for i, p in seen.items()} == {i: n for i, n in wanted.items() if n}
    return used, seen


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([7, 7, 7, rng.randrange(1, 130)])) for i in range(4000)] + [(9001, 1000), (9002, 100), (9003, 200), (9004, 0), (9005, None), (9006, 350)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("length", F.lit("x")).withColumn("task", F.lit(1)).repartition(7)
    used, seen = check(rows, pack(df, 100).collect(), 100)
    assert len(seen[9001]) == 10 and len(seen[9006]) == 4 and all(len(seen[i]) == 1 for i, n in rows if n and n <= 100)
    assert len(used) <= 1.02 * sum(n or 0 for _, n in rows) / 100 + 1


def test_hot_length_repeats_and_empty(spark):
    rows = [(i % 50, 30) for i in range(3000)]
    used, _ = check(rows, pack(spark.createDataFrame(rows, "doc_id long, tokens long").repartition(5), 100).collect(), 100)
    assert len(used) == 1000
    assert pack(spark.createDataFrame([], "doc_id long, tokens long"), 100).count() == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
def test_token_lengths(spark):
    rows = [(1, "one two three"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "word " * 100_000)]
    got = {r.doc_id: r.tokens for r in token_lengths(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == 3 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 100_000
