"""Filling containers of fixed capacity with whole documents, planned on the histogram of their lengths.

Best-fit decreasing is run over counts of lengths rather than over documents: the longest length left opens as many
containers alike as its count allows, and each is filled with the longest lengths that still fit, so the plan is a list
of patterns (lengths and how often each occurs) with a number of containers. It never has more patterns than there are
lengths, times a few, and depends on the histogram alone. Documents then take their planned slots by their rank within
their length; ranks come from counts per task and length, so that no length, however common, is gathered anywhere.
Only documents longer than a container are split: into full containers and a rest that is packed like a document.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.plans.scratch import Scratch

CAPACITY = 2_048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(length, copies in one container)], containers)] that holds every item of the histogram exactly once.

    Lengths are between 1 and capacity. Each step takes the longest length left as the first item, then again and again
    the longest length that fits, as often as it fits and is left, and repeats that pattern while its lengths last.
    """
    left = {n: c for n, c in histogram.items() if c}
    lengths = sorted(left)
    if lengths and not 0 < lengths[0] <= lengths[-1] <= capacity:
        raise ValueError("lengths must be between 1 and capacity")
    patterns = []
    while lengths:
        room, pattern = capacity, []
        at = len(lengths)
        while at:
            n = lengths[at - 1]
            copies = min(room // n, left[n])
            if copies:
                pattern.append((n, copies))
                room -= copies * n
            at = bisect_right(lengths, min(room, n - 1))
        times = min(left[n] // c for n, c in pattern)
        patterns.append((pattern, times))
        for n, c in pattern:
            left[n] -= c * times
            if not left[n]:
                lengths.pop(bisect_right(lengths, n) - 1)
    return patterns


def slots(patterns: list[tuple[list[tuple[int, int]], int]], first: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, copies, first container): item of rank r takes container first + (r - from) // copies."""
    taken: dict[int, int] = {}
    rows, container = [], first
    for pattern, times in patterns:
        for n, c in pattern:
            start = taken.get(n, 0)
            rows.append((n, start, start + c * times, c, container))
            taken[n] = start + c * times
        container += times
    return rows


def _lengths(tokenizer: str, key: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(tokenizer)
        coder.encode_special_tokens = True
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes, start = [], 0
            while start < len(texts):
                stop, held = start, 0
                while stop < len(texts) and (stop == start or held + len(texts[stop] or "") < 1 << 20):
                    held += len(texts[stop] or "")
                    stop += 1
                sizes += [len(e.ids) for e in coder.encode_batch_fast([t or "" for t in texts[start:stop]], add_special_tokens=False)]
                start = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "tokens"])

    return count


def token_lengths(documents: DataFrame, tokenizer: str = TOKENIZER, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tokens: length of each text in tokens of a public tokenizer's file; null and empty texts have none."""
    rows = documents.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_lengths(tokenizer, "doc_id"), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tokens long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a task within their length, in the order in which they come."""
    import numpy as np

    seen: dict[int, int] = {}
    for batch in batches:
        lengths = batch.column("length").to_numpy()
        order = np.argsort(lengths, kind="stable")
        values, starts, counts = np.unique(lengths[order], return_index=True, return_counts=True)
        nth = np.empty(len(lengths), np.int64)
        nth[order] = np.arange(len(lengths)) - np.repeat(starts, counts) + np.repeat([seen.get(int(v), 0) for v in values], counts)
        for v, c in zip(values, counts):
            seen[int(v)] = seen.get(int(v), 0) + int(c)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], names=[*batch.schema.names, "nth"])


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Container of every document (doc_id, tokens): doc_id, part, first_token, tokens, container.

    A document of up to `capacity` tokens is one part of one container; a longer one is split into full parts, each a
    container of its own, and a rest. Documents without tokens (0 or null) take no space and have no row. Repeated
    doc_ids are separate documents. Containers are numbered from 0 without gaps: those with planned parts first.
    """
    spark = lengths.sparkSession
    scratch = Scratch(spark)
    whole = F.floor(F.col("tokens") / capacity)
    # the task's number must not change when a row is read again, so lengths are written once and counted from there
    items = lengths.select("doc_id", F.col("tokens").cast("long").alias("tokens")).filter("tokens > 0")
    items = scratch.write(items.select("doc_id", "tokens", (F.col("tokens") % capacity).alias("length"), whole.cast("long").alias("full")), "items")
    kind = items.schema["doc_id"].dataType.simpleString()
    numbered = items.mapInArrow(_numbered, f"doc_id {kind}, tokens long, length long, full long, nth long").withColumn("task", F.spark_partition_id())
    numbered = scratch.write(numbered, "numbered")
    counts = numbered.groupBy("task", "length").agg(F.count("*").alias("n"), F.sum("full").alias("full"))
    counts = scratch.write(counts, "counts")  # tasks x lengths
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    patterns = plan({r.length: r.n for r in totals if r.length}, capacity)
    planned = sum(times for _, times in patterns)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("task", "length", "start")
    ranked = numbered.join(starts, ["task", "length"]).withColumn("rank", F.col("start") + F.col("nth"))
    table = spark.createDataFrame(slots(patterns), "length long, rank_from long, rank_to long, copies long, opened long")
    # patterns are few: at most some per length, whatever the number of documents
    placed = ranked.filter("length > 0").join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    rest = placed.select(
        "doc_id",
        F.col("full").cast("int").alias("part"),
        (F.col("full") * capacity).alias("first_token"),
        ranked["length"].alias("tokens"),
        (F.col("opened") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("copies"))).cast("long").alias("container"),
    )
    # full parts: a container each, numbered by task, then by running sums within the task's lengths
    long = ranked.filter("full > 0")
    order = Window.partitionBy("task").orderBy("length", "nth").rowsBetween(Window.unboundedPreceding, -1)
    by_task = long.groupBy("task").agg(F.sum("full").alias("f"))
    tasks = scratch.write(by_task, "tasks")
    offset = tasks.withColumn("base", F.coalesce(F.sum("f").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("task", "base")  # one row per task
    parts = long.withColumn("within", F.coalesce(F.sum("full").over(order), F.lit(0))).join(F.broadcast(offset), "task")
    parts = parts.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("part"), "base", "within")
    full = parts.select("doc_id", F.col("part").cast("int").alias("part"), (F.col("part") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("tokens"), (F.lit(planned) + F.col("base") + F.col("within") + F.col("part")).cast("long").alias("container"))
    return rest.unionByName(full)
