"""Evaluation texts inside training texts, by multi-pattern search over words.

All runs of WINDOW consecutive words of an item that no other item has are patterns of one length, as Wu and
Manber's search wants them. Its blocks are pairs of words. The shift of a block says how far the search may jump
when that block ends the window: to the block's nearest place from the end of any pattern, or past the window
where no pattern has the block. A shift of zero leads to the bucket of patterns that end in the block, whose
words are compared one by one. While blocks are unknown the jumps have equal length, so a whole batch of texts is
tested for known blocks at those places at once, and only texts with one are searched word by word.

Patterns are searched in portions of bounded size, each by its own pass over the texts, so any number of items
can be given.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.words import BASE, WITHOUT, mix, portions, word_hashes

WINDOW = 13
#: Items are read by the driver in portions whose texts hold at most so many characters together.
PORTION = 20_000_000
_WORD = re.compile("[a-z0-9]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Patterns:
    """Shift table and suffix buckets over the windows of some items."""

    def __init__(self, windows: dict[tuple[str, ...], int], width: int = WINDOW):
        self.width, self.jump = width, width - 1
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, str], dict[tuple[str, ...], int]] = {}
        for window, item in windows.items():
            for at in range(width - 1):
                block = window[at : at + 2]
                self.shift[block] = min(self.shift.get(block, width), width - 2 - at)
            self.buckets.setdefault(window[-2:], {})[window] = item
        self.blocks = np.unique(_block_hashes([" ".join(b) for b in self.shift])) if self.shift else np.zeros(0, np.uint64)

    def suspects(self, texts: list[str | None]) -> np.ndarray:
        """Indexes of texts that have a known block at one of the places a search without known blocks would visit."""
        hashes, offsets = word_hashes(texts, WITHOUT)
        if len(hashes) < self.width or not len(self.blocks):
            return np.zeros(0, np.int64)
        blocks = mix(hashes[:-1] * np.uint64(BASE) + hashes[1:])
        counts = np.diff(offsets)
        first, visits = offsets[:-1] + self.width - 2, np.maximum((counts - self.width) // self.jump + 1, 0) * (counts >= self.width)
        owner = np.repeat(np.arange(len(counts)), visits)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(visits) - visits, visits)
        there = blocks[first[owner] + nth * self.jump]
        at = np.minimum(np.searchsorted(self.blocks, there), len(self.blocks) - 1)
        return np.unique(owner[self.blocks[at] == there])

    def search(self, text: str) -> Counter:
        """How many different windows of each item the text holds."""
        tokens, found, at = words(text), set(), self.width - 1
        while at < len(tokens):
            block = (tokens[at - 1], tokens[at])
            shift = self.shift.get(block, self.jump)
            if shift:
                at += shift
                continue
            window = tuple(tokens[at - self.width + 1 : at + 1])
            item = self.buckets[block].get(window)
            if item is not None:
                found.add((item, window))
            at += 1
        return Counter(item for item, _ in found)


def _block_hashes(blocks: list[str]) -> np.ndarray:
    hashes, offsets = word_hashes(blocks, WITHOUT)
    return mix(hashes[offsets[:-1]] * np.uint64(BASE) + hashes[offsets[:-1] + 1])


def _finder(patterns, width: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = patterns.value if hasattr(patterns, "value") else patterns
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows: list[int] = []
            items: list[int] = []
            counts: list[int] = []
            for start, stop in portions(texts):
                for i in known.suspects(texts[start:stop]):
                    for item, n in known.search(texts[start + i]).items():
                        rows.append(start + int(i))
                        items.append(item)
                        counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(counts, pa.int32())], names=["doc_id", "place", "windows"]
            )

    return find


def leaks(documents: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per document and item it holds: the document's id, the item's id, windows, share.

    A document holds an item if it has `width` consecutive words of it (runs of a-z and 0-9 after lower-casing) that
    no other item has; windows counts the item's windows found, share divides by all that are the item's own.
    Items that share their whole text with another, or have fewer than `width` words, own no window and are never
    reported. Null and empty texts hold nothing; repeated document rows give one row, with the most windows; null ids
    are ids like any other.
    """
    spark = documents.sparkSession
    if width < 2:
        raise ValueError("width must be at least 2")
    rows = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"))
    runs = rows.withColumn("w", tokens).filter(F.size("w") >= width)
    runs = runs.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (width - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(width)), " "))).alias("run"))
    runs = runs.groupBy("run").agg(F.min("item_id").alias("item_id"), F.countDistinct("item_id").alias("n")).filter("n = 1").select("run", "item_id")
    size = runs.agg(F.sum(F.length("run") + F.lit(1)).alias("n")).first()["n"] or 0
    parts = -(-size // PORTION) or 1
    found = []
    texts = documents.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    for part in range(parts):
        held = runs.filter(F.pmod(F.xxhash64("run"), F.lit(parts)) == part).collect()  # about PORTION characters
        ids = sorted({r.item_id for r in held})
        place = {x: i for i, x in enumerate(ids)}
        patterns = spark.sparkContext.broadcast(Patterns({tuple(r.run.split(" ")): place[r.item_id] for r in held}, width))
        kind, item_kind = texts.schema["doc_id"].dataType.simpleString(), rows.schema["item_id"].dataType
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"place long, item_id {item_kind.simpleString()}")
        hits = texts.mapInArrow(_finder(patterns, width), f"doc_id {kind}, place long, windows int")
        found.append(hits.groupBy("doc_id", "place").agg(F.max("windows").alias("windows")).join(names, "place").select("doc_id", "item_id", "windows"))
    total = runs.groupBy("item_id").agg(F.count("*").alias("own"))
    hits = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.sum("windows").cast("int").alias("windows"))
    return hits.join(total, "item_id").select("doc_id", "item_id", "windows", (F.col("windows") / F.col("own")).alias("share"))
