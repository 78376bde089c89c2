"""Near copies: texts whose sets of word shingles reach a Jaccard similarity, without comparing all pairs.

A text's fingerprint is the bit vector over the space of shingle hashes with its shingles set, so the Hamming
distance of two fingerprints is the size of their symmetric difference. Reference fingerprints fill whole
slices of that space: of REFERENCES equal slices and every signed union of them the distances are kept as one
count per slice, and the largest difference of two texts' distances over all those references is the sum of
the differences of their counts. It never exceeds the texts' own distance, so pairs above the distance that the
threshold allows are discarded without reading their shingles; survivors are verified exactly. COARSE sums of these counts
travel with every posting, so that most pairs are discarded before they are made, the rest by all counts.

The pairs put to that test share a shingle among their rarest ones (prefix filter: with similarity t, two texts
share one of the first n - ceil(t n) + 1 shingles in any common order). The order is by document frequency, so
shingles of one text only take places but no rows. Shingles that a Misra-Gries summary of each task finds in a
large share of the texts come last in the order and are kept out of the grouping by shingle. Nothing is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.words import WITH_UNDERSCORE, distinct_by_text, mix, portions, shingle_hashes, word_hashes
from lodestrand.operators.components import components
from lodestrand.plans.scratch import Scratch

REFERENCES = 128
#: Sums of neighbouring counts that travel with postings, 16 bits each, four to a long.
COARSE = 8
#: Shingles in at least this share of the texts count as frequent; there are at most (mean shingles per text) / share.
FREQUENT = 0.005
SUMMARY = 1 << 16
#: Up to so many keys (8 bytes each) of candidates or frequent shingles are broadcast, after counting them; beyond that they are
#: joined by a shuffle.
BROADCAST_KEYS = 1_000_000

_SKETCH = "id string, k long, n int, class binary, text binary, shingles array<long>, slices array<short>, counts array<long>"


class _Frequent:
    """Misra-Gries summary over batches: counts are too low by `error` at most."""

    def __init__(self) -> None:
        self.keys, self.counts, self.error, self.texts = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0

    def add(self, hashes: np.ndarray, texts: int) -> None:
        keys, counts = np.unique(hashes, return_counts=True)
        keys, back = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([self.counts, counts]), minlength=len(keys)).astype(np.int64)
        if len(keys) > SUMMARY:
            least = int(np.partition(counts, len(counts) - SUMMARY - 1)[len(counts) - SUMMARY - 1])
            counts -= least
            self.error += least
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts, self.texts = keys, counts, self.texts + texts

    def found(self, share: float) -> tuple[np.ndarray, np.ndarray]:
        enough = self.counts + self.error >= max(2, share * self.texts)
        return self.keys[enough], self.counts[enough] + self.error


def _sketches(width: int, share: float):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _Frequent()
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int16()), pa.list_(pa.int64())]
        names = [c.split()[0] for c in _SKETCH.split(", ")]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in portions(texts):
                hashes, offsets = distinct_by_text(*shingle_hashes(*word_hashes(texts[start:stop], WITH_UNDERSCORE), width))
                counts = np.diff(offsets)
                frequent.add(hashes, stop - start)
                owner = np.repeat(np.arange(len(counts)), counts)
                slices = np.bincount(owner * REFERENCES + (hashes >> np.uint64(64 - int(math.log2(REFERENCES)))).astype(np.int64), minlength=len(counts) * REFERENCES)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + np.uint64(salt)), dtype=np.uint64)])
                    sums.append(mix(total[offsets[1:]] - total[offsets[:-1]] + counts.astype(np.uint64)))
                key = np.stack(sums, axis=1)
                keep = np.flatnonzero(counts > 0)
                if not len(keep):
                    continue
                # dropped rows have no shingles, so the offsets of the kept ones are contiguous
                to = np.concatenate([[0], np.cumsum(counts[keep])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, stop - start).take(pa.array(keep)).cast(pa.string()),
                        pa.array(sums[0][keep].view(np.int64)),
                        pa.array(counts[keep].astype(np.int32)),
                        pa.array([r.tobytes() for r in key[keep]], pa.binary()),
                        pa.array([hashlib.blake2b((texts[start + i] or "").encode("utf-8", "replace"), digest_size=16).digest() for i in keep], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(to), pa.array(hashes.view(np.int64))),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(keep) + 1, dtype=np.int32) * REFERENCES),
                            pa.array(np.minimum(slices.reshape(-1, REFERENCES)[keep], 32767).astype(np.int16).ravel()),
                        ),
                        pa.nulls(len(keep), pa.list_(pa.int64())),
                    ],
                    names=names,
                )
        keys, counts = frequent.found(share)
        if len(keys):
            row = [None, None, None, None, None, keys.view(np.int64).tolist(), None, counts.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names=names)

    return sketch


class NearCopies:
    """Near copies among the texts of df.

    df: any frame; id and text name its columns, ids are unique (of rows with one id any counts) and compared as
    strings. Rows with a null id, and texts (null and empty ones too) of fewer than `width` words, have no near
    copies. Texts with the same set of shingles form a class, led by its smallest id. measure: count what the distances to
    references discard (`counts`), which takes further jobs.
    """

    def __init__(self, df: DataFrame, id: str = "id", text: str = "content", width: int = 5, threshold: float = 0.8, share: float = FREQUENT, measure: bool = False):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        self.threshold, self.spark, self.scratch = threshold, df.sparkSession, Scratch(df.sparkSession)
        rows = df.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull())
        self.sketches = self.scratch.write(rows.mapInArrow(_sketches(width, share), _SKETCH), "sketches")
        self._share, self._links, self._members = share, None, None
        self.counts: dict[str, int] | None = {} if measure else None

    def members(self) -> DataFrame:
        """id, leader, size, text: the class of every text, named by its smallest id, how many ids it has, and a 128-bit hash
        of the text itself, which a class may have several of."""
        if self._members is None:
            texts = self.sketches.filter("counts is null").select("id", "class", "text")
            leaders = texts.groupBy("class").agg(F.min("id").alias("leader"), F.countDistinct("id").alias("size"))
            self._members = self.scratch.write(texts.join(leaders, "class").select("id", "leader", "size", "text").distinct(), "members")
        return self._members

    def links(self) -> DataFrame:
        """leader_1 < leader_2, similarity: every two classes whose similarity reaches the threshold."""
        if self._links is not None:
            return self._links
        t = self.threshold
        texts = self.sketches.filter("counts is null")
        leaders = self.members().select(F.col("leader").alias("id")).distinct()
        leaders = texts.join(leaders, "id", "left_semi").dropDuplicates(["id"])
        leaders = self.scratch.write(leaders.select("id", "k", "n", "shingles", "slices"), "leaders")
        total = leaders.count()
        frequent = self.sketches.filter("counts is not null").select(F.explode(F.arrays_zip("shingles", "counts")).alias("x"))
        frequent = frequent.groupBy(F.col("x.shingles").alias("h")).agg(F.sum("x.counts").alias("df")).filter(F.col("df") >= max(2, self._share * total))
        frequent = self.scratch.write(frequent, "frequent")
        self.scratch.drop("sketches")

        posts = leaders.select("k", F.explode("shingles").alias("h"))
        # at most (mean shingles per text) / share entries, whatever the number of texts; counted all the same
        small = frequent.count() <= BROADCAST_KEYS
        common = posts.join(F.broadcast(frequent) if small else frequent, "h").select("h", "k", "df")
        rare = posts.join(F.broadcast(frequent.select("h")) if small else frequent.select("h"), "h", "left_anti")
        rare = rare.withColumn("df", F.count("*").over(Window.partitionBy("h"))).filter("df > 1")
        shared = rare.select("h", "k", "df").unionByName(common)

        by_text = Window.partitionBy("k")
        ranked = shared.withColumn("place", F.row_number().over(by_text.orderBy("df", "h"))).withColumn("kept", F.count("*").over(by_text))
        step = REFERENCES // COARSE
        coarse = [sum((F.col("slices")[i].cast("long") for i in range(c * step + 1, (c + 1) * step)), F.col("slices")[c * step].cast("long")) for c in range(COARSE)]
        coarse = [F.least(c, F.lit(0xFFFF)) for c in coarse]
        packed = [sum((F.shiftleft(coarse[4 * w + i], 16 * i) for i in range(1, 4)), coarse[4 * w]).alias(f"c{w}") for w in range(COARSE // 4)]
        ranked = ranked.join(leaders.select("k", "n", *packed), "k")
        ranked = ranked.withColumn("place", (F.col("place") + F.col("n") - F.col("kept")).cast("int"))
        first = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1).select("h", "k", "n", "place", *(f"c{w}" for w in range(COARSE // 4)))

        part = lambda c, i: F.shiftright(c, 16 * i).bitwiseAND(0xFFFF)
        roughly = sum(F.abs(part(f"c{w}_1", i) - part(f"c{w}_2", i)) for w in range(COARSE // 4) for i in range(4))
        total = F.col("n_1") + F.col("n_2")
        most = total - 2 * F.ceil(total * (t / (1 + t)) - 1e-9)  # the distance that the threshold allows
        a, b = (first.select("h", *(F.col(c).alias(f"{c}_{i}") for c in first.columns[1:])) for i in (1, 2))
        pairs = a.join(
            b,
            (a["h"] == b["h"])
            & (F.col("k_1") < F.col("k_2"))
            & (F.least("n_1", "n_2") >= t * F.greatest("n_1", "n_2") - 1e-9)
            & (F.least(F.col("n_1") - F.col("place_1"), F.col("n_2") - F.col("place_2")) + 1 >= F.ceil((F.col("n_1") + F.col("n_2")) * (t / (1 + t)) - 1e-9)),
        )
        if self.counts is not None:
            self.counts["made"] = pairs.select("k_1", "k_2").distinct().count()
        pairs = pairs.filter(roughly <= most)
        pairs = self.scratch.write(pairs.select("k_1", "k_2").distinct(), "pairs")

        keys = pairs.select(F.explode(F.array("k_1", "k_2")).alias("k")).distinct()
        some = self.scratch.write(keys, "keys").count() <= BROADCAST_KEYS
        keys = self.spark.read.parquet(f"{self.scratch.folder}/keys")
        near = leaders.join(F.broadcast(keys) if some else keys, "k", "left_semi")
        tables = [near.select(*(F.col(c).alias(f"{c}_{i}") for c in ("k", "n", "slices"))) for i in (1, 2)]
        apart = F.aggregate(F.zip_with("slices_1", "slices_2", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
        kept = pairs.join(tables[0], "k_1").join(tables[1], "k_2").filter(apart <= most).select("k_1", "k_2")
        if self.counts is not None:
            self.counts |= {"after coarse sums": pairs.count(), "after all counts": kept.count()}

        full = [near.select(*(F.col(c).alias(f"{c}_{i}") for c in ("k", "id", "n", "shingles"))) for i in (1, 2)]
        checked = kept.join(full[0], "k_1").join(full[1], "k_2").withColumn("both", F.size(F.array_intersect("shingles_1", "shingles_2")))
        checked = checked.withColumn("similarity", F.col("both") / (total - F.col("both"))).filter(F.col("similarity") >= t)
        links = checked.select(F.least("id_1", "id_2").alias("leader_1"), F.greatest("id_1", "id_2").alias("leader_2"), "similarity")
        self._links = self.scratch.write(links, "links")
        for name in ("leaders", "pairs", "keys", "frequent"):
            self.scratch.drop(name)
        return self._links

    def groups(self) -> DataFrame:
        """id, leader, size, links, group_id: one row per text with its class, its class's links to other classes, and
        its group, all texts joined by links or sameness, named by the smallest leader."""
        ends = self.links().select(F.explode(F.array("leader_1", "leader_2")).alias("leader")).groupBy("leader").agg(F.count("*").alias("links"))
        found = components(self.links().select(F.col("leader_1").alias("a"), F.col("leader_2").alias("b")))
        return (
            self.members()
            .join(ends, "leader", "left")
            .join(found.select(F.col("node").alias("leader"), F.col("component").alias("group_id")), "leader", "left")
            .select("id", "leader", "size", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("group_id", "leader").alias("group_id"))
        )

    def pairs(self, copies: int = 64) -> DataFrame:
        """id_1 < id_2: linked ids. Different texts are always written out with one another. Of more than `copies` exact
        copies of one text, the smallest id stands for all: the others have a pair with it only."""
        members = self.members()
        alike = members.groupBy("leader", "text").agg(F.min("id").alias("first"), F.count("*").alias("same"))
        several = members.filter("size > 1").join(alike, ["leader", "text"])  # a class of one needs no look
        shown = several.filter((F.col("same") <= copies) | (F.col("id") == F.col("first"))).select("leader", "id")
        every = members.filter("size = 1").select("leader", "id").unionByName(shown)
        left = every.select(F.col("leader").alias("leader_1"), F.col("id").alias("a"))
        right = every.select(F.col("leader").alias("leader_2"), F.col("id").alias("b"))
        across = self.links().select("leader_1", "leader_2").join(left, "leader_1").join(right, "leader_2").select("a", "b")
        within = shown.select("leader", F.col("id").alias("a")).join(shown.select("leader", F.col("id").alias("b")), "leader").filter("a < b").select("a", "b")
        star = several.filter((F.col("same") > copies) & (F.col("id") != F.col("first"))).select(F.col("first").alias("a"), F.col("id").alias("b"))
        return across.union(within).union(star).select(F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2"))
