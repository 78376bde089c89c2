"""Subject areas of documents: complement naive Bayes, refined by expectation-maximization, with calibrated posteriors.

A word's weight for a subject is the log ratio of the share of the subject's documents that have it to that of the
complement's documents, less ERRORS standard errors, so that rare words weigh little; words within NEUTRAL of even odds
weigh nothing. A document's evidence for a subject is the sum of its words' positive weights. Training starts from the
labelled documents, each spread over its labels; expectation spreads every document, labelled or not, over subjects
by squared evidence (labels act as a prior, so wrong ones fade), maximization counts again over the whole corpus.
Words are hashed into a fixed number of buckets, so the model has one size whatever the corpus.

Posteriors are independent: each subject's follows from its share of the document's evidence by a logistic curve of its
own, fitted on labelled documents. The curves share their slope and their upper limit; the middle of each is fitted to its
subject's labels and drawn to the middle of all, the more the fewer labels there are. As label sets are incomplete, the limit
is below one (the chance that a true subject was labelled) and divided out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.words import ANY_LETTER, distinct_by_text, portions, word_hashes
from lodestrand.plans.scratch import Scratch

BUCKETS = 1 << 18
ROUNDS = 3
#: Words up to so many times as frequent in a subject as in its complement (as a logarithm, after the error) don't count.
NEUTRAL = 1.0
#: Weights end here, so that words of rare subjects, whose ratios run higher, don't outweigh those of common ones.
MOST = 2.0
#: Standard errors taken off a weight, and the evidence at which an unlabelled document counts by half.
ERRORS, HALF = 1.5, 1.0
#: A word counts for a subject only if this share of the (soft) documents with it are the subject's: words of a language
#: that a small subject happens to have often stand out from its complement, but aren't its own.
OWN = 0.4
#: (Soft) documents of the subject a word needs, and documents of average words that a subject's rates start with.
LEAST, PRIOR = 1.5, 10.0
#: Labelled documents used to fit the curve: at most so many, those with the smallest hash of their id.
CALIBRATION_ROWS = 200_000


def _featuriser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for start, stop in portions(texts):
            hashes, offsets = word_hashes(texts[start:stop], ANY_LETTER)
            words, to = distinct_by_text((hashes % np.uint64(BUCKETS)).astype(np.uint64), offsets)
            owner = np.repeat(np.arange(stop - start), np.diff(offsets))
            key = owner * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64)
            counts = np.unique(key, return_counts=True)[1]
            lists = [pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(v.astype(np.int32))) for v in (words, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *lists], names=["doc_id", "words", "counts"])


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def weights(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Weights (buckets x subjects) from soft document counts of words by subject and soft numbers of documents; the last
    column holds the counts over all documents, of which those that no subject has claimed are in every complement."""
    counts, sizes, every, documents = counts[:, :-1], sizes[:-1], counts[:, -1:], sizes[-1]
    rest, others = np.maximum(every - counts, 0), np.maximum(documents - sizes, 0)
    within = (counts + PRIOR * (every + 0.5) / (documents + 1)) / (sizes + PRIOR)
    beyond = (rest + 1) / (others + 2)
    ratio = np.log(within / beyond) - ERRORS * np.sqrt(1 / (counts + 1) + 1 / (rest + 1))
    own = (counts >= LEAST) & (counts >= OWN * every)
    return np.where(own, np.clip(ratio - NEUTRAL, 0, MOST), 0).astype(np.float32)


def evidence(words: np.ndarray, counts: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Evidence (texts x subjects); a word counts by the square root of its occurrences in the text."""
    each = model[words] * np.sqrt(counts, dtype=np.float32)[:, None]
    total = np.concatenate([np.zeros((1, model.shape[1])), np.cumsum(each, axis=0, dtype=np.float64)])
    return np.maximum(total[offsets[1:]] - total[offsets[:-1]], 0)


def shares(found: np.ndarray) -> np.ndarray:
    return found / np.maximum(found.sum(1, keepdims=True), 1e-9) * (found.sum(1, keepdims=True) > 1e-6)


def _spread(found: np.ndarray | None, labels: np.ndarray) -> np.ndarray:
    """Soft membership: labels alone at first, then squared shares with labels as a prior, less for little evidence."""
    if found is None:
        return labels
    share, total = shares(found), found.sum(1, keepdims=True)
    some = labels.sum(1, keepdims=True) > 0
    soft = np.where(some, (share**2 + 0.05) * (0.1 + 0.9 * labels), share**2)
    return soft / np.maximum(soft.sum(1, keepdims=True), 1e-9) * np.where(some, 1.0, total / (total + HALF))


def _labels(column: pa.Array, subjects: int) -> np.ndarray:
    filled = [x or [0.0] * subjects for x in column.to_pylist()]
    return np.array(filled, dtype=np.float64).reshape(-1, subjects)


def _counter(model, subjects: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((BUCKETS, subjects + 1), np.float32), np.zeros(subjects + 1)
        for batch in batches:
            words, offsets = _flat(batch.column("words"))
            number, _ = _flat(batch.column("counts"))
            found = None if model is None else evidence(words, number, offsets, model.value)
            soft = _spread(found, _labels(batch.column("labels"), subjects))
            soft = np.concatenate([soft, np.ones((len(soft), 1))], axis=1)
            sizes += soft.sum(0)
            owner = np.repeat(np.arange(len(soft)), np.diff(offsets))
            for c in np.flatnonzero(soft.sum(0)):
                sums[:, c] += np.bincount(words, soft[owner, c], minlength=BUCKETS).astype(np.float32)
        rows = np.flatnonzero(sums.any(1))
        buckets = np.append(rows, -1).astype(np.int32)
        values = np.concatenate([sums[rows], sizes[None].astype(np.float32)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets), *(pa.array(values[:, c].astype(np.float64)) for c in range(subjects + 1))], names=["bucket", *(f"s{c}" for c in range(subjects + 1))]
        )

    return count


def _sharer(model, subjects: int):
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = _flat(batch.column("words"))
            number, _ = _flat(batch.column("counts"))
            found = shares(evidence(words, number, offsets, model.value))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * subjects), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, batch.column("labels")], names=["doc_id", "shares", "labels"])

    return share


#: The curve (limit, slope, middle) where fewer than LABELS second subjects are labelled, which is too few to fit any, and how far
#: (standard deviation) a subject's middle is expected from that of all.
BEFORE, LABELS, SPREAD = (0.6, 8.0, float(np.log(0.25 / 0.75))), 8, 0.2
_MIDDLES = np.arange(-3.0, 0.6, 0.1)


def _curve(x: np.ndarray, limit: float, slope: float, middle: float) -> np.ndarray:
    return limit / (1 + np.exp(-slope * (x - middle)))


def _logit(share: np.ndarray) -> np.ndarray:
    held = np.clip(share, 1e-3, 0.999)
    return np.log(held / (1 - held))


def _likelihood(x: np.ndarray, labelled: np.ndarray, weight: np.ndarray, limit: float, slope: float, middle: float) -> float:
    p = np.clip(_curve(x, limit, slope, middle), 1e-4, 1 - 1e-4)
    return float((weight * (labelled * np.log(p) + (1 - labelled) * np.log(1 - p))).sum())


def fit_curve(share: np.ndarray, labelled: np.ndarray) -> tuple[float, float, float]:
    """(limit, slope, middle) of limit / (1 + exp(-slope (logit share - middle))), by maximum likelihood over a grid; share
    and labelled belong to subjects that aren't a document's strongest."""
    if labelled.sum() < LABELS:
        return BEFORE
    x, weight = _logit(share), np.ones(len(share))
    grid = ((limit, slope, middle) for limit in np.arange(0.2, 1.0, 0.05) for slope in (1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0) for middle in _MIDDLES)
    best = max(grid, key=lambda curve: _likelihood(x, labelled.astype(np.float64), weight, *curve))
    return float(best[0]), best[1], float(best[2])


def fit_middles(share: np.ndarray, labelled: np.ndarray, subject: np.ndarray, subjects: int, curve: tuple[float, float, float]) -> np.ndarray:
    """The middle of each subject's curve: likelihood of its labels with the limit and slope of `curve`, less the squared
    distance from that curve's middle in units of SPREAD."""
    limit, slope, middle = curve
    x, out = _logit(share), np.full(subjects, middle)
    steps = middle + np.arange(-1.0, 1.01, 0.02)
    for s in range(subjects):
        own = subject == s
        score = [_likelihood(x[own], labelled[own].astype(np.float64), np.ones(own.sum()), limit, slope, m) - ((m - middle) / SPREAD) ** 2 / 2 for m in steps]
        out[s] = steps[int(np.argmax(score))]
    return out


class SubjectModel:
    """Model over `subjects` (names in order), trained on the whole of `documents` with `labels`.

    documents: doc_id, text; labels: doc_id, subject (spelling, case and outer blanks are evened out; unknown subjects
    are ignored; several annotators' labels of a document share its weight). software: the subject that stands alone.
    """

    def __init__(self, documents: DataFrame, labels: DataFrame, subjects: list[str], software: str = "software", rounds: int = ROUNDS):
        self.subjects, self.software = list(subjects), subjects.index(software) if software in subjects else None
        spark, n = documents.sparkSession, len(self.subjects)
        self.scratch = Scratch(spark)
        place = F.array_position(F.array(*(F.lit(s.strip().lower()) for s in self.subjects)), F.lower(F.trim("subject")))
        votes = labels.select("doc_id", place.alias("s")).filter("s > 0").groupBy("doc_id").pivot("s", list(range(1, n + 1))).count().na.fill(0)
        votes = votes.select("doc_id", F.array(*(F.col(str(i)) / sum(F.col(str(j)) for j in range(1, n + 1)) for i in range(1, n + 1))).alias("labels"))
        readable = documents.filter("doc_id is not null and text is not null").filter(~F.col("text").rlike(r"^[\s\p{Z}\p{C}]*$")).select("doc_id", "text")
        kind = readable.schema["doc_id"].dataType.simpleString()
        words = readable.mapInArrow(_featuriser, f"doc_id {kind}, words array<int>, counts array<int>")
        self.features = self.scratch.write(words.join(votes, "doc_id", "left").select("doc_id", "words", "counts", "labels"), "features")
        model = None
        for turn in range(rounds + 1):
            rows = self.features if turn else self.features.filter("labels is not null")
            schema = "bucket int, " + ", ".join(f"s{c} double" for c in range(n + 1))
            sums = rows.mapInArrow(_counter(model, n), schema).groupBy("bucket").agg(*(F.sum(f"s{c}").alias(f"s{c}") for c in range(n + 1)))
            table = sums.toArrow()  # BUCKETS + 1 rows at most
            counts, sizes = np.zeros((BUCKETS, n + 1)), np.zeros(n + 1)
            buckets = table.column("bucket").to_numpy()
            values = np.stack([table.column(f"s{c}").to_numpy() for c in range(n + 1)], axis=1) if len(buckets) else np.zeros((0, n + 1))
            counts[buckets[buckets >= 0]] = values[buckets >= 0]
            sizes += values[buckets == -1].sum(0)
            model = spark.sparkContext.broadcast(weights(counts, sizes))
        self.model = model
        self.shared = self.features.mapInArrow(_sharer(model, n), f"doc_id {kind}, shares array<double>, labels array<double>")
        self.curve, self.middles = self._calibrate()

    def _calibrate(self) -> tuple[tuple[float, float, float], np.ndarray]:
        """The curve of all subjects and the middle of each one's own."""
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
        share = min(1.0, 1.2 * CALIBRATION_ROWS / max(self.features.filter("labels is not null").count(), 1))
        near = self.shared.filter((place < int(share * (1 << 30))) & F.col("labels").isNotNull())  # few more than wanted reach the task that sorts them
        sample = near.orderBy(place, "doc_id").limit(CALIBRATION_ROWS).select("shares", "labels").toArrow()
        shares_, labels = (np.array(sample.column(c).to_pylist(), np.float64).reshape(-1, len(self.subjects)) for c in ("shares", "labels"))
        rest = shares_ > 0
        if len(rest):
            rest[np.arange(len(shares_)), shares_.argmax(1)] = False
        if self.software is not None:
            rest[:, self.software] = False
        curve = fit_curve(shares_[rest], labels[rest] > 0)
        return curve, fit_middles(shares_[rest], labels[rest] > 0, np.nonzero(rest)[1], len(self.subjects), curve)

    def _judged(self) -> DataFrame:
        """The documents (doc_id, judged): array of (subject, share, posterior) of the subjects with evidence."""
        slope = float(self.curve[1])
        names, middles = (F.array(*(F.lit(v) for v in values)) for values in (self.subjects, [float(m) for m in self.middles]))

        def judge(x):
            share = F.greatest(F.least(x["share"], F.lit(0.999)), F.lit(1e-6))
            posterior = 1 / (1 + F.exp(-slope * (F.log(share / (1 - share)) - x["middle"])))
            return F.struct(x["subject"].alias("subject"), x["share"].alias("share"), posterior.alias("posterior"))

        every = F.arrays_zip(names.alias("subject"), F.col("shares").alias("share"), middles.alias("middle"))
        return self.shared.select("doc_id", F.transform(F.filter(every, lambda x: x["share"] > 0), judge).alias("judged"))

    def posteriors(self) -> DataFrame:
        """doc_id, subject, share, posterior for every subject with evidence; of a document without any, `software` (or
        else no row) with share 0 and posterior 1, as such texts have no other field."""
        rows = self._judged()
        some = rows.select("doc_id", F.explode("judged").alias("x")).select("doc_id", "x.subject", "x.share", "x.posterior")
        if self.software is None:
            return some
        none = rows.filter(F.size("judged") == 0)
        return some.unionByName(none.select("doc_id", F.lit(self.subjects[self.software]).alias("subject"), F.lit(0.0).alias("share"), F.lit(1.0).alias("posterior")))

    def chosen(self) -> DataFrame:
        """doc_id, subject: the subjects whose posterior is at least one half, or, as every text is about something, the one
        with the highest where none is; `software` only where no other subject is chosen. Documents with null or blank
        text have no row; a repeated doc_id gives the rows of each of its texts, once."""
        top = F.array_max(F.transform("judged", lambda x: x["posterior"]))
        picked = F.filter("judged", lambda x: (x["posterior"] >= 0.5) | (x["posterior"] == top))
        rows = self._judged().select("doc_id", F.transform(picked, lambda x: x["subject"]).alias("names"))
        if self.software is not None:
            alone = self.subjects[self.software]
            rows = rows.withColumn("names", F.when(F.size("names") > 1, F.array_remove("names", alone)).when(F.size("names") == 0, F.array(F.lit(alone))).otherwise(F.col("names")))
        return rows.select("doc_id", F.explode("names").alias("subject")).distinct()
