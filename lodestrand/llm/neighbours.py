"""The k most similar vectors of every vector, by additive quantisation.

Codebooks are full-dimensional: a vector is approximated by a sum of one word from each, found by beam search over the
residuals; its code is stored. The first words split the vectors into cells: a cell that would hold too many is split by
the next word of the code, and so on; one that is too full with all words (vectors closer than the books can tell) is
searched in portions of its members. A query visits the cells whose centres are nearest to it; there, all members are
compared exactly, whatever the cell's size. (At these widths a matrix product costs less than scoring by table lookup, and
quantisation errors are too large to rule members out.)

How many cells are visited is set by measurement: a sample of queries is compared with all vectors by brute force, and
the least number is taken that reaches `recall` on it. A neighbour in a visited cell is always found, so the recall of the
visits is that of the result. Cells are filled up to a size that doesn't grow with the data, so
the work grows as the number of vectors while that number of cells does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.plans.scratch import Scratch

#: Vectors (by smallest hash) that train the codebooks, and queries that measure recall: bounded samples.
TRAINING, PROBES = 65_536, 512
#: Members of a cell on average, at most (before it is split), and queries brought to a cell in one task.
CELL, FULL, VISITORS = 4_096, 12_288, 24_576
BOOKS, WORDS, BEAM = 8, 256, 4
#: Members of a cell compared with a block of queries at once; all of them are, one such portion after the other.
PORTION = 16_384
#: Vectors of the training sample that the books of residuals are trained on (the cells' words are trained on all of it).
BOOK_TRAINING = 16_384


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        full = counts > 0
        centres[full] = (sums[full] / counts[full, None]).astype(np.float32)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(x[i : i + 8192] @ centres.T - half).argmax(1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


class Codebooks:
    """coarse (cells x width) and books (BOOKS x words x width), trained on residuals."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.coarse = _kmeans(sample, cells, 10, rng)
        rest = sample[:BOOK_TRAINING]  # the sample is in hash order
        rest = rest - self.coarse[_nearest(rest, self.coarse)]
        books = []
        for _ in range(BOOKS):
            book = _kmeans(rest, WORDS, 5, rng)
            if len(book) < WORDS:
                book = np.concatenate([book, np.zeros((WORDS - len(book), sample.shape[1]), np.float32)])
            rest = rest - book[_nearest(rest, book)]
            books.append(book)
        self.books = np.stack(books).astype(np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(coarse word, codes) by beam search."""
        first = _nearest(x, self.coarse)
        codes = np.zeros((len(x), BOOKS), np.uint8)
        for at in range(0, len(x), 2048):
            part = slice(at, at + 2048)
            n = len(x[part])
            rests = (x[part] - self.coarse[first[part]])[:, None, :]
            chosen = np.zeros((n, 1, 0), np.uint8)
            for book in self.books:
                width = rests.shape[1]
                cost = (book**2).sum(1) - 2 * (rests.reshape(n * width, -1) @ book.T).reshape(n, width, WORDS) + (rests**2).sum(2)[:, :, None]
                cost = cost.reshape(n, width * WORDS)
                keep = min(BEAM, width * WORDS)
                best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
                row, word = best // WORDS, best % WORDS
                rests = np.take_along_axis(rests, row[:, :, None], 1) - book[word]
                chosen = np.concatenate([np.take_along_axis(chosen, row[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
            top = (rests**2).sum(2).argmin(1)
            codes[part] = chosen[np.arange(n), top]
        return first, codes


def unit_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the vectors that have `width` finite components, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.float64), nan=-1)
    rows = np.flatnonzero(lengths == width)
    flat = pc.list_flatten(column.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
    with np.errstate(over="ignore", invalid="ignore"):
        largest = np.abs(flat).max(1, initial=0)
        good = np.isfinite(largest) & (largest > 0) & ~np.isnan(flat).any(1)
        flat = flat[good] / largest[good, None]  # no overflow or underflow at any magnitude
    return rows[good], (flat / np.sqrt((flat**2).sum(1, keepdims=True))).astype(np.float32)


def _unpack(column: pa.Array, kind=np.float32) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), kind)
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return flat.reshape(len(column), -1)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values, without a copy for each."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _units(width: int):
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = unit_vectors(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)).cast(pa.string()), _binary(vectors)], names=["id", "unit"])

    return units


def _encoder(books):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpack(batch.column("unit"))
            if len(x):
                first, codes = books.value.encode(x)
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("unit"), pa.array(first.astype(np.int32)), _binary(codes)], names=["key", "unit", "first", "code"])

    return encode


def _exact(queries):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q, k = queries.value
        best, who = np.full((len(q), 0), -2.0, np.float32), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x, ids = _unpack(part.column("unit")), part.column("key").to_numpy()
                scores = q @ x.T
                scores[keys[:, None] == ids[None, :]] = -2
                scores, ids = np.concatenate([best, scores], 1), np.concatenate([who, np.broadcast_to(ids, scores.shape)], 1)
                keep = np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k]
                best, who = np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)
        if best.shape[1]:
            n = best.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, n)), pa.array(who.ravel()), pa.array(best.ravel().astype(np.float64))], names=["q", "key", "similarity"])

    return exact


class Cells:
    """Leaves of the tree of code prefixes: a centre and a number of members each, and the leaf of every code.

    tables[d] leads from an open prefix of d words and the next word on: to a leaf (its number), to an open prefix of d + 1 words
    (-2 less its number), or nowhere (-1)."""

    def __init__(self, books: Codebooks, counted):
        """counted(prefixes): {prefix and next word: number of members} of the given open prefixes; of () for the first words."""
        self.tables, self.sizes, leaves = [], [], []
        open_ = [()]
        for depth in range(BOOKS + 1):
            table = np.full((len(open_), len(books.coarse) if depth == 0 else WORDS), -1, np.int64)
            place, further = {prefix: i for i, prefix in enumerate(open_)}, []
            for prefix, n in sorted(counted(open_).items()):
                if n <= FULL or depth == BOOKS:
                    to = len(leaves)
                    leaves.append(prefix)
                    self.sizes.append(n)
                else:
                    to = -2 - len(further)
                    further.append(prefix)
                table[place[prefix[:-1]], prefix[-1]] = to
            self.tables.append(table)
            open_ = further
            if not open_:
                break
        centres = [books.coarse[p[0]] + sum(books.books[i][w] for i, w in enumerate(p[1:])) for p in leaves]
        self.centres = np.array(centres, np.float32).reshape(len(centres), -1)
        self.half = (self.centres**2).sum(1) / 2

    def of(self, first: np.ndarray, codes: np.ndarray) -> np.ndarray:
        at = self.tables[0][0][first]
        for d, table in enumerate(self.tables[1:]):
            on = at < -1
            at[on] = table[-2 - at[on], codes[on, d]]
        return at.astype(np.int32)

    def ranked(self, x: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        """The n leaves to visit: a vector's own first, then the others by distance of their centres."""
        score = x @ self.centres.T - self.half
        score[np.arange(len(x)), own] = np.inf
        n = min(n, score.shape[1])
        part = np.argpartition(-score, n - 1, axis=1)[:, :n]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(score, part, 1), axis=1, kind="stable"), 1).astype(np.int32)

    def ranks(self, x: np.ndarray, own: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """How many leaves a vector visits before a given one."""
        score = x @ self.centres.T - self.half
        wanted = score[np.arange(len(x)), leaves]
        score[np.arange(len(x)), own] = np.inf
        return np.where(leaves == own, 0, (score > wanted[:, None]).sum(1))


def _router(cells, visits: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = cells.value.of(part.column("first").to_numpy(), _unpack(part.column("code"), np.uint8))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("unit"), pa.array(own), pa.array(np.ones(len(own), bool))], names=["key", "unit", "cell", "member"])
                if visits > 1:
                    goes = cells.value.ranked(_unpack(part.column("unit")), own, visits)[:, 1:]
                    rows = pa.array(np.repeat(np.arange(len(own)), goes.shape[1]))
                    yield pa.RecordBatch.from_arrays([part.column("key").take(rows), part.column("unit").take(rows), pa.array(goes.ravel()), pa.array(np.zeros(len(rows), bool))], names=["key", "unit", "cell", "member"])

    return route


def search_cell(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int):
    """(ids, similarities) of the best k of a cell's members for every query: all members are compared."""
    keep = min(k, len(ids))
    out_ids, out = np.zeros((len(q), keep), np.int64), np.zeros((len(q), keep), np.float32)
    for at in range(0, len(q), 512):
        block, asks = q[at : at + 512], query_ids[at : at + 512, None]
        best, who = np.zeros((len(block), 0), np.float32), np.zeros((len(block), 0), np.int64)
        for start in range(0, len(ids), PORTION):
            own = ids[start : start + PORTION]
            scores = block @ x[start : start + PORTION].T
            scores[asks == own] = -2
            top = np.argpartition(-scores, min(keep, len(own)) - 1, axis=1)[:, :keep]
            best, who = np.concatenate([best, np.take_along_axis(scores, top, 1)], 1), np.concatenate([who, own[top]], 1)
            order = np.lexsort((who, -best))[:, :keep]
            best, who = np.take_along_axis(best, order, 1), np.take_along_axis(who, order, 1)
        out[at : at + 512], out_ids[at : at + 512] = best, who
    return out_ids, out


def _searcher(k: int):
    def search(table: pa.Table) -> pa.Table:
        member = table.column("member").to_numpy(zero_copy_only=False).astype(bool)
        keys, units = table.column("key").to_numpy(), _unpack(table.column("unit"))
        rows = np.flatnonzero(member)
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        if not len(rows) or not asks.any():
            return pa.table({"q": pa.array([], pa.int64()), "keys": pa.array([], pa.list_(pa.int64())), "similarities": pa.array([], pa.list_(pa.float32()))})
        order = rows[np.argsort(keys[rows], kind="stable")]
        found, similar = search_cell(keys[order], units[order], keys[asks], units[asks], k)
        offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
        return pa.table({"q": keys[asks], "keys": pa.ListArray.from_arrays(offsets, pa.array(found.ravel())), "similarities": pa.ListArray.from_arrays(offsets, pa.array(similar.ravel()))})

    return search


class Neighbours:
    """The k most similar other vectors of every vector of df (id, vector), by cosine similarity.

    id and vector name columns of df; ids are compared as strings, null ids drop out, and of rows with one id any counts.
    Vectors that are null, all zero, not finite or not `width` long match nothing and are not matched. Equal vectors form
    a class that is searched once; among equals the smaller ids come first. recall: what the visits to cells must reach
    on the sample of queries compared by brute force.
    """

    def __init__(self, df: DataFrame, id: str = "id", vector: str = "vector", k: int = 5, width: int = 64, recall: float = 0.95):
        self.spark, self.k, self.scratch = df.sparkSession, k, Scratch(df.sparkSession)
        rows = df.select(F.col(id).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter("id is not null")
        units = rows.mapInArrow(_units(width), "id string, unit binary").dropDuplicates(["id"])
        units = self.scratch.write(units.withColumn("class", F.xxhash64("unit", F.lit(1))).withColumn("class2", F.xxhash64("unit", F.lit(2))), "units")
        classes = units.groupBy("class", "class2").agg(F.min("id").alias("leader"), F.count("*").alias("size"))
        several = classes.filter("size > 1")
        # (leader, id) of equal vectors; few rows unless vectors repeat
        self.equal = self.scratch.write(units.select("id", "class", "class2").join(several, ["class", "class2"]).select("leader", "id", "size"), "equal")
        followers = self.equal.filter("id <> leader").select("id")
        leaders = units.select("id", "unit").join(followers, "id", "left_anti").withColumn("key", F.monotonically_increasing_id())
        self.vectors = self.scratch.write(leaders, "vectors")  # keys are fixed by being written
        self.scratch.drop("units")
        self.count = self.vectors.count()
        self.recall_of_visits, self.visits = 1.0, 1
        self._lists = self._search(recall) if self.count > 1 else None

    def _search(self, recall: float) -> DataFrame:
        context, k = self.spark.sparkContext, self.k
        share = min(1.0, 1.2 * TRAINING / self.count)  # few more than wanted reach the task that sorts them
        near = self.vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        sample = near.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id").limit(TRAINING).select("key", "unit").toArrow()
        keys, train = sample.column("key").to_numpy(), _unpack(sample.column("unit"))
        books = context.broadcast(Codebooks(train, int(np.clip(round(self.count / CELL), 1, 16_384))))
        coded = self.vectors.select("key", "unit").mapInArrow(_encoder(books), "key long, unit binary, first int, code binary")
        coded = self.scratch.write(coded, "coded")
        word = [F.col("first"), *(F.conv(F.hex(F.substring("code", i + 1, 1)), 16, 10).cast("int") for i in range(BOOKS))]

        def counted(prefixes: list[tuple[int, ...]]) -> dict[tuple[int, ...], int]:
            """One row for each next word of the prefixes: of the first words, then of those alone that are too full."""
            depth = len(prefixes[0])
            rows = coded.select(*(c.alias(f"w{i}") for i, c in enumerate(word[: depth + 1])))
            if depth:
                names = [f"w{i}" for i in range(depth)]
                rows = rows.join(F.broadcast(self.spark.createDataFrame(prefixes, ", ".join(f"{n} int" for n in names))), names, "left_semi")
            return {tuple(r[:-1]): r[-1] for r in rows.groupBy(*(f"w{i}" for i in range(depth + 1))).count().collect()}

        cells = Cells(books.value, counted)
        shared = context.broadcast(cells)

        asked, probes = keys[:PROBES], train[:PROBES]
        queries = context.broadcast((asked, probes, k))
        truth = self.vectors.select("key", "unit").mapInArrow(_exact(queries), "q long, key long, similarity double")
        truth = truth.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "key"))).filter(F.col("n") <= k)
        truth = truth.select("q", "key").unionByName(self.spark.createDataFrame([(int(x), int(x)) for x in asked], "q long, key long"))
        truth = truth.join(coded.select("key", "first", "code"), "key").select("q", "key", "first", "code").toArrow()  # PROBES * (k + 1) rows
        row = np.array([{int(x): i for i, x in enumerate(asked)}[int(q)] for q in truth.column("q").to_numpy()], np.int64)
        leaf = cells.of(truth.column("first").to_numpy(), _unpack(truth.column("code"), np.uint8))
        itself = truth.column("q").to_numpy() == truth.column("key").to_numpy()
        own = np.zeros(len(asked), np.int32)
        own[row[itself]] = leaf[itself]
        row, leaf = row[~itself], leaf[~itself]
        ranks = np.concatenate([cells.ranks(probes[row[i : i + 64]], own[row[i : i + 64]], leaf[i : i + 64]) for i in range(0, len(row), 64)])
        self.visits = int(np.sort(ranks)[min(int(np.ceil(recall * len(ranks))), len(ranks)) - 1]) + 1
        self.recall_of_visits = float((ranks < self.visits).mean())

        routed = coded.mapInArrow(_router(shared, self.visits), "key long, unit binary, cell int, member boolean")
        # a cell with many visitors or members is searched in parts: a share of the queries meets a share of the members in each
        loads = routed.groupBy("cell").agg(F.count("*").alias("n"))
        visitors = {r.cell: r.n for r in loads.filter(F.col("n") > VISITORS).collect()}  # at most one a leaf
        parts = {c: (-(-visitors.get(c, 1) // VISITORS), -(-n // FULL)) for c, n in enumerate(cells.sizes) if c in visitors or n > FULL}
        routed = routed.withColumn("part", F.lit(0)).withColumn("asks", F.lit(True))
        if parts:
            table = self.spark.createDataFrame([(c, q, m) for c, (q, m) in parts.items()], "cell int, qs int, ms int")
            routed = routed.join(F.broadcast(table), "cell", "left").withColumns({"qs": F.coalesce("qs", F.lit(1)), "ms": F.coalesce("ms", F.lit(1))})
            routed = routed.withColumns({"q": F.pmod(F.xxhash64("key"), F.col("qs")), "m": F.pmod(F.xxhash64("key", F.lit(1)), F.col("ms"))})
            routed = routed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("qs") * F.col("ms") - 1)))
            here = (F.col("part") % F.col("ms")) == F.col("m")
            routed = routed.withColumns({"member": F.col("member") & here, "asks": F.floor(F.col("part") / F.col("ms")) == F.col("q")}).filter("member or asks")
        routed = routed.select("cell", "part", "key", "unit", "member", "asks")
        found = routed.groupBy("cell", "part").applyInArrow(_searcher(k), "q long, keys array<long>, similarities array<float>")
        pairs = found.groupBy("q").agg(F.collect_list(F.arrays_zip("keys", "similarities")).alias("x"))  # `visits` short lists each
        pairs = pairs.select("q", F.filter(F.flatten("x"), lambda p: p["similarities"] > -2).alias("x"))
        best = F.slice(F.array_sort("x", lambda a, b: F.when(a["similarities"] > b["similarities"], -1).when(a["similarities"] < b["similarities"], 1).when(a["keys"] < b["keys"], -1).when(a["keys"] > b["keys"], 1).otherwise(0)), 1, k)
        lists = self.scratch.write(pairs.select("q", best.alias("x")), "lists")
        self.scratch.drop("coded")
        return lists

    def pairs(self, least: float = -1.0) -> DataFrame:
        """id, neighbour, similarity, rank: for every vector, its k most similar others (equal ones have similarity 1 and
        come first, by id), as far as they reach `least`."""
        k, equal = self.k, self.equal
        schema = "q long, key long, similarity float, n int"
        if self._lists is None:
            between = self.spark.createDataFrame([], schema)
        else:
            between = self._lists.select("q", F.posexplode("x").alias("n", "p")).select("q", F.col("p.keys").alias("key"), F.col("p.similarities").alias("similarity"), (F.col("n") + 1).alias("n"))
        between = between.filter(F.col("similarity") >= least)
        names = self.vectors.select("key", "id")
        between = between.join(names, "key").withColumnRenamed("id", "neighbour").join(names.withColumnRenamed("key", "q"), "q").select("id", "neighbour", "similarity")
        # the first ids of each class stand for it in the lists of others; of its own members each has k others at most
        shown = equal.withColumn("m", F.row_number().over(Window.partitionBy("leader").orderBy("id"))).filter(F.col("m") <= k + 1)
        as_found = shown.filter(F.col("m") <= k).select(F.col("leader").alias("neighbour"), F.col("id").alias("also"))
        between = between.join(as_found, "neighbour", "left").select("id", F.coalesce("also", "neighbour").alias("neighbour"), "similarity")
        everyone = equal.select(F.col("leader").alias("id"), F.col("id").alias("member"), "size")
        # a class with k or more others has no room for anyone else
        between = between.join(everyone, "id", "left").filter(F.coalesce("size", F.lit(1)) <= k).select(F.coalesce("member", "id").alias("id"), "neighbour", "similarity")
        within = equal.select("leader", "id").join(shown.select("leader", F.col("id").alias("neighbour")), "leader").filter("id <> neighbour").select("id", "neighbour", F.lit(1.0).cast("float").alias("similarity"), F.lit(0).alias("o"))
        every = within.unionByName(between.withColumn("o", F.lit(1)))
        rank = F.row_number().over(Window.partitionBy("id").orderBy("o", F.desc("similarity"), "neighbour"))
        return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "neighbour", "similarity", "rank")
