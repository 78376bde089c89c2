"""Oversized texts cut into pieces at natural boundaries, with an overlap.

The offsets of a text's units (paragraphs, lines, words) are prefix sums of their lengths and of what lies between;
the sorted array of a unit's ends is searched by bisection for the last one under the limit. The next piece steps
back by the overlap, to the start of a line or word where there is one. Finer units are taken where a coarser one
doesn't fit, and a hard cut where not even a word does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1_500, 150
UNITS = ("paragraph", "line", "word", "char")
_WORD = re.compile(r"\S+")


def units(text: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of the paragraphs, lines and words of a text, ascending."""
    lines = text.split("\n")
    sizes = np.fromiter((len(x) for x in lines), np.int64, len(lines))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    full = np.fromiter((bool(x.strip(" \t\r")) for x in lines), bool, len(lines))
    edge = np.diff(full.astype(np.int8), prepend=0, append=0)
    words = np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)
    return {
        "paragraph": (starts[np.flatnonzero(edge == 1)], ends[np.flatnonzero(edge == -1) - 1]),
        "line": (starts, ends),
        "word": (words[:, 0], words[:, 1]),
    }


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int, int]]]:
    """(unit, pieces): the coarsest unit whose every instance is within the limit, and (start, end, repeated) of each
    piece; pieces cover the text, are at most `limit` long, and each repeats up to `overlap` characters."""
    found = units(text)
    unit = next((u for u in UNITS[:3] if not len(found[u][0]) or int((found[u][1] - found[u][0]).max()) <= limit), "char")
    if len(text) <= limit:
        return unit, [(0, len(text), 0)]
    levels = [found[u] for u in UNITS[UNITS.index(unit) : 3]]
    natural = [found["line"][0], found["word"][0]]
    pieces, start, done = [], 0, 0
    while True:
        if len(text) - start <= limit:
            pieces.append((start, len(text), done - start))
            return unit, pieces
        most, cut = start + limit, start + limit
        for starts, ends in levels:
            last = int(np.searchsorted(ends, most, "right")) - 1
            if last >= 0 and ends[last] > done:
                following = int(starts[last + 1]) if last + 1 < len(starts) else len(text)
                cut = min(max(following, int(ends[last])), most)
                break
        pieces.append((start, cut, done - start))
        done = cut
        back = max(cut - overlap, start + 1)
        if levels:
            nth = int(np.searchsorted(levels[0][1], cut, "right"))
            if nth < len(levels[0][1]):
                back = max(back, min(cut, int(levels[0][1][nth]) - limit))  # so that the next unit fits whole
        start = back
        for places in natural:
            at = int(np.searchsorted(places, back))
            if at < len(places) and places[at] < cut:
                start = int(places[at])
                break


def first_line(line_start: int | None, line_end: int | None, lines: int) -> int | None:
    """Number of a chunk's first line, where swapped, missing or one-sided numbers allow it."""
    known = sorted(x for x in (line_start, line_end) if x is not None and x > 0)
    if len(known) == 2 or (known and line_start == known[0]):
        return known[0]
    return max(known[0] - lines + 1, 1) if known else None


_PIECE = "id string, boundary string, piece int, pieces int, content string, line_start int, line_end int, start int, repeated int"


def _cutter(limit: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PIECE.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            out, held = [], 0
            for row in batch.to_pylist():
                text = row["content"]
                unit, pieces = split(text, limit, overlap)
                feeds = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) == 10)
                top = first_line(row["line_start"], row["line_end"], len(feeds) + 1)
                for i, (start, end, repeated) in enumerate(pieces):
                    above, within = int(np.searchsorted(feeds, start)), int(np.searchsorted(feeds, max(start, end - 1)))
                    lines = (-1, -1) if top is None else (top + above, top + within)
                    out.append((row["id"], unit, i, len(pieces), text[start:end], *lines, start, repeated))
                held += len(text)
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return cut


def oversized_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the rows of chunks (id, content, line_start, line_end) whose content is longer than `limit` characters.

    Rows of id, boundary (the coarsest unit whose every instance is within the limit: paragraph, line, word or char),
    piece and pieces (number and count), content, line_start, line_end, start (offset in characters), repeated
    (characters shared with the piece before). Lines are counted from the chunk's own first line; where its numbers
    are swapped the smaller is taken, where the first is missing it follows from the last, and where both are missing
    (null or below 1) pieces have -1. Shorter, empty and null contents have no rows; repeated rows are cut each.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    long = chunks.filter(F.length("content") > limit).select(F.col("id").cast("string").alias("id"), "content", "line_start", "line_end")
    return long.mapInArrow(_cutter(limit, overlap), _PIECE)
