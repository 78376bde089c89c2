"""Cutting and packing texts, as folds over arrays of paragraphs or lines: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions.text import bound

#: White space of any kind, and a text that has anything else.
_WHITE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
_SOLID = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"
#: Characters before the end of a piece in which a boundary is looked for, and what counts as one, the best first.
LOOK_BACK, BOUNDARIES = 100, [r"\n\n", rf"\.{_WHITE}+", r"\n", rf"{_WHITE}+"]


def line_windows(text: Column, most: int, overlap: int = 0) -> Column:
    """array<struct<line_start, line_end, content>>: windows of `most` lines, each repeating `overlap` lines; blank ones drop out."""
    if not 0 <= overlap < most:
        raise ValueError("overlap must be at least 0 and below the window")
    lines = F.split(text, "\n")
    n, step = F.size(lines), most - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - overlap), F.lit(step))
    every = F.transform(starts, lambda s: F.struct(s.alias("line_start"), F.least(n, s + most - 1).alias("line_end"), F.array_join(F.slice(lines, s, F.lit(most)), "\n").alias("content")))
    return F.filter(every, lambda w: w["content"].rlike(_SOLID))


def packed(parts: Column, most: int, glue: str = "\n\n") -> Column:
    """Parts joined in order while the result stays within `most` characters; a longer part stays by itself."""
    begin = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.length(last) + len(glue) + F.length(part) <= most)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit(glue), part)))
        return F.when(F.size(done) == 0, F.array(part)).when(fits, grown).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, begin, step)


def paragraphs(text: Column, most: int = 2_000) -> Column:
    """Paragraphs packed into pieces of about `most` characters."""
    plain = F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*\n\s*"), lambda p: F.trim(p)), lambda p: p != "")
    return packed(plain, most)


def merged_small(pieces: Column, least: int) -> Column:
    """Pieces joined by a blank line to the one before while that is below `least` characters, or both together below twice
    that; blank pieces drop out."""
    begin = F.array().cast("array<string>")

    def step(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        both = F.concat(last, F.lit("\n\n"), piece)
        small = (F.length(last) < least) | (F.length(both) < 2 * least)
        return F.when(F.size(done) == 0, F.array(piece)).when(small, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(F.filter(pieces, lambda p: p.rlike(_SOLID)), begin, step)


def boundary(window: Column) -> Column:
    """End of the last boundary in a text, counted from its start: of a paragraph, else a sentence, a line, a word; 0 without any."""
    ends = [F.length(F.regexp_extract(window, rf"(?s)^(?:.*?{b})+", 0)) for b in BOUNDARIES]
    out = F.when(ends[0] > 0, ends[0])
    for end in ends[1:]:
        out = out.when(end > 0, end)
    return out.otherwise(0)


def token_windows(text: Column, tokens: int, overlap: int = 0, per_token: int = 4) -> Column:
    """Pieces of at most `tokens` tokens of four characters, ended at a boundary in their last 100 characters if there is any;
    the next one starts `overlap` tokens before the end of one. Blank pieces drop out."""
    if not 0 <= overlap < tokens:
        raise ValueError("overlap must be at least 0 and below the window")
    size, back = tokens * per_token, overlap * per_token
    n = F.length(text)
    turns = F.ceil(n / max(1, size - min(size, LOOK_BACK) - back)).cast("int") + 1  # each piece but the last gets on by so much at least
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,to:int>>").alias("cuts"))

    def step(state: Column, _turn: Column) -> Column:
        at, end = state["at"], state["at"] + size
        look = F.greatest(at, end - LOOK_BACK)
        cut = boundary(F.substring(text, look + 1, end - look))
        to = F.when(end >= n, n).when(cut > 0, look + cut).otherwise(end)
        following = F.when(end >= n, n + 1).otherwise(F.greatest(at + 1, to - back))
        grown = F.struct(following.cast("int").alias("at"), F.concat(state["cuts"], F.array(F.struct(at.alias("at"), to.cast("int").alias("to")))).alias("cuts"))
        return F.when(at < n, grown).otherwise(state)

    cuts = F.aggregate(F.sequence(F.lit(1), turns), begin, step)["cuts"]
    return F.filter(F.transform(cuts, lambda c: F.substring(text, c["at"] + 1, c["to"] - c["at"])), lambda p: p.rlike(_SOLID))


def hashed_vector(text: Column, width: int = 128, run: int = 3) -> Column:
    """Unit vector of hashed runs of three characters: the first four bytes of a run's sha256 name the cell, the fifth, less 128
    and over 128, is added to it; zero for shorter texts."""
    places = F.when(F.length(text) >= run, F.sequence(F.lit(1), F.length(text) - run + 1)).otherwise(F.array().cast("array<int>"))
    number = lambda h, at, digits: F.conv(F.substring(h, at, digits), 16, 10).cast("long")
    part = lambda h: F.struct((number(h, 1, 8) % width).alias("cell"), ((number(h, 9, 2) - 128) / 128).alias("value"))
    parts = F.transform(places, lambda i: bound(F.sha2(F.substring(text, i, F.lit(run)), 256), part))
    cells = bound(parts, lambda every: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.aggregate(F.filter(every, lambda p: p["cell"] == j), F.lit(0.0), lambda s, p: s + p["value"])))

    def unit(cells: Column) -> Column:
        return bound(F.sqrt(F.aggregate(cells, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.when(norm > 0, F.transform(cells, lambda x: x / norm)).otherwise(cells))

    return bound(cells, unit)
