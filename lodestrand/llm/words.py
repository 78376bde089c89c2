"""Words and word shingles of whole texts as numbers, a batch of texts at a time.

All work is on one byte buffer per batch, by whole-array operations: a word's hash is the difference of two
polynomial prefix sums modulo 2**64, shifted back to the buffer's start by the inverse power of the (odd)
base, and finally mixed.
"""

from __future__ import annotations

import numpy as np

#: Odd base of the polynomial hash; any odd number with well-spread bits will do.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all bits (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(STEP)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(STEP)
    return x ^ (x >> np.uint64(32))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def _letters(extra: str) -> np.ndarray:
    allowed = np.zeros(256, dtype=bool)
    for c in "abcdefghijklmnopqrstuvwxyz0123456789" + extra:
        allowed[ord(c)] = True
    return allowed


WITH_UNDERSCORE, WITHOUT = _letters("_"), _letters("")


def word_hashes(texts: list[str | None], letters: np.ndarray = WITH_UNDERSCORE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets): the words of text i are hashes[offsets[i]:offsets[i + 1]].

    Texts are lower-cased; words are runs of `letters`. Null and empty texts have no words.
    """
    coded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    lengths = np.fromiter((len(c) + 1 for c in coded), dtype=np.int64, count=len(coded))
    ends = np.cumsum(lengths)
    buffer = np.frombuffer(b" ".join(coded) + b" ", dtype=np.uint8) if coded else np.zeros(0, np.uint8)
    inside = letters[buffer].view(np.int8)
    edge = np.diff(inside, prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(buffer) + 1
    sums = np.zeros(n, dtype=np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * _power("up", BASE, n)[:-1], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * _power("down", INVERSE, n)[starts] + (stops - starts).astype(np.uint64))
    offsets = np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)
    return hashes, offsets


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `width` consecutive words of one text, offsets by text)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros_like(offsets)
    run = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        run = run * np.uint64(BASE) + hashes[i : i + n]
    counts = np.maximum(np.diff(offsets) - (width - 1), 0)
    to = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(to[-1]) + np.repeat(offsets[:-1] - to[:-1], counts)
    return mix(run[at]), to


def distinct_by_text(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, ascending, as (hashes, offsets)."""
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(o[keep], minlength=len(counts)))]).astype(np.int64)


def portions(texts: list[str | None], characters: int = 1 << 20):
    """Ranges (from, to) of rows that hold about so many characters, one row at least; arrays stay small that way."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "") + 1
        if held >= characters:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: Letters of any script: a-z and every byte of a character beyond ASCII. Digits and underscores part words.
ANY_LETTER = np.zeros(256, dtype=bool)
ANY_LETTER[ord("a") : ord("z") + 1] = True
ANY_LETTER[128:] = True
