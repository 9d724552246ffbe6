"""Whole batches of texts as numpy arrays of code points, words and word hashes.

A batch never holds more than `CHUNK` characters unless one text alone is longer, so memory follows the longest text and
not the size of a partition.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 500_000
# odd multiplier of the word hash modulo 2**64 and its inverse
STEP = 0x9E3779B97F4A7C15
STEP_BACK = pow(STEP, -1, 2**64)
# the highest assigned letter lies below this code point
LETTERS_END = 0x32400


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower case, is letter, is word character) by code point; a mark counts as a letter, a word has letters and digits."""
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, dtype=bool)
    word = np.zeros(0x110000, dtype=bool)
    for i in range(LETTERS_END):
        c = chr(i)
        low = c.lower()
        if len(low) == 1:
            lower[i] = ord(low)
        letter[i] = c.isalpha() or unicodedata.category(c)[0] == "M"
        word[i] = letter[i] or c.isalnum()
    return lower, letter, word


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of STEP and of its inverse."""
    for k, base in enumerate((STEP, STEP_BACK)):
        have = _powers[k]
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
        _powers[k] = have
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: Iterable[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts), each of at most CHUNK characters or of one longer text; null counts as empty."""
    first, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > CHUNK:
            yield first, part
            first, size, part = i, 0, []
        part.append(t)
        size += len(t) + 1
    if part:
        yield first, part


def code_points(part: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line break, and where each text begins (one more entry for the end)."""
    begin = np.zeros(len(part) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in part], out=begin[1:])
    raw = ("\n".join(part) + "\n").encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4"), begin


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values; the last flag is false."""
    step = np.diff(flags.view(np.int8), prepend=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashed_words(part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of all texts: (64-bit hash, begin, end) by word, and each text's first word (one more for the end)."""
    lower, _, word = tables()
    codes, begin = code_points(part)
    starts, ends = runs(word[codes])
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((lower[codes].astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    return hashes, starts, ends, np.searchsorted(starts, begin)
