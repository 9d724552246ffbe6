"""Which words of a long list may stand anywhere inside a text, in time linear in the text.

The list is known here only by a filter of fixed size over the beginnings and lengths of its words. A place of a text that
passes gives the substring of that length; the caller joins these with the list.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# the scan travels with the task, so workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 20  # the filter has 2**BITS places
STEP = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def beginnings(codes: np.ndarray, gram: int) -> list[np.ndarray]:
    """Hashes of the 1 ... `gram` code points from each place on."""
    out, rolled = [], np.zeros(len(codes), np.uint64)
    for n in range(gram):
        rolled = rolled[: len(codes) - n] * np.uint64(STEP) + codes[n:].astype(np.uint64) + np.uint64(1)
        out.append(rolled)
    return out


def places(hashes: np.ndarray, length: int) -> np.ndarray:
    """Places in the filter of beginnings of words of this length."""
    return _mix(hashes + np.uint64(length * STEP % 2**64)) >> np.uint64(64 - BITS)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def filter_places(words: list[str], gram: int) -> list[int]:
    """The filter's places of the words."""
    return [int(places(beginnings(code_points(w)[:gram], min(gram, len(w)))[-1], len(w))[0]) for w in words if w]


def possible_words(texts: list[str], known: np.ndarray, lengths: list[int], gram: int) -> tuple[np.ndarray, list[str]]:
    """(text number, substring) of each place of the texts that passes the filter `known`, equal ones once.

    Every word of the list that a text contains is among them. The texts are scanned as one array.
    """
    joined = "".join(texts)
    codes = code_points(joined)
    ends = np.cumsum([len(t) for t in texts])
    starts = beginnings(codes, min(gram, len(codes)))
    found: set[tuple[int, str]] = set()
    for n in lengths:
        if n > len(codes):
            break
        hashes = starts[min(n, gram) - 1][: len(codes) - n + 1]
        at = np.flatnonzero(known[places(hashes, n)])
        text = np.searchsorted(ends, at, "right")
        inside = at + n <= ends[text]
        found.update((t, joined[i : i + n]) for t, i in zip(text[inside].tolist(), at[inside].tolist()))
    return np.array([t for t, _ in found], np.int64), [w for _, w in found]
