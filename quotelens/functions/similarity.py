"""Arrow UDFs for the character-level scorers; they run on candidate pairs only.

Longest common subsequences are counted for many pairs at once: a pair's state is a row of machine words, one bit a letter of
its first text, and one numpy step takes the next letter of every second text.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# the scorers travel with the task, so workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = 64
AT_ONCE = 4_000_000  # letter places of the pairs or windows counted together
BIT = np.uint64(1) << np.arange(WORD, dtype=np.uint64)
FULL = ~np.uint64(0)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text begins (one more for the end)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])])


class Masks:
    """For each first text, the places of each letter as bits: `of` gives a row of words for (text, letter)."""

    def __init__(self, texts: list[str]):
        codes, first = _letters(texts)
        self.lengths = np.diff(first)
        self.words = max(1, -(-int(self.lengths.max(initial=1)) // WORD))
        owner = np.repeat(np.arange(len(texts)), self.lengths)
        place = np.arange(len(codes)) - first[:-1][owner]
        self.keys, index = np.unique(owner << 21 | codes, return_inverse=True)
        self.rows = np.zeros((len(self.keys) + 1, self.words), np.uint64)  # the last row: a letter the text has not
        np.bitwise_or.at(self.rows, (index, place // WORD), BIT[place % WORD])

    def of(self, text: np.ndarray, codes: np.ndarray) -> np.ndarray:
        want = text << 21 | codes
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1) if len(self.keys) else np.zeros(len(want), np.int64)
        found = self.keys[at] == want if len(self.keys) else np.zeros(len(want), bool)
        return np.where(found, at, len(self.keys))


def _common(masks: Masks, text: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """LCS of first text `text[i]` and the letters codes[begin[i]:end[i]], for all i at once."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    text, begin, size = text[order], begin[order], size[order]
    state = np.full((len(order), masks.words), FULL, np.uint64)
    live = np.searchsorted(-size, -np.arange(1, size.max(initial=0) + 1), "right")
    for step, n in enumerate(live.tolist()):
        row = state[:n]
        hit = masks.rows[masks.of(text[:n], codes[begin[:n] + step])]
        both = row & hit
        total = row + both
        if masks.words > 1:  # carry from word to word
            carry = total < row
            for k in range(1, masks.words):
                moved = total[:, k] + carry[:, k - 1]
                carry[:, k] |= moved < total[:, k]
                total[:, k] = moved
        state[:n] = total | (row & ~hit)
    # places of the first text that were used are zero
    used = np.bitwise_count(~state).sum(axis=1, dtype=np.int64)
    out = np.empty(len(order), np.int64)
    out[order] = used
    return out


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    out = np.zeros(len(a), np.int64)
    # pairs of like length go together, so that one long text doesn't widen the rows of all
    order = sorted(range(len(a)), key=lambda i: len(a[i]))
    at = 0
    while at < len(order):
        upto, size = at, 0
        words = -(-len(a[order[at]]) // WORD)
        while upto < len(order) and (upto == at or size < AT_ONCE and -(-len(a[order[upto]]) // WORD) <= max(1, words)):
            size += len(a[order[upto]]) + len(b[order[upto]])
            upto += 1
        part = order[at:upto]
        codes, first = _letters([b[i] for i in part])
        out[part] = _common(Masks([a[i] for i in part]), np.arange(len(part)), codes, first[:-1], first[1:])
        at = upto
    return out


def _share(dist, total):
    return 100.0 - 100.0 * dist / total


def token_set_scores(a: list[str], b: list[str]) -> np.ndarray:
    """Token-set ratio of each pair: common words against common words and the rest of either side."""
    out, rest, left, right = np.zeros(len(a)), [], [], []
    sets: dict[str, set[str]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        ta, tb = (sets.get(t) or sets.setdefault(t, set(t.split())) for t in (x, y))
        if not ta or not tb:
            continue
        both = ta & tb
        if both and (both == ta or both == tb):
            out[i] = 100.0
            continue
        ra, rb = " ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))
        common = sum(map(len, both)) + max(0, len(both) - 1)
        glue = 1 if common else 0
        rest.append((i, len(ra), len(rb), common, glue))
        left.append(ra)
        right.append(rb)
    if rest:
        i, ra, rb, common, glue = np.array(rest, np.int64).T
        len_a, len_b = common + glue + ra, common + glue + rb
        best = _share(ra + rb - 2 * lcs_lengths(left, right), len_a + len_b)
        one = np.maximum(_share(glue + ra, common + len_a), _share(glue + rb, common + len_b))
        out[i] = np.where(common > 0, np.maximum(best, one), best)
    return out


def _windows(short: str, long_: str) -> tuple[list[int], list[int]]:
    """Begin and end of the windows of the longer text that can be the best one: as long as the shorter, less at both ends.

    A window whose outer letter the shorter text has not is never better than the one without it.
    """
    n, m, chars = len(short), len(long_), set(short)
    ends = [e for e in range(1, m + n) if (long_[e - 1] if e <= m else long_[e - n]) in chars]
    return [max(0, e - n) for e in ends], [min(e, m) for e in ends]


def partial_scores(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio of the shorter text against any window of the longer one, for each pair.

    Of texts of equal length each is tried as the shorter. A window is counted only if its upper bound, all of its letters
    in common as far as the whole texts have them, is above the pair's score from the full windows.
    """
    out = np.zeros(len(a))
    tries: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(a, b)):
        short, long_ = (x, y) if len(x) <= len(y) else (y, x)
        if short in long_:
            out[i] = 100.0 if short or not long_ else 0.0
            continue
        tries.append((i, short, long_))
        if len(short) == len(long_):
            tries.append((i, long_, short))
    tries.sort(key=lambda t: len(t[1]))  # rows of words of like width together
    at = 0
    while at < len(tries):
        upto, size = at, 0
        words = max(1, -(-len(tries[at][1]) // WORD))
        while upto < len(tries) and (upto == at or size < AT_ONCE // 8 and -(-len(tries[upto][1]) // WORD) <= words):
            size += len(tries[upto][1]) * (len(tries[upto][1]) + len(tries[upto][2])) // 8 + 1
            upto += 1
        _best_windows(tries[at:upto], out)
        at = upto
    return out


def _best_windows(tries: list[tuple[int, str, str]], out: np.ndarray) -> None:
    masks = Masks([short for _, short, _ in tries])
    codes, first = _letters([long_ for _, _, long_ in tries])
    spans = [_windows(short, long_) for _, short, long_ in tries]
    text = np.repeat(np.arange(len(tries)), [len(s) for s, _ in spans])
    begin = np.array([x for s, _ in spans for x in s], np.int64) + first[:-1][text]
    end = np.array([x for _, e in spans for x in e], np.int64) + first[:-1][text]
    pair = np.array([i for i, _, _ in tries])
    whole = _common(masks, np.arange(len(tries)), codes, first[:-1], first[1:])
    n, size = masks.lengths[text], end - begin
    full = size == n
    for part in (full, ~full):
        bound = _share(n + size - 2 * np.minimum(whole[text], size), n + size)
        at = np.flatnonzero(part & (bound > out[pair[text]]))
        score = _share(n[at] + size[at] - 2 * _common(masks, text[at], codes, begin[at], end[at]), n[at] + size[at])
        np.maximum.at(out, pair[text[at]], score)


def token_set_score(a: str, b: str) -> float:
    return float(token_set_scores([a], [b])[0])


def partial_score(a: str, b: str) -> float:
    return float(partial_scores([a], [b])[0])


class Words:
    """Lists of words as rows of zeros and ones over the words of both sides."""

    def __init__(self, left: list[list[str]], right: list[list[str]]):
        self.place: dict[str, int] = {}
        for words in (*left, *right):
            for w in words:
                self.place.setdefault(w, len(self.place))
        self.left, self.right = self._rows(left), self._rows(right)
        self.size = np.array([len(w) for w in self.place], np.float32)

    def _rows(self, lists):
        out = np.zeros((len(lists), max(1, len(self.place))), np.float32)
        for i, words in enumerate(lists):
            out[i, [self.place[w] for w in words]] = 1
        return out

    def common(self, weight=None) -> np.ndarray:
        """Number of words, or sum of their weights, that a left and a right list share."""
        left = self.left if weight is None else self.left * weight
        return left.astype(np.float64) @ self.right.T.astype(np.float64)


def _histogram(texts: list[str], letters: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), max(1, len(letters))), np.int32)
    for i, t in enumerate(texts):
        for c in t:
            if c != " ":
                out[i, letters.setdefault(c, len(letters))] += 1
    return out


def score_bounds(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of the token-set and the partial ratio of every text of `a` against every text of `b`.

    A common subsequence holds no more of a letter than either text. Letters of common words are left out of the rests.
    """
    sa, sb = [list(dict.fromkeys(x.split())) for x in a], [list(dict.fromkeys(x.split())) for x in b]
    words = Words(sa, sb)
    number, chars = words.common(), words.common(words.size if len(words.place) else None)
    letters = {c: i for i, c in enumerate(sorted({c for t in (*a, *b) for c in t} - {" "}))}
    ha, hb = _histogram(a, letters), _histogram(b, letters)
    shared = np.zeros((len(a), len(b)))
    for k in range(len(letters)):
        if ha[:, k].any() and hb[:, k].any():
            shared += np.minimum(ha[:, k, None], hb[None, :, k])
    many_a, many_b = np.array([len(w) for w in sa])[:, None], np.array([len(w) for w in sb])[None, :]
    long_a = np.array([sum(map(len, w)) for w in sa])[:, None] + np.maximum(many_a - 1, 0)
    long_b = np.array([sum(map(len, w)) for w in sb])[None, :] + np.maximum(many_b - 1, 0)
    common = chars + np.maximum(number - 1, 0)
    glue = (common > 0).astype(float)
    rest_a, rest_b = long_a - common - glue * (many_a > number), long_b - common - glue * (many_b > number)
    blanks = np.minimum(np.maximum(many_a - number - 1, 0), np.maximum(many_b - number - 1, 0))
    lcs = np.minimum(np.minimum(rest_a, rest_b), shared - chars + blanks)
    len_a, len_b = common + glue + rest_a, common + glue + rest_b
    best = _share(rest_a + rest_b - 2 * lcs, np.maximum(len_a + len_b, 1))
    one = np.maximum(_share(glue + rest_a, np.maximum(common + len_a, 1)), _share(glue + rest_b, np.maximum(common + len_b, 1)))
    sets = np.where(common > 0, np.maximum(best, one), best)
    sets = np.where((number > 0) & ((number == many_a) | (number == many_b)), 100.0, sets)
    n = np.minimum(np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :])
    gaps = np.minimum(np.array([x.count(" ") for x in a])[:, None], np.array([x.count(" ") for x in b])[None, :])
    most = np.minimum(shared + gaps, n)
    return sets, np.where(n > 0, 200.0 * most / np.maximum(n + most, 1), 100.0)


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(token_set_scores(a.tolist(), b.tolist()))


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(partial_scores(a.tolist(), b.tolist()))


@F.pandas_udf(DoubleType())
def letter_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of letters in common, in order: 100 for equal words."""
    x, y = a.tolist(), b.tolist()
    total = np.array([len(s) + len(t) for s, t in zip(x, y)])
    return pd.Series(_share(total - 2 * lcs_lengths(x, y), np.maximum(total, 1)))
