"""Batch scorers against the plain recurrences, pair by pair."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quotelens.functions import similarity as S


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def slow_ratio(a, b):
    return 100.0 * 2 * slow_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def slow_token_set(a, b):
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    both, ra, rb = sorted(ta & tb), sorted(ta - tb), sorted(tb - ta)
    if both and (not ra or not rb):
        return 100.0
    common, x, y = (" ".join(w) for w in (both, both + ra, both + rb))
    glue = bool(common)
    d = len(" ".join(ra)) + len(" ".join(rb)) - 2 * slow_lcs(" ".join(ra), " ".join(rb))
    one = [100.0 - 100.0 * (glue + len(" ".join(r))) / (len(common) + len(z)) for r, z in ((ra, x), (rb, y))] if common else []
    return max([100.0 - 100.0 * d / (len(x) + len(y)), *one])


def slow_partial(a, b):
    def best(short, long_):
        n, m = len(short), len(long_)
        return max((slow_ratio(short, long_[max(0, e - n) : min(e, m)]) for e in range(1, m + n)), default=0.0)

    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    return max(best(short, long_), best(long_, short)) if len(a) == len(b) else best(short, long_)


def texts(draw, n, longest):
    word = lambda: "".join(draw.choice("abcé1 ") for _ in range(draw.randrange(longest)))
    return [word() for _ in range(n)]


@pytest.mark.parametrize("longest", [6, 30, 150])
def test_batches_equal_the_recurrences(longest):
    draw = random.Random(longest)
    a, b = texts(draw, 300, longest), texts(draw, 300, longest)
    a[:4], b[:4] = ["", "a", "", "x" * 200], ["", "", "b", "x" * 64]
    assert S.lcs_lengths(a, b).tolist() == [slow_lcs(x, y) for x, y in zip(a, b, strict=True)]
    assert S.token_set_scores(a, b) == pytest.approx([slow_token_set(x, y) for x, y in zip(a, b, strict=True)])
    few = slice(0, 300 if longest < 100 else 25)
    assert S.partial_scores(a[few], b[few]) == pytest.approx([slow_partial(x, y) for x, y in zip(a[few], b[few], strict=True)])
    assert len(S.lcs_lengths([], [])) == len(S.partial_scores([], [])) == len(S.token_set_scores([], [])) == 0


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", max_size=80), st.text("abc", max_size=80))
def test_any_pair(a, b):
    assert S.partial_score(a, b) == pytest.approx(slow_partial(a, b))
    assert S.lcs_lengths([a], [b])[0] == slow_lcs(a, b)
