"""Matching statistics of the index against plain search."""

import random

import numpy as np
import pytest

from foliant.llm.fm_index import BitVector, FmIndex


def laid_out(texts):
    return np.array([w for t in texts for w in (*t, 0)], np.int64)


def longest(word, at, end, texts, depth):
    for n in range(min(depth, end - at), 0, -1):
        own = list(word[at : at + n])
        if any(list(t[k : k + n]) == own for t in texts for k in range(len(t) - n + 1)):
            return n
    return 0


def test_ranks():
    r = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        bits = r.random(n) < 0.4
        at = np.arange(n + 1)
        assert BitVector(bits).rank(at).tolist() == [0, *np.cumsum(bits).tolist()]


@pytest.mark.parametrize("depth", [2, 4, 5, 13])
def test_matching_statistics(depth):
    r = random.Random(depth)
    for _ in range(40):
        sigma = r.choice((1, 2, 4, 9))
        make = lambda n: [r.randint(1, sigma + (n % 2)) for _ in range(n)]
        texts = [make(r.randint(0, 25)) for _ in range(r.randint(0, 5))]
        streams = [make(r.randint(0, 20)) for _ in range(4)] + [t[2:] + t[:5] for t in texts]
        index = FmIndex(laid_out(texts), depth)
        place = index.forget_places()
        word, ends = np.array([w for s in streams for w in s], np.int64), np.cumsum([len(s) for s in streams])
        matched, row = index.matching(word, ends)
        flat = laid_out(texts)
        for end, s in zip(ends, streams, strict=True):
            for at in range(end - len(s), end):
                n = longest(word, at, end, texts, depth)
                assert matched[at] == n
                if n:
                    assert flat[place[row[at]] : place[row[at]] + n].tolist() == word[at : at + n].tolist()
