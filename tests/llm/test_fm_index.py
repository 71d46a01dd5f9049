import random

import numpy as np
from hypothesis import given, settings, strategies as st

from gridcast.llm.fm_index import FMIndex, WaveletMatrix, suffix_array


def as_seq(texts):
    return np.array([c for t in texts for c in (*t, 0)], np.int64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 5), max_size=12), min_size=1, max_size=5), st.lists(st.integers(1, 5), min_size=1, max_size=4))
def test_search_and_locate(texts, pattern):
    seq = as_seq(texts)
    index = FMIndex(seq, 6, sample=4)
    lo, hi = index.search(np.array([pattern]), np.array([len(pattern)]))
    want = [i for i in range(len(seq)) if list(seq[i:i + len(pattern)]) == pattern]
    assert hi[0] - lo[0] == len(want) or (not want and hi[0] <= lo[0])
    assert sorted(index.locate(np.arange(lo[0], max(lo[0], hi[0])))) == want


def test_rank():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 37, 1000)
    matrix = WaveletMatrix(seq, 37)
    for _ in range(200):
        c, i = rng.integers(0, 37), rng.integers(0, 1001)
        assert matrix.rank(np.array([c]), np.array([i]))[0] == (seq[:i] == c).sum()
    symbols, before = matrix.at(np.arange(1000))
    assert (symbols == seq).all() and all(before[i] == (seq[:i] == seq[i]).sum() for i in range(1000))


def test_suffix_order_is_total():
    seq = as_seq([[1, 2, 1, 2], [1, 2, 1, 2], []])
    assert sorted(suffix_array(seq)) == list(range(len(seq)))


def test_matching_statistics():
    rng = random.Random(3)
    texts = [[rng.randint(1, 3) for _ in range(rng.randint(3, 15))] for _ in range(6)]
    seq = as_seq(texts)
    weights = np.ones(len(seq), np.int64)
    index = FMIndex(seq, 4, sample=0, weights=weights)
    starts = np.array([i for i in range(len(seq) - 3) if (seq[i:i + 3] > 0).all()])
    for start, got in zip(starts, index.matching(seq, starts, 3)):
        window = list(seq[start:start + 3])
        lengths = [n for n in range(4) if sum(list(seq[j:j + n]) == window[3 - n:] for j in range(len(seq) - n + 1)) >= 2]
        assert got == max(n for n in lengths if all(m in lengths for m in range(n + 1)))
