import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm.fm_index import FMIndex, WaveletMatrix, suffix_array


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(1, 5))
def test_count_and_locate(text, width):
    t = np.array(text)
    index = FMIndex(t, sample=3)
    patterns = {tuple(text[i : i + width]) for i in range(len(text) - width + 1)} | {(4,) * width, (9,) * width}
    p = np.array(sorted(patterns))
    lo, hi = index.ranges(p, np.full(len(p), width))
    for row, a, b in zip(p.tolist(), lo, hi):
        want = [i for i in range(len(text) - width + 1) if text[i : i + width] == row]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200))
def test_suffix_array_and_ranks(text):
    assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    m = WaveletMatrix(np.array(text), 4)
    at = np.arange(len(text))
    assert m.access(at).tolist() == text
    for c in range(10):
        assert m.rank(np.full(len(at), c), at).tolist() == [text[:i].count(c) for i in at]
