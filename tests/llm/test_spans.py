import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.llm import spans

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x1c\x85,", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    data, bounds = spans.flat(pa.array(texts, pa.string()))
    starts, ends, wb = spans.words(data, bounds)
    body = data.tobytes()
    for i, t in enumerate(texts):
        got = [body[a:b].decode() for a, b in zip(starts[wb[i] : wb[i + 1]], ends[wb[i] : wb[i + 1]])]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", t or "")


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_windows_and_their_hashes(texts, k):
    data, bounds = spans.flat(pa.array(texts, pa.string()))
    starts, ends, wb = spans.words(data, bounds)
    hashes = spans.window_hashes(spans.span_hashes(data, starts, ends), k)
    at = spans.window_starts(wb, k)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    want = [tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1)]
    assert len(at) == len(want)
    named = {}
    for h, w in zip(hashes[at].tolist(), want):
        assert named.setdefault(h, w) == w
    assert len(named) == len(set(want))


def test_slices_hold_every_row_once():
    batch = pa.record_batch([pa.array(["ab" * 50, None, "", "c" * 500, "d"])], names=["t"])
    parts = list(spans.slices(batch, "t", 120))
    assert [x for p in parts for x in p.column("t").to_pylist()] == batch.column("t").to_pylist()
    assert [len(p) for p in parts] == [3, 1, 1]


def test_flat_of_a_slice_and_of_nothing():
    data, bounds = spans.flat(pa.array(["xx", "abc", None, "d"])[1:])
    assert data.tobytes() == b"abcd" and bounds.tolist() == [0, 3, 3, 4]
    assert spans.flat(pa.array([], pa.string()))[1].tolist() == [0]


def test_covered():
    assert spans.covered(np.array([0, 1, 6]), 3, 8).tolist() == [True] * 4 + [False] * 2 + [True] * 2
