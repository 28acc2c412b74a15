"""Words and their hashes over blocks of bytes."""

import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from assetlake.llm import words
from assetlake.llm.words import SPACED, chunks, spans


@given(st.lists(st.text("ab c\n", max_size=40), min_size=1, max_size=6), st.integers(1, 9))
def test_blocks_do_not_change_hashes(texts, block):
    for w in chunks(pa.array(texts), SPACED, lower=False):
        assert np.array_equal(spans(w.buf, w.start, w.end, block), w.hashes())
        said = [w.buf[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
        assert len(set(said)) == len(set(w.hashes().tolist()))


def test_very_long_text():
    size = 100_000_000
    text = pa.array([("some words of a very long text " * (size // 31))[: size - 6_000_000] + " " + "x" * 6_000_000])
    tracemalloc.start()
    (w,) = chunks(text, SPACED, lower=False)
    h = w.hashes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * size and len(words._powers[0]) <= 2 * words.CHUNK
    assert len(set(h[:70_000].tolist())) == 7 and len(set(h.tolist())) <= 9
