"""A slice of texts is turned into vectors in little memory."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa

from examlark.llm import langid


def test_vectors_of_a_slice_take_little_memory():
    rnd = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßé"
    texts = pa.array([" ".join("".join(rnd.choices(letters, k=rnd.randrange(2, 9))) for _ in range(330)) for _ in range(512)])
    langid.letters()
    tracemalloc.start()
    v = langid.text_vectors(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert v.shape == (512, langid.DIM) and peak < 60 << 20, peak
    assert (langid.text_vectors(texts.slice(100, 1)) == v[100:101]).all()
