"""Line dedup deals prefix words out, and compares a bucket, in little memory."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from examlark.llm import lines


class Caught:
    """Stands for every DataFrame of ``nearest`` and keeps the functions that it gives to mapInArrow."""

    def __init__(self) -> None:
        self.functions = []
        self.sparkSession = SimpleNamespace(conf=SimpleNamespace(get=lambda key: "51"))

    def mapInArrow(self, fn, schema):
        self.functions.append(fn)
        return self

    def first(self):
        return [2_000_000]

    def __getattr__(self, name):
        return lambda *a, **k: self


def described(n: int, per: int) -> list[pa.RecordBatch]:
    rnd = np.random.default_rng(1)
    out = []
    for at in range(0, n, 10_000):
        w = rnd.integers(-(1 << 31), 1 << 31, 10_000 * per).astype(np.int32)
        cols = [np.arange(at, at + 10_000), np.zeros(10_000, np.int64), np.full(10_000, 3, np.int32), np.full(10_000, 53, np.int32), *rnd.integers(-(1 << 63), 1 << 63, (4, 10_000))]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) + 1, per, dtype=np.int32)), pa.array(w))
        out.append(pa.RecordBatch.from_arrays([*map(pa.array, cols), lists], names=[*lines.KEY, "s", "b0", "b1", "b2", "b3", "prefix"]))
    return out


@pytest.mark.parametrize("hot", [[], [(7, 3)]])
def test_a_task_deals_its_prefix_words_in_little_memory(monkeypatch, hot):
    monkeypatch.setattr(lines, "F", SimpleNamespace(sum=lambda x: x, size=lambda x: x))
    monkeypatch.setattr(lines.Lines, "frequent", lambda self, sample: hot)
    caught, source = Caught(), described(100_000, 10)
    lines.Lines(None, 80, 100, 1).nearest(caught, caught)
    tracemalloc.start()
    got, z = [], zstandard.ZstdDecompressor()
    for batch in caught.functions[0](iter(source)):
        got.append(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 << 20, peak
    rows = [lines.unpacked(z.decompress(x.as_py())) for b in got for x in b.column(1)]
    assert sum(len(r[0]) for r in rows) == 1_000_000
    dealt = np.sort(np.concatenate([(r[0] >> 32) * 1_000_000 + r[1] * 10 + r[5] for r in rows]))
    words = np.concatenate([b.column(8).flatten().to_numpy() for b in source]).astype(np.int64)
    assert (dealt == np.sort(words * 1_000_000 + np.arange(1_000_000))).all()


def test_a_bucket_is_compared_in_little_memory():
    n, rnd = 3000, np.random.default_rng(2)
    sketch = rnd.integers(-(1 << 63), 1 << 63, (4, n))
    sketch[:, n - 1] = sketch[:, 5]
    cols = [np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int32), np.full(n, 200, np.int32), np.zeros(n, np.int32), np.full(n, 2, np.uint8), *sketch]
    table = pa.table([pa.array(c) for c in cols], names=list(lines.FACTS))
    tracemalloc.start()
    found = [r for b in lines._pairs(table, 80, 100, False) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n - 1, 5, 0) in [(r["xi"], r["yi"], r["apart"]) for r in found]
    assert peak < 60 << 20, peak
