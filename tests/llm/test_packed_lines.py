"""Prefix words of lines travel packed, and meet as they do one by one."""

from __future__ import annotations

import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from examlark.llm import common, lines


def test_packed_columns_come_back_small():
    rnd = np.random.default_rng(1)
    n = 2000
    wide = [rnd.integers(-(1 << 63), 1 << 63, n), rnd.integers(-(1 << 63), 1 << 63, n), np.zeros(n, np.int64), np.zeros(n, np.int64)]
    cols = [np.sort(rnd.integers(-(1 << 31), -(1 << 31) + (1 << 24), n)) << 32, rnd.integers(0, 256_410, n), np.full(n, -5), rnd.integers(0, 12, n), rnd.integers(41, 128, n), rnd.integers(0, 12, n), np.full(n, 2), *wide]
    blob = lines.packed(cols)
    assert all((a == b).all() for a, b in zip(lines.unpacked(blob), cols))
    assert len(zstandard.ZstdCompressor(level=1).compress(blob)) < 26 * n  # 40 bytes as rows of a shuffle


@pytest.mark.parametrize("blocks", [0, 3])
def test_packed_lines_meet_as_rows_do(spark, monkeypatch, blocks):
    rnd = random.Random(4)
    base = [[f"w{rnd.randrange(400)}" for _ in range(rnd.choice([2, 6, 30, 60, 200]))] for _ in range(40)]
    texts = []
    for _ in range(300):
        x = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 2])):
            x[rnd.randrange(len(x))] = f"w{rnd.randrange(400)}"
        texts.append(" ".join(x))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.lit(0).cast("long").alias("th"), "text").repartition(3)
    monkeypatch.setattr(lines.Lines, "frequent", lambda self, sample: [(r.w, blocks) for r in sample.groupBy("w").count().filter("count > 9").collect()] if blocks else [])
    monkeypatch.setattr(lines, "GATHERED", 500)
    job = lines.Lines(docs, 80, 100, 1)
    rows = common.materialize(job.described(lines.word_counts(docs)), "rows")
    sample = rows.select(F.explode("prefix").alias("w"))
    found = [job.nearest(rows, sample), job.candidates(rows.select(*lines.KEY, "s", "b0", "b1", "b2", "b3", F.posexplode("prefix").alias("p", "w")), False, sample)]
    assert "Generate" not in found[0]._jdf.queryExecution().optimizedPlan().toString()
    best = [{tuple(r[c] for c in lines.X): r.apart for r in f.groupBy(*lines.X).agg(F.min("apart").alias("apart")).collect()} for f in found]
    assert best[0] == best[1] and len(best[0]) > 100
