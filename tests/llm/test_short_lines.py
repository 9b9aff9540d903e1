"""Lines of one to four words take part in op9_lines and in the pipeline's line dedup."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
from examlark.llm import lines

from . import brute


def _rows():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randrange(7))) for _ in range(rnd.randrange(6)))) for i in range(150)]
    return rows + [(900, None), (901, ""), (902, " \n \t"), (903, "Next page"), (904, "next PAGE\nmore"), (905, "a b c d"), (906, "a b c d e\na b c d f"), (907, "a b c"), (908, "next page")]


def test_op9_takes_lines_of_any_length(spark, tmp_path):
    rows = _rows()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.lines_kept, r.lines_removed, r.kept_sha256) for r in lines.op9_lines(spark, str(tmp_path)).collect()}
    want = brute.without_similar_lines(rows, least=1)
    count = lambda t: 0 if t is None else len(t.split("\n"))
    assert {i: h for i, (_, _, h) in got.items()} == {i: None if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    had = dict(rows)
    gone = {i: n for i, (_, n, _) in got.items()}
    assert gone[904] == 1 and gone[906] == 2 and gone[907] == 0 and gone[908] == 1
    assert all(k + n == count(had[i]) for i, (k, n, _) in got.items() if had[i])


def test_pipeline_drops_short_copies(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.without_similar_lines(rows, least=1)
    had = dict(rows)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {i: t for i, t in want.items() if t == had[i] or brute.WORD.search(t)} and 908 not in got


def test_buckets_in_blocks_and_many_equal_rows(spark, monkeypatch):
    """Frequent prefix words are split into blocks; equal rows are compared once; ids repeat with other texts, and may be null."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i % 90 or None, "\n".join(" ".join(["same", *(rnd.choice(words) for _ in range(rnd.randrange(1, 9)))]) for _ in range(4))) for i in range(260)]
    df = spark.createDataFrame(rows + rows[:40] * 3, "doc_id long, text string").repartition(3)
    plain = sorted(((r.doc_id, r.text, r.lines_removed) for r in lines.dedup_lines(df, min_tokens=1).collect()), key=str)
    monkeypatch.setattr(lines.Lines, "frequent", lambda self, sample: [(r.w, 3) for r in sample.groupBy("w").count().filter("count > 1").collect()])
    split = sorted(((r.doc_id, r.text, r.lines_removed) for r in lines.dedup_lines(df, min_tokens=1).collect()), key=str)
    assert split == plain
    keyed = {}
    th = {(r.doc_id, r.text): (lines.NULL_ID if r.doc_id is None else r.doc_id, r.th) for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS th").distinct().collect()}
    order = sorted(th, key=th.get)
    keyed = dict(enumerate(order))
    want = brute.without_similar_lines([(k, t) for k, (_, t) in keyed.items()], least=1)
    expect = {v: want[k] for k, v in keyed.items()}
    assert sorted(((i, t) for i, t, _ in split), key=str) == sorted(((i, expect[i, t]) for i, t in rows + rows[:40] * 3), key=str)
