"""The de Bruijn graph of substring dedup: paths, verification, and many equal rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from examlark.llm import substring

from . import brute
from .test_llm import _passages


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("n_bytes", [1, 2])
def test_false_repeats_are_counted_again(spark, n_bytes):
    """Hashes of one or two bytes make many windows look equal that are not: those around eight words that all texts share."""
    rnd = random.Random(3)
    some = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    rows = _passages() + [(2000 + i, f"{some(40)} {' '.join('sharing')} s h {some(40)}") for i in range(300)]
    got = Counter(tuple(r) for r in substring.remove_repeats(_frame(spark, rows), n_bytes=n_bytes).collect())
    assert got == brute.without_repeats(rows, 35)


def _plain_paths(rows, k):
    """Lengths in words of the non-branching paths of repeated windows."""
    count = Counter(tuple(w[i : i + k]) for w in (brute.WORD.findall(t or "") for _, t in rows) for i in range(len(w) - k + 1))
    edges = {e for e, n in count.items() if n > 1}
    out, into = defaultdict(list), defaultdict(list)
    for e in edges:
        out[e[:-1]].append(e)
        into[e[1:]].append(e)
    through = lambda n: len(out[n]) == 1 and len(into[n]) == 1
    lengths, seen = [], set()
    for e in edges:
        if through(e[:-1]) or e in seen:
            continue
        n, at = 1, e
        seen.add(e)
        while through(at[1:]):
            at = out[at[1:]][0]
            seen.add(at)
            n += 1
        lengths.append(n + k - 1)
    rest = edges - seen
    while rest:  # cycles
        e = at = next(iter(rest))
        n = 0
        while True:
            rest.discard(at)
            n += 1
            at = out[at[1:]][0]
            if at == e:
                break
        lengths.append(n + k - 1)
    return sorted(lengths)


def test_paths_are_compacted(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    P = [" ".join(rnd.choice(words) for _ in range(n)) for n in (12, 20, 33, 60)]
    rows = [(i, " ".join(rnd.choice([*P, P[0] + " " + P[2], rnd.choice(words)]) for _ in range(4))) for i in range(40)] + [(99, "x y z " * 9), (98, P[3][5:200])]
    got = sorted(r.n_words for r in substring.repeated_passages(_frame(spark, rows), window=6).collect())
    assert got == _plain_paths(rows, 6) and len(got) > 5


def test_many_equal_rows(spark):
    rnd = random.Random(1)
    text = " ".join(f"w{rnd.randrange(300)}" for _ in range(400))
    df = spark.range(20_000).selectExpr("7L as doc_id", f"'{text}' as text")
    got = substring.remove_repeats(df).groupBy("doc_id", "n_words", "n_removed", "kept_text").count().collect()
    assert [tuple(r) for r in got] == [(7, 400, 400, "", 20_000)]
