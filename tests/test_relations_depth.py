"""Relations over graphs of many edges: few jobs of the driver, and the same result by whichever way."""

from __future__ import annotations

import random

import pytest
from examlark.operators import relations
from test_sizes import same


def jobs(spark, run) -> int:
    """The jobs that a function starts."""
    spark.sparkContext.setJobGroup(name := f"jobs of {random.random()}", "")
    try:
        run()
    finally:
        spark.sparkContext.setJobGroup("other", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def plain(edges: set[tuple]) -> tuple[dict, dict]:
    """Levels and cycles."""
    nodes, after = {x for e in edges for x in e}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = {}
    for x in nodes:
        got, now = set(), {x}
        while now:
            now = {y for z in now for y in after.get(z, ())} - got
            got |= now
        reach[x] = got
    rings = {x: min(y for y in reach[x] if x in reach[y]) for x in nodes if x in reach[x]}
    bad = set(rings).union(*(reach[x] for x in rings))
    levels = dict.fromkeys(nodes)
    now, n = {x for x in nodes - bad if not any(b == x for _, b in edges)}, 0
    while now:
        levels |= dict.fromkeys(now, n)
        now, n = {b for a, b in edges if a in now and b not in bad}, n + 1
    return levels, rings


def test_knowledge_levels_starts_few_jobs(spark, tmp_path):
    """The driver keeps every job and plan: 857 jobs filled its memory at 120,000 parts."""
    assert jobs(spark, lambda: same(spark, tmp_path, "knowledge_levels", part="SELECT range AS p_partkey FROM range(2000)")) < 60


@pytest.mark.parametrize("alone", [0, 40, 10**6])
def test_levels_and_rings_by_steps_and_in_one_task(spark, monkeypatch, alone):
    """Between none and all of the edges are left to one task; a long way, a ring behind it, a loop, ends that are null."""
    monkeypatch.setattr(relations, "ALONE", alone)
    monkeypatch.setattr(relations, "FEW", 2)
    dice = random.Random(8)
    edges = {(x, x + dice.randrange(1, 9)) for x in range(60) for _ in range(2)} | {(x, x - dice.randrange(1, 5)) for x in range(30, 60, 4)} | {(100 + i, 101 + i) for i in range(9)} | {(109, 107), (60, 100), (200, 200), (45, 45)} | {(300 + i, 400 + i % 3) for i in range(8)}
    levels, rings = plain(edges)
    assert len(set(rings.values())) > 3 and max(n for n in levels.values() if n is not None) > 6
    df = spark.createDataFrame([*sorted(edges), *sorted(edges)[:5], (None, 1), (1, None)], "source long, target long")
    assert {r["node"]: (r["level"], r["cycle"]) for r in relations.levels_and_rings(df).collect()} == {x: (levels[x], rings.get(x)) for x in levels}
    if alone == 40:
        assert {r["node"]: r["level"] for r in relations.levels(df).collect()} == levels and {r["node"]: r["cycle"] for r in relations.rings(df).collect()} == rings


def test_ends_that_are_texts(spark):
    edges = {("b", "ä"), ("ä", "c"), ("c", "b"), ("", "b"), ("c", "z"), ("x", "y")}
    levels, rings = plain(edges)
    got = relations.levels_and_rings(spark.createDataFrame(sorted(edges), "source string, target string")).collect()
    assert {r["node"]: (r["level"], r["cycle"]) for r in got} == {x: (levels[x], rings.get(x)) for x in levels}
    none = relations.levels_and_rings(spark.createDataFrame([], "source string, target string"))
    assert none.count() == 0 and none.columns == ["node", "level", "cycle"]


def test_a_long_way_takes_no_job_for_each_step(spark):
    """A way of 5,000 steps with a ring of 5,000 behind it."""
    way = spark.range(5_000).selectExpr("id AS source", "id + 1 AS target")
    ring = spark.range(5_000).selectExpr("5000 + id AS source", "5000 + (id + 1) % 5000 AS target")
    found = []
    assert jobs(spark, lambda: found.extend(relations.levels_and_rings(way.union(ring)).collect())) < 60
    assert {r["node"]: (r["level"], r["cycle"]) for r in found} == {x: (x, None) if x < 5_000 else (None, 5_000) for x in range(10_000)}


def distances(edges: set[tuple]) -> dict[tuple, int]:
    after, found = {}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for a in after:
        now, n = {a}, 0
        while now:
            n += 1
            now = {y for x in now for y in after.get(x, ()) if (a, y) not in found}
            found |= {(a, y): n for y in now}
    return found


def test_closure_takes_steps_of_the_logarithm_of_the_distance(spark):
    """The driver keeps every job and plan; 24 steps over all that is known had 11,579 tasks at 1,200,000 parts. A ring of 40 steps, with a tail."""
    edges = {(i, (i + 1) % 40) for i in range(40)} | {(39, 100), (100, 101), (50, 50)}
    df = spark.createDataFrame(sorted(edges), "source long, target long")
    want, found = distances(edges), []
    assert max(want.values()) == 41 and want[50, 50] == 1 and want[3, 3] == 40
    assert jobs(spark, lambda: found.append(relations.closure(df))) < 90
    assert found[0]._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1  # one table, however many steps
    assert sorted(map(tuple, found[0].collect())) == sorted((a, b, n) for (a, b), n in want.items())


@pytest.mark.parametrize("wide", [0, 1, 10**6])
def test_closure_by_ways_and_by_edges(spark, monkeypatch, wide):
    """Joined with single edges where there are many ways, with whole ways elsewhere, up to any number of steps."""
    monkeypatch.setattr(relations, "WIDE", wide)
    dice = random.Random(13)
    edges = {(x, x + dice.randrange(1, 7)) for x in range(40) for _ in range(3)} | {(30, 4), (12, 11), (44, 44)} | {(200 + i, 201 + i) for i in range(14)} | {(60 + 10 * i + j, 70 + 10 * i + k) for i in range(5) for j in range(4) for k in range(4)}
    want = distances(edges)
    assert max(want.values()) > 12
    df = spark.createDataFrame([*sorted(edges), *sorted(edges)[:9], (None, 1), (1, None)], "source int, target int")
    for most in (None, 1, 3, 7) if wide == 1 else (None,):
        got = relations.closure(df, most=most).collect()
        assert sorted(map(tuple, got)) == sorted((a, b, n) for (a, b), n in want.items() if most is None or n <= most)
