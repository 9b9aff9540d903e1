"""Queries on tables that go beyond the ids of the small ones, against their SQL, and operators whose work must not grow faster than their input."""

from __future__ import annotations

from pathlib import Path

import duckdb
from examlark.plans import registry


def same(spark, folder: Path, name: str, **tables: str) -> list[tuple]:
    """Rows of a query over tables made by DuckDB, which must be those of its SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    cur = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: [(v is not None, str(v)) for v in r]
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    assert rows == sorted(cur.fetchall(), key=key)
    return rows


def test_document_summary_numbers_of_five_digits(spark, tmp_path):
    rows = same(spark, tmp_path, "document_summary", documents="SELECT x AS doc_id, 'a' || chr(10) || 'b' AS text FROM (VALUES (7), (9999), (10000), (43438)) t(x)")
    assert len({r[6] for r in rows}) == 4


def test_knowledge_closure_ends_where_its_sql_does(spark, tmp_path):
    """A way of 30 steps, and some ways back."""
    rows = same(spark, tmp_path, "knowledge_closure", part="SELECT CAST(pow(2, i) AS BIGINT) AS p_partkey FROM range(1, 31) t(i)")
    assert max(r[2] for r in rows) == 24


def test_rings_are_those_of_the_closure(spark):
    import random

    from examlark.operators import relations

    dice = random.Random(3)
    edges = {(dice.randrange(60), dice.randrange(60)) for _ in range(75)} | {(100 + i, 101 + i) for i in range(9)} | {(109, 100), (5, 5), (200, 200)}
    e = spark.createDataFrame(sorted(edges), "source long, target long")
    want = {(r["node"], r["cycle"]) for r in relations.cycles(relations.closure(e)).collect()}
    assert len(want) > 12 and {(r["node"], r["cycle"]) for r in relations.rings(e).collect()} == want
    assert relations.rings(e.filter("source < 0")).count() == 0


def test_section_sums_has_no_row_for_a_pair(spark):
    """Half a billion pairs of one paper."""
    from pyspark.sql import functions as F

    from examlark.operators import analytics as A

    q = spark.range(100_000).select(F.lit(1).alias("paper"), (F.col("id") % 2 + 40).alias("n"))
    sections = spark.range(5_000).select(F.col("id").alias("section"), F.lit(1).alias("paper"), (F.col("id") % 42).alias("lo"), F.lit(900).alias("hi"))
    got = {r["section"]: (r["questions"], r["numbers"]) for r in A.section_sums(q, sections, "paper", F.col("n"), "lo", "hi", ["section"]).collect()}
    assert len(got) == 5_000 and all(v == ((50_000, 2_050_000) if k % 42 == 41 else (100_000, 4_050_000)) for k, v in got.items())


def test_aligned_has_rows_for_the_levels_of_a_range_alone(spark):
    from pyspark.sql import functions as F

    from examlark.operators import analytics as A

    ends = [(0, 0), (1, 2), (3, 5), (6, 7), (-4, 6), (5, 4), (0, 1023), (7, 900), (None, 3), (3, None), (3_000_000_000, 3_000_000_900)]
    df = spark.createDataFrame(ends, "lo long, hi long").withColumn("r", A.aligned(F.col("lo"), F.col("hi")))
    for r in df.collect():
        want = [] if r["lo"] is None or r["hi"] is None else list(range(max(r["lo"], 0), r["hi"] + 1))
        assert sorted(i for x in r["r"] for i in range(x["place"] << x["level"], (x["place"] + 1) << x["level"])) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan  # 33 steps for each section


def test_vector_top_k_never_compares_pairs_in_the_plan(spark):
    """Copies tie to the smaller key, across blocks and inside them; vectors without a norm take no part."""
    import random

    from examlark.operators import matching

    dice = random.Random(5)
    vectors = [[dice.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(i, vectors[0] if i % 3 == 0 else vectors[i % 40]) for i in range(400)] + [(400, [0.0] * 8), (401, None), (450, [0.0] * 8)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = matching.vector_top_k(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    norm = lambda v: sum(x * x for x in v) ** 0.5
    live = [(i, v) for i, v in rows if v and norm(v) > 0]
    want = []
    for i, v in live:
        if i % 50 == 0:
            best = sorted((-round(sum(x * y for x, y in zip(v, u)) / (norm(v) * norm(u)), 6), j) for j, u in live if j != i)[:5]
            want += [(i, j, r + 1) for r, (_, j) in enumerate(best)]
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in got.collect()) == want


def test_scores_of_documents_are_not_shuffled(spark):
    """After the deal by document, words, counts and scores of a document follow without another shuffle of it."""
    from examlark.operators import matching

    docs = spark.createDataFrame([(i, f"a b{i % 7} c c{i % 3}") for i in range(50)], "d long, text string")
    items = spark.createDataFrame([(1, "a c"), (2, "b1 c2 zz")], "i long, text string")
    got = matching.bm25(items, docs, "i", "d", "text")
    assert got.count() == 50 + len([i for i in range(50) if i % 7 == 1 or i % 3 == 2])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "hashpartitioning(" in x and "Exchange" in x and ("d#" in x.split("hashpartitioning(")[1]) and "REPARTITION" not in x]


def test_made_packages_and_pictures_never_leave_their_task(spark):
    """One pass of Python for each: what is made is read where it is made, one at a time."""
    import pyarrow as pa

    from examlark.plans import packages
    from examlark.sources import files, images

    for df in (packages._hashes(spark, "/root/testdata/sf0.001"), packages._packages(spark, "/root/testdata/sf0.001")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    live, most = [0], [0]

    class Bytes(bytes):
        def __init__(self, *_) -> None:
            live[0] += 1
            most[0] = max(most[0], live[0])

        def __del__(self) -> None:
            live[0] -= 1

    made = lambda part: ((str(x), Bytes(b"no picture")) for x in part.column(0).to_pylist())
    for module, call in ((images, images.measure), (files, files.package_profiles)):
        caught = []
        frame = type("Frame", (), {"mapInArrow": lambda self, run, kind: caught.append(run)})()
        call(frame, make=made)
        out = list(caught[0](iter([pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["k"])])))
        assert sum(b.num_rows for b in out) == 1000 and max(b.num_rows for b in out) <= module.SLICE
    assert most[0] <= 3


def test_a_small_query_set_builds_no_index(spark, monkeypatch):
    from examlark.operators import retrieval

    monkeypatch.setattr(retrieval, "build", None)
    docs = spark.createDataFrame([(i, "a " * (1 + i % 4) + "b") for i in range(40)], "d long, text string")
    got = retrieval.bm25_top_k(spark.createDataFrame([(1, "a")], "i long, text string"), docs, "i", "d", "text", 3).collect()
    assert [(r["d"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(3, 1), (7, 2), (11, 3)]


def test_papers_of_few_sections_join_without_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F

    from examlark.operators import analytics as A

    q = spark.createDataFrame([(p, n) for p in (1, 2, None) for n in (-1, 0, 1, 5, 9, None)], "paper int, n int")
    sections = spark.createDataFrame([(1, "a", -3, 1), (1, "b", 1, 9), (2, "c", 9, 2), (2, "d", None, 9), (2, "e", 3, None), (2, "f", 5, 5), (None, "g", 0, 9)], "paper int, section string, lo int, hi int")
    found = []
    for few in (A.FEW_SECTIONS, 0):
        monkeypatch.setattr(A, "FEW_SECTIONS", few)
        df = A.in_section(q, sections, "paper", F.col("n"), "lo", "hi")
        assert ("Generate" in df._jdf.queryExecution().optimizedPlan().toString()) == (few == 0)
        found.append(sorted((r["paper"], r["n"], r["section"]) for r in df.collect()))
    assert found[0] == found[1] == [(1, 0, "a"), (1, 1, "a"), (1, 1, "b"), (1, 5, "b"), (1, 9, "b"), (2, 5, "f")]
