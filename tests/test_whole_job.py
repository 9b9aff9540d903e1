"""Queries on the whole of their input, against plain versions or their SQL without its cuts."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

from examlark.operators import matching
from examlark.plans import registry
from test_queries import DATA, TABLES, _rows


def _write(spark, path, table, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(path / f"{table}.parquet"))


def _same(spark, name, *cuts):
    """The query equals its SQL once the cuts, pairs of old and new, are lifted from it."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    sql = registry.ORACLE_SQL[name]
    for old, new in cuts:
        sql = sql.replace(old, new)
    got, cur = registry.QUERIES[name](spark, DATA), con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(columns, cur.fetchall())


HASHED = "hash_distinct_first duplicate_hash_groups asset_clean asset_drop_reasons hybrid_union".split()


@pytest.mark.parametrize("name", HASHED)
def test_hashes_of_whole_texts(spark, name):
    _same(spark, name, ("sha256(substr(text, 1, 40))", "sha256(text)"))


def test_same_opening_is_no_copy(spark, tmp_path):
    texts = ["a" * 40 + "b", "a" * 40 + "c", "a" * 40 + "b", "d"]
    _write(spark, tmp_path, "documents", [(i, t, "src1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r.hash for r in registry.QUERIES["hash_distinct_first"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(texts[i].encode()).hexdigest() for i in (0, 1, 3)}
    assert registry.QUERIES["strategy_compare"](spark, str(tmp_path)).collect()[0].distinct_hashes == 3
    assert registry.QUERIES["duplicate_hash_groups"](spark, str(tmp_path)).collect()[0][0] == 1


def test_vector_queries(spark):
    _same(spark, "vector_topk", ("a.vec_id % 100 = 0", "a.vec_id % 50 = 0"))


def test_more_queries_than_are_broadcast(spark, monkeypatch):
    rows = [(i, [float((i * 7) % 11 + 1), float((i * 5) % 13), 1.0]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    few = matching.vector_top_k(v, v, "vec_id", "embedding", 4).collect()
    monkeypatch.setattr(matching, "PROBE_ROWS", 7)
    assert sorted(matching.vector_top_k(v, v, "vec_id", "embedding", 4).collect()) == sorted(few) and len(few) == 240


def test_requests_of_all_orders(spark):
    _same(spark, "version_requests", (" WHERE o_orderkey % 50 = 0", ""))


def test_answers_of_all_events(spark):
    _same(spark, "answer_card", (" WHERE event_id % 3 = 0", ""))


def test_an_invalid_answer_is_seen(spark, tmp_path):
    _write(spark, tmp_path, "events", [(5, 1), (6, 1), (7, 2)], "event_id long, user_id long")
    got = registry.QUERIES["answer_card"](spark, str(tmp_path)).collect()
    assert {(r.user_id, r.answers, r.valid) for r in got} == {(1, 2, False), (2, 1, True)}


WHOLE_TEXTS = {"safe_stem": [("substr(text, 1, 200)", "text")], "contract_validate": [("substr(text, 1, 30 + 20 * CAST(turn AS INTEGER))", "text")], "step_prompt_resolve": [("substr(v.text, 1, 40)", "v.text")], "version_list": [(" WHERE version < 10", "")]}


@pytest.mark.parametrize("name", list(WHOLE_TEXTS))
def test_whole_texts_and_versions(spark, name):
    _same(spark, name, *WHOLE_TEXTS[name])


def test_long_openings_and_late_turns(spark, tmp_path):
    _write(spark, tmp_path, "documents", [(1, "!" * 250 + "name")], "doc_id long, text string")
    assert registry.QUERIES["safe_stem"](spark, str(tmp_path)).collect()[0].stem == "name"
    _write(spark, tmp_path, "conversations", [(1, i, "user", f"t{i}") for i in range(12)], "conv_id long, turn long, role string, text string")
    got = registry.QUERIES["version_list"](spark, str(tmp_path)).collect()[0]
    assert (got.n_versions, got.max_version) == (12, 12)


def test_a_long_reason_is_seen(spark, tmp_path):
    _write(spark, tmp_path, "conversations", [(1, 0, "user", "x" * 60), (1, 1, "user", "short"), (2, 0, "user", "y"), (2, 1, "user", "z")], "conv_id long, turn long, role string, text string")
    got = registry.QUERIES["contract_validate"](spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.valid) for r in got} == {(1, False), (2, True)}
