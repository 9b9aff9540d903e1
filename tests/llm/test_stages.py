"""The pipeline's stages on nulls, empties, repeats, ties, empty tables and clashing columns."""

from __future__ import annotations

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id int, copies string, n_tokens double, _row string"
EN = "the quick brown fox jumps over the lazy dog and runs away from the hunter near the river bank"
DE = "der schnelle braune fuchs springt ueber den faulen hund und rennt weg von dem jaeger am flussufer"


def _rows():
    texts = [
        (1, EN + " one two three", "en"), (2, EN + " one two three", "en"), (3, DE + "\n" + EN, "de"), (4, None, "en"), (5, "", None), (6, " \n ", "de"), (7, "12 34 !!", "en"),
        (8, DE + " vier fuenf sechs", "en"), (8, "ganz anderer satz mit eigenen woertern drin", "de"), (8, DE + " vier fuenf sechs", "en"), (None, EN + " null id", None), (None, EN + " null id", None), (9, "word " * 20_000, "en"),
    ]
    return [(i, t, x, f"src{k % 3}" if k % 4 else None, len(t or ""), k, "c", 0.5, "r") for k, (i, t, x) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return corpus_pipeline.common.materialize(spark.createDataFrame(_rows(), SCHEMA).repartition(3), "stage-rows")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_survives(spark, docs, name, stage):
    done = stage(spark, docs, "")
    rows = done.collect()
    assert rows
    if name != "bpe":
        assert done.columns == docs.columns and [f.dataType for f in done.schema] == [f.dataType for f in docs.schema]
    none = stage(spark, docs.limit(0), "")
    assert none.columns == done.columns and none.count() == 0


def test_language_decides(spark, docs):
    more = [(100 + i, " ".join((EN if i % 2 else DE).split()[i % 5 :]), "en" if i % 2 else "de", "src0", 1, 0, "c", 0.5, "r") for i in range(80)]
    got = Counter((r.doc_id, r.text, r.lang) for r in corpus_pipeline.language_id(spark, docs.union(spark.createDataFrame(more, SCHEMA)), "").collect())
    assert not {4, 5, 6, 7} & {i for i, _, _ in got}  # no letters
    assert got[8, DE + " vier fuenf sechs", "de"] == 2 and got[None, EN + " null id", "en"] == 2  # a wrong and a missing language are replaced


def test_copies_of_one_id_go(spark, docs):
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got[1, EN + " one two three"] == 1 and (2, EN + " one two three") not in got
    assert got[8, DE + " vier fuenf sechs"] == 1 and got[8, "ganz anderer satz mit eigenen woertern drin"] == 1 and got[None, EN + " null id"] == 1
    assert all(n == 1 for n in got.values()) and {4, 5, 6, 7} <= {i for i, _ in got}  # texts without words stay


def test_mixing_is_the_plain_version(spark, docs):
    """Every chosen document comes as often as epochs take it, never more than the budget holds."""
    from examlark.llm import mixing

    chosen = mixing.mix(docs, mixing.WEIGHTS, share=0.5).collect()
    total = sum(len((r.text or "").split()) for r in docs.collect())
    assert 0 < sum(r.n_tokens * r.copies for r in chosen) <= total * 0.5 and all(r.copies in (1, 2) for r in chosen)
    stage = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixing_to_weights(spark, docs, "").collect())
    want = Counter()
    for r in chosen:
        want[r.doc_id, r.text] += r.copies
    assert stage == want


def test_tokens_round_trip(spark, docs):
    rows = corpus_pipeline.tokens(spark, docs, "").collect()
    assert len(rows) == docs.count() and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
