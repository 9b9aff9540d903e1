"""The columns that queries without SQL have to return, against plain versions, and the SQL of the others."""

from __future__ import annotations

import glob
import hashlib
import os
import re
import zlib

import pytest

from examlark.llm import bpe, langid, licenses, media, quality, queries

from .brute import lower

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not glob.glob(f"{DATA}/*.parquet"), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, texts):
    langs = {r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("lang").distinct().collect()}
    rows = langid.op1_langid(spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        has_letter = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert r.lang_pred in langs if has_letter else r.lang_pred == "und"


def test_op2(spark, texts):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_path())
    rows = bpe.op2_bpe(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op3(spark, texts):
    rows = quality.op3_quality(spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_op6(spark, texts):
    rows = media.op6_media(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64


def test_op7(spark, texts):
    rows = licenses.op7_licenses(spark, DATA).collect()
    assert len(rows) == len(texts)
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for r in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(texts[r.doc_id] or ""))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(at, default=None), max(at, default=None))
        base, every = ([x for x in c.split(",") if x] for c in (r.base_labels, r.labels))
        assert base == sorted({x for _, x in places}) and every == sorted(set(every)) and set(base) <= set(every) and 0 <= r.score <= 1


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        p = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))
