"""The ten operators against plain versions, and on nulls, empty texts, repeats, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from examlark.llm import bpe, graph, langid, licenses, lines, media, mixing, ngram_join, quality, substring, topk

from . import brute

DATA = "/root/testdata/sf0.001"
EDGE = [(900, None), (901, ""), (902, " \n \t"), (903, "x"), (904, "Same text twice, here."), (905, "Same text twice, here."), (906, "日本語 テキスト é ß"), (907, "w " * 3000)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s1"), "score": F.lit("mine"), "n_words": F.lit(1), "component_id": F.lit("c"), "copies": F.lit("k")}) if extra else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


# 1


def test_langid(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    p = langid.learn(docs)
    r = langid.identify(docs, p, ["doc_id", "lang"]).withColumn("held", langid.held_out()).collect()
    held = [x for x in r if x.held]
    assert len(held) > 20 and sum(x.lang == x.lang_pred for x in held) >= 0.97 * len(held)
    assert {x.doc_id for x in held} == {x.doc_id for x in r if zlib.crc32(str(x.doc_id).encode()) % 4 == 2}
    e = {x.doc_id: x for x in langid.identify(frame(spark, [*EDGE, (908, "123 !!")]), p, ["doc_id"]).collect()}
    assert [e[i].lang_pred for i in (900, 901, 902, 908)] == ["und"] * 4 and e[900].score == 0 and e[904].score == e[905].score
    assert all(0 <= x.score <= 1 for x in e.values())
    assert langid.learn(empty(spark)) == {} and langid.identify(empty(spark), {}, ["doc_id"]).count() == 0


def test_bundle_is_the_sum_of_bound_ngrams():
    import pyarrow as pa

    v = langid.text_vectors(pa.array(["ab"]), 128)[0]
    L = langid.letter_vectors(np.array([32, 97, 98]), 128).astype(int)
    want = np.roll(L[0], 2) * np.roll(L[1], 1) * L[2] + np.roll(L[1], 2) * np.roll(L[2], 1) * L[0]
    assert (v == want).all()


# 2


@pytest.fixture(scope="module")
def codecs():
    tokenizers = pytest.importorskip("tokenizers")
    return bpe.codec(bpe.default_path()), tokenizers.Tokenizer.from_file(bpe.default_path())


def test_bpe_is_the_library(codecs):
    mine, lib = codecs
    rnd = random.Random(1)
    bits = ["a", "b", "é", "日", "\U0001f600", " ", "  ", "\n", "\t", "1", "23", "'s", "'", "the", "ing", "-", "==", "<|endoftext|>", "\xa0", "\x1c", "́", "\x85", "\x00", "THE", "don't"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    assert [x.tolist() for x in mine.encode_batch(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(500):
        ids = [rnd.randrange(50257) for _ in range(rnd.randrange(9))]
        assert mine.decode(ids) == lib.decode(ids, skip_special_tokens=False) and mine.decode(ids, block=1) == mine.decode(ids)


def test_long_pieces_stream(codecs):
    mine, lib = codecs
    assert 0 < mine.vocabulary.lookahead < 1000
    rnd = random.Random(2)
    for t in ["a" * 20000, "=-" * 9000, " " * 5000 + "x", "日" * 3000, *["".join(rnd.choice(["th", "er", "in", "a", "tion", "zz"]) for _ in range(4000)) for _ in range(20)]]:
        assert mine.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids
        step = bpe.Transducer(mine.vocabulary)
        data, out = t.encode(), []
        for at in range(0, len(data), 700):
            out += step.feed(data[at : at + 700])
            assert len(step.held) <= 2 * step.window
        if len(mine.split(t)) == 1:
            assert [*out, *step.finish()] == lib.encode(t, add_special_tokens=False).ids


def test_bpe_frame(spark, codecs):
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(frame(spark, EDGE), ["doc_id", "text"]), ["doc_id", "text", "token_ids"]).collect()}
    assert all(r.decoded == (r.text or "") for r in rows.values()) and rows[900].token_ids == [] and rows[904].token_ids == rows[905].token_ids
    assert bpe.encode(empty(spark), ["doc_id"]).count() == 0


# 3


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    r = quality.score(docs.join(labels, "doc_id"), model, ["doc_id", "quality"]).withColumn("held", quality.held_out()).filter("held").collect()
    assert len(r) > 40 and sum((x.score >= 0.3) == (x.quality == 1) for x in r) >= 0.9 * len(r)
    e = {x.doc_id: x.score for x in quality.score(frame(spark, EDGE), model, ["doc_id"]).collect()}
    assert all(0 <= s <= 1 for s in e.values()) and e[904] == e[905]
    none = labels.filter("false")
    assert quality.learn(docs, none).score(np.zeros((1, quality.N_FEATURES)), np.array([1])).tolist() == [0.5]


def test_quality_gradient():
    rng = np.random.default_rng(0)
    m, x, n, y = quality.Model(0.5), rng.normal(size=(7, quality.N_FEATURES)), np.array([3, 4]), np.array([0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(m.forward(x, n)["y"]) + (1 - y) * np.log(1 - m.forward(x, n)["y"]))
    g = m._grads(x, n, y)
    for k in g:
        flat = m.p[k].reshape(-1)
        old = flat[0]
        flat[0] = old + 1e-5
        up = loss()
        flat[0] = old - 1e-5
        down = loss()
        flat[0] = old
        assert abs((up - down) / 2e-5 - g[k].reshape(-1)[0]) < 1e-6


# 4


def test_budgets(spark):
    rows = [("a", "x", "1", 10, 100), ("a", "x", "2", 10, 1000), ("a", "y", "3", 10, 5000), ("b", "z", "4", 5, 50)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, docs long, tokens long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, F.lit(2000), 1, {}).collect()}
    # b gives its 50; a gets 1950, x and y 975 each; in x leaf 1 gives 100 and its sibling the rest
    assert got == {"1": 100, "2": 875, "3": 975, "4": 50}
    short = {r.source: r.budget for r in mixing.budgets(leaves, F.lit(4000), 1, {"source": {"2": 0}}).collect()}
    assert short == {"1": 100, "2": 0, "3": 3850, "4": 50}


def test_mix(spark):
    rows = [(i, "w " * (i % 7 + 1), "en" if i % 3 else None, f"src{i % 4}") for i in range(300)] + [(i, t, "en", "src9") for i, t in EDGE]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("copies", F.lit("clash"))
    r = mixing.mix(df, {}, share=0.5).collect()
    total = sum(len(brute.WORD.findall(t or "")) for _, t, _, _ in rows)
    assert 0.4 * total < sum(x.n_tokens * x.copies for x in r) <= 0.5 * total and not {900, 901, 902} & {x.doc_id for x in r}
    assert {x.copies for x in mixing.mix(df, {}, share=9.0, max_epochs=2).collect()} == {2}
    assert mixing.mix(empty(spark), {}).count() == 0


# 5


def _near_rows():
    rnd = random.Random(3)
    words, rows = [f"w{i}" for i in range(3000)], []
    for _ in range(150):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 40, 80, 300]))]
        for _ in range(rnd.choice([1, 1, 2, 5])):
            x = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4, 6])):
                x.insert(rnd.randrange(len(x) + 1), rnd.choice(words)) if rnd.random() < 0.5 else x.__setitem__(rnd.randrange(len(x)), rnd.choice(words))
            rows.append((len(rows), " ".join(x)))
    return rows


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_near_duplicates(spark, n, num):
    rows = _near_rows() + EDGE
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, rows), words=n, num=num).collect()}
    assert got == brute.near_duplicates(rows, n, num, 100)


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    r = ngram_join.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")).collect()
    assert Counter((x.doc_id, x.component_id) for x in r) == {(None, 3): 1, (3, 3): 2} or Counter((x.doc_id, x.component_id) for x in r) == {(None, None): 1, (3, 3): 2}


@pytest.mark.parametrize("size", [1, 7, 20, 60, 400])
def test_linked_sets_share_a_signature(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        drop = rng.integers(0, int(0.15 * len(a)) + 1)
        b = a[np.sort(rng.permutation(len(a))[drop:])]
        if len(b) * 100 < 85 * len(a) or not len(b):
            continue
        s, n = ngram_join.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), 85, 100)
        assert set(s[: n[0]].tolist()) & set(s[n[0] :].tolist())


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 4), (4, 3), (7, 7)], "a long, b long")
    assert {r.id: r.component for r in graph.components(e, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


# 6


@pytest.mark.parametrize("kind", ["wav", "bmp", "pgm"])
def test_media_round_trip(kind):
    for text in ["", "x", "BM P5 RIFF" * 20, "é" * 100]:
        data = media.payload(text)
        assert len(data) % 64 == 0 and len(data) > 0 and media.payload_of(media.store(data, kind)) == data
    inner = media.store(media.payload("inside"), "wav")
    outer = media.store(media.payload("")[:64] + inner + bytes(-len(inner) % 64), kind)
    true, found, inside = media.sniff(outer)
    assert true == kind and found and [(k, n) for k, _, n in inside] == [("wav", len(inner))]
    assert media.sniff(outer[:-1])[0] != kind


def test_media_columns(spark):
    r = {x.doc_id: x for x in media.describe(frame(spark, EDGE), ["doc_id"]).collect()}
    for i, t in EDGE:
        p = media.payload(t)
        assert (r[i].n_bytes, r[i].payload_bytes, r[i].payload_sha256, r[i].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert r[904].feature == r[905].feature and media.describe(empty(spark), ["doc_id"]).count() == 0


# 7


def test_licenses(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3; cc-by and CC\nBY", "all  RIGHTS reserved allrights", "Xcc by", "the mit license, ALL rights reserved", "éall rights reserved"]
    rows = [*enumerate(texts), *EDGE]
    got = {x.doc_id: x for x in licenses.licenses(frame(spark, rows), ["doc_id"]).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in rows:
        ws = word.findall(brute.lower(t or ""))
        at = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split())
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(ws), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert x.base_labels == ",".join(sorted({b for _, b in at})) and {b for _, b in at} <= set(x.labels.split(",")) and 0 <= x.score <= 1
    assert "cc-by-nc-4.0" in got[0].labels and "gpl-3.0" in got[1].labels and "mit" in got[4].labels
    assert len(licenses.RULES) >= 300


def test_licenses_suppress_contained():
    found = licenses.scan("gnu affero general public license version 3.0 or later")[1]
    assert [x for _, _, x in found] == ["agpl-3.0-or-later"]


# 8


def _passages():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    P = [" ".join(rnd.choice(words) for _ in range(rnd.choice([10, 35, 36, 60, 100]))) for _ in range(20)]
    rows = [(i, " ".join(rnd.choice([rnd.choice(P), " ".join(rnd.choice(words) for _ in range(rnd.randrange(60)))]) for _ in range(rnd.randrange(6)))) for i in range(200)]
    return rows + EDGE + [(903, "zz " * 36), (None, P[3] + " x"), rows[5]]


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(spark, monkeypatch, hot):
    rows = _passages()
    if hot:
        some = lambda d, w: np.sort(np.array([r.key for r in substring.runs(d, w, np.zeros(0, np.uint64)).groupBy("key").count().filter("count > 3").collect()], np.int64).view(np.uint64))
        monkeypatch.setattr(substring, "hot_minimizers", some)
    got = Counter(tuple(r) for r in substring.remove_repeats(frame(spark, rows)).collect())
    assert got == brute.without_repeats(rows, 35)


def test_repeats_of_nothing(spark):
    assert substring.remove_repeats(empty(spark)).count() == 0


# 9


def test_lines(spark):
    rnd = random.Random(5)
    words = [f"w{int(400 * rnd.random() ** 2)}" for _ in range(900)]
    P = [[rnd.choice(words) for _ in range(rnd.choice([3, 5, 6, 10, 20, 40, 150]))] for _ in range(50)]

    def line():
        x = list(rnd.choice(P)) if rnd.random() < 0.6 else [rnd.choice(words) for _ in range(rnd.randrange(1, 25))]
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            x[rnd.randrange(len(x))] = rnd.choice(words).upper()
        return " ".join(x)

    rows = [(i, "\n".join(line() for _ in range(rnd.randrange(8)))) for i in range(200)] + EDGE
    done = lines.dedup_lines(frame(spark, rows), min_tokens=5)
    assert done.columns == ["doc_id", "text", "lang", "source", "score", "n_words", "component_id", "copies", "lines_kept", "lines_removed"]
    assert {r.doc_id: r.text for r in done.collect()} == brute.without_similar_lines(rows)
    assert lines.dedup_lines(empty(spark)).count() == 0


# 10


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(700)]
    rows += [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 8), (1060, []), (1080, [1.0, 2.0]), (1100, [float("inf")] * 8), (1120, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "v": F.lit(2)})
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), 5).collect()}
    code = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in [i for i in code if i % 20 == 0]:
        best = sorted((-int(code[q] @ code[c]), c) for c in code if c != q and len(code[c]) == len(code[q]))[:5]
        want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(best)}
    assert got == want
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


# pipeline


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.common.materialize(stage(spark, before, DATA), name)
        if name != "bpe":
            assert after.columns == docs.columns
        sizes.append(after.count())
        if name == "language_id":
            assert sizes[-1] == before.filter(F.col("text").rlike(r"\p{L}")).count()
        if name == "line_dedup":
            had = {r.doc_id: r.text for r in before.collect()}
            want = brute.without_similar_lines(list(had.items()), least=1)
            assert {r.doc_id: r.text for r in after.collect()} == {i: t for i, t in want.items() if t == had[i] or brute.WORD.search(t)}
        if name == "near_duplicates":
            c = brute.near_duplicates([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
            assert {r.doc_id for r in after.collect()} == {i for i, (_, root) in c.items() if root == i}
        before = after
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in before.collect()) and sizes[-1] == sizes[-2] > 0
