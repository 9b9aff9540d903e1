"""Operators 11, 12 and 13 against plain versions, and on nulls, empty texts, repeats, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from examlark.llm import bpe, common, langid, licenses, media, pii, quality, resample, spelling

from .brute import lower

EDGE = [(900, None), (901, ""), (902, " \n \t"), (903, "x"), (904, "Write to anna@x.org."), (905, "Write to anna@x.org."), (905, "Write to anna@x.org."), (None, "日本語 é 1.2.3.4 +1 (743) 555-3824"), (907, "w " * 40000 + "anna@x.org")]


def frame(spark, rows=EDGE, clash=("spans", "n_words", "word", "weight", "score", "rank", "digest")):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("mine") for c in clash})


# 11

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_the_patterns():
    rnd = random.Random(3)
    bits = ["a", "Zé", "@", "@", ".", "..", "-", "+1", "+", "1", "22", "255", "256", "1.2.3.4", " ", "  ", "(", ")", "4539578763621486", "4539 5787 6362 1486", "x@y.z", "_%", "\n", "555-3824", "日", "0000001", "+49 30 1234567"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14))) for _ in range(6000)]
    data, offsets = common.utf8(pa.array(texts))
    kind, start, end, base = pii.spans(data, offsets, None)
    got = [[] for _ in texts]
    for k, s, e in zip(kind, start, end):
        i = int(np.searchsorted(offsets, s, side="right")) - 1
        got[i].append((pii.KINDS[k], len(data[offsets[i] : s].tobytes().decode()), len(data[offsets[i] : e].tobytes().decode())))
    assert base.all() and got == [plain_spans(t) for t in texts]


@pytest.fixture(scope="module")
def field():
    return pii.learn()


def test_decoding_is_the_best_path(field):
    rows = [r[0] for r in pii.labelled(rounds=1, seed=5)]
    data, offsets = common.utf8(pa.array([*rows, " ".join(rows)]))
    t = pii.Tokens(data, offsets)
    got, e, p = field.decode(t), field.emissions(t), field.pairs
    for i in range(len(offsets) - 1):
        mine = e[t.first[i] : t.first[i + 1]]
        if not len(mine):
            continue
        best, back = mine[0] + p[0], []
        for row in mine[1:]:
            step = best[:, None] + p
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        path = [int((best + p[:, 0]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert got[t.first[i] : t.first[i + 1]].tolist() == path[::-1]


def test_field_finds_what_it_has_not_seen(field):
    found = wrong = total = 0
    for text, want in pii.labelled(rounds=2, seed=77):
        data, offsets = common.utf8(pa.array([text]))
        kind, start, end, _ = pii.spans(data, offsets, field)
        got = {(pii.KINDS[k], s, e) for k, s, e in zip(kind, start, end)}
        want = {(k, len(text[:a].encode()), len(text[:b].encode())) for k, a, b in want}
        touched = {w for w in want if any(g[0] == w[0] and g[1] < w[2] and w[1] < g[2] for g in got)}
        total, found, wrong = total + len(want), found + len(touched), wrong + len([g for g in got if not any(g[1] < w[2] and w[1] < g[2] for w in want)])
    assert found >= 0.97 * total and wrong <= 0.02 * total


def test_gradient_of_the_field(field):
    rows = [("a token of xyz", []), ("write to b@c.de", [("email", 9, 15)])]
    data, offsets = common.utf8(pa.array([r[0] for r in rows]))
    t = pii.Tokens(data, offsets)
    k = len(pii.LABELS)
    rng = np.random.default_rng(1)
    e, p = rng.normal(size=(len(t.start), k)), rng.normal(size=(k, k))
    n = np.diff(t.first)
    rows_, cols = np.repeat(np.arange(2), n), np.arange(len(t.start)) - np.repeat(np.cumsum(n) - n, n)

    def log_z(e, p):
        out = 0.0
        for i in range(2):
            mine = e[t.first[i] : t.first[i + 1]]
            a = mine[0] + p[0]
            for row in mine[1:]:
                a = np.log(np.exp(a[:, None] + p).sum(axis=0)) + row
            out += np.log(np.exp(a + p[:, 0]).sum())
        return out

    node, pair = pii.Field._marginals(e, p, rows_, cols, 2, int(n.max()), n)
    for x, grads, at in ((e, node, (1, 2)), (p, pair, (0, 3)), (p, pair, (2, 0))):
        x[at] += 1e-5
        up = log_z(e, p)
        x[at] -= 2e-5
        down = log_z(e, p)
        x[at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[at]) < 1e-5


def test_pii_query(spark):
    got = {r.doc_id: r for r in pii.op11_pii(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(got) == len(docs)
    extra = 0
    for d in docs:
        want = plain_spans(d.text or "")
        r, text = got[d.doc_id], ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        counts = Counter(k for k, _, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) - {""} <= set(r.spans.split(","))
        keys = [(pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])) for x in r.spans.split(",") if x]
        assert keys == sorted(keys)
        extra += "secret" in r.spans
        assert ("token = " in (d.text or "")) == ("secret" in r.spans)
    assert extra


def test_pii_edges(spark, field):
    rows = pii.find(frame(spark), ["doc_id", "spans", "n_words"], field).collect()
    assert [c for c in rows[0].asDict()] == ["doc_id", "n_words", "base_spans", "spans"]
    by = {r.doc_id: [tuple(s) for s in r.spans] for r in rows}
    assert len(rows) == len(EDGE) and by[900] == by[901] == by[902] == by[903] == [] and by[904] == by[905] == [("email", 9, 19)]
    assert by[None] == [("ip", 6, 13), ("phone", 14, 31)] and by[907] == [("email", 80000, 90000 - 9990)]
    assert pii.find(frame(spark).filter("false"), ["doc_id"], field).count() == 0
    assert pii.learn([]).decode(pii.Tokens(*common.utf8(pa.array(["Dear Mr. Berg"])))).tolist() == [0, 0, 0]
    text = {r.doc_id: r.redacted for r in pii.redact(frame(spark), ["doc_id"], field).collect()}
    assert text[900] is None and text[901] == "" and text[904] == "Write to [EMAIL]." and text[None] == "日本語 é [IP] [PHONE]"


# 12


def plain_variants(rows, least=7, count=2):
    n = Counter()
    for i, t in rows:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(m[0])
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = {w: c for w, c in n.items() if len(w) >= least and c >= count}
    near = {w: [v for v in words if v != w and is_near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def is_near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def some_words(rnd, k, alphabet="abß"):
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(7, 10))) for _ in range(k)]


@pytest.mark.parametrize("max_key", [1, 8, 100000])
def test_near_words_are_all_near_words(spark, max_key):
    words = sorted(set(some_words(random.Random(4), 400)) | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "x" * 3000, "x" * 2999 + "y", "x" * 3001})
    got = Counter((r.word, r.near, r.near_n) for r in spelling.near_words(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long"), max_key).collect())
    assert set(got.values()) == {1} and set(got) == {(a, b, words.index(b)) for a in words for b in words if a != b and is_near(a, b)}


def test_wavelet():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100):
        v = rng.permutation(n)
        a, b, c, d = rng.integers(0, n + 1, (4, 200))
        q, x = spelling.Wavelet(v).report(a, b, c, d)
        assert sorted(zip(q.tolist(), x.tolist())) == sorted((i, y) for i in range(200) for y in v[a[i] : b[i]].tolist() if c[i] <= y < d[i])


def test_spelling(spark):
    rnd = random.Random(8)
    some = some_words(rnd, 30, "abcÄé")
    rows = [(i, " ".join(rnd.choice([rnd.choice(some), rnd.choice(some[:3]), "don't", "ABCDEFG", "abcdefg", "abcdefh", "abcdefgÿ", "short"]) for _ in range(60))) for i in range(60)]
    rows += [(None, "abcdefg-abcdefg"), (5, None), (6, ""), (7, "z" * 5000 + " " + "z" * 5000), (8, "abcdefg abcdefg"), (8, "abcdefg abcdefg"), *[(i, "abcdefg " * 50) for i in range(100, 104)]]
    got = [tuple(r) for r in spelling.variants(spelling.vocabulary(frame(spark, rows))).collect()]
    want = plain_variants(rows)
    assert len(got) == len(set(got)) and set(got) == want and any(x[1] for x in want) and any(x[2] != (x[1] or x[0]) for x in want) is False
    assert spelling.variants(spelling.vocabulary(frame(spark).filter("false"))).count() == 0


def test_roots_follow_forms(spark):
    words = [("aaaaaaa", 1000000), ("aaaaaab", 100000), ("aaaaabb", 10000), ("aaaabbb", 1000), ("aaabbbb", 100), ("aabbbbb", 10), ("zzzzzzz", 3)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert [got[w].root for w, _ in words] == ["aaaaaaa"] * 6 + ["zzzzzzz"] and got["aabbbbb"].form == "aaabbbb" and got["zzzzzzz"].form is None


# 13


def test_crc_goes_on():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abé9日") for _ in range(rnd.choice([0, 1, 3, 9, 300]))) for _ in range(400)]
    data, offsets = common.utf8(pa.array(texts))
    start = np.array([rnd.randrange(1 << 32) for _ in texts], np.uint32)
    got = resample.crc32_on(start, data, offsets[:-1], offsets[1:])
    assert got.tolist() == [zlib.crc32(t.encode(), int(s)) for t, s in zip(texts, start)]


def plain_resample(rows, target):
    def buckets(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    docs, s, t = [(i, *buckets(x)) for i, x in rows], Counter(), Counter()
    for _, _, b in docs:
        s.update(b)
    for x in target:
        t.update(buckets(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    out = []
    for i, n, b in docs:
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0]))
    drawn = len(fit) * 25 // 100
    return Counter([(i, n, w, sc, k + 1 if k < drawn else None) for k, (i, _, n, w, sc) in enumerate(fit)] + [(i, n, w, sc, None) for i, m, n, w, sc in out if m < 20])


def test_resample(spark):
    rnd = random.Random(2)
    words = ["alpha", "Beta", "gamma's", "δelta", "x1", "9", "the", "of"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 5, 19, 20, 21, 60])))) for i in range(150)]
    rows += [(1000 + i, "one text many times " * 6) for i in range(80)] + [*EDGE, (None, "the of " * 12), (None, "x1 of " * 15), (7, rows[7][1])]
    target = ["alpha beta the the", "δelta of", None, "", "alpha beta the the"]
    to = spark.createDataFrame([(x, 1) for x in target], "text string, score int")
    got = Counter(tuple(r) for r in resample.resample(frame(spark, rows), to).collect())
    assert got == plain_resample(rows, target) and any(r[4] for r in got)
    assert Counter(tuple(r) for r in resample.resample(frame(spark, rows), to.filter("false")).collect()) == plain_resample(rows, [])
    assert resample.resample(frame(spark).filter("false"), to).count() == 0


def test_ranks_over_many_parts(spark):
    df = spark.range(0, 5000, 1, 7).select("id", (F.col("id") * 7919 % 101).alias("v"))
    got = {r.id: r.k for r in resample.ranked(df, "k", [F.desc("v"), F.asc("id")]).collect()}
    order = sorted(range(5000), key=lambda i: (-(i * 7919 % 101), i))
    assert got == {i: k + 1 for k, i in enumerate(order)}


# names of new columns among the kept ones


def test_clashing_names_give_way(spark):
    new = ["lang_pred", "score", "token_ids", "decoded", "media", "declared", *[c.split()[0] for c in re.split(r",\s*", media.FIELDS)], "labels", "base_labels", "n_base", "Score"]
    df = frame(spark, clash=()).withColumns({c: F.lit("mine") for c in dict.fromkeys(new) if c != "Score"})
    keep = df.columns
    for out, name in (
        (langid.identify(df, {}, keep), "lang_pred"),
        (bpe.encode(df, keep, decoded=True), "token_ids"),
        (quality.score(df, quality.Model(0.5), keep), "score"),
        (media.describe(df, keep), "payload_bytes"),
        (licenses.licenses(df, keep), "labels"),
        (media.to_media(df, keep), "media"),
    ):
        low = [c.lower() for c in out.columns]
        assert len(low) == len(set(low)) and name in low
        assert all(r[name] != "mine" for r in out.collect())


# 10: what is scored


def test_first_leaf_cuts_inner_nodes():
    from examlark.llm import topk

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(64, 32)) * 60
    x = np.floor(np.repeat(centres, 128, axis=0) + rng.normal(size=(64 * 128, 32))).astype(np.int64)
    ids = rng.permutation(len(x)).astype(np.int64)
    tree = topk.Shard(x, ids)
    q, qid = x[::80], ids[::80]
    tree.search(q[:1], qid[:1], np.full(1, -np.inf), 20)
    s = topk.Search(q, qid, np.full(len(q), -np.inf), 20, np.dtype(np.float64))
    s.visit(next(iter(tree.trees.values())))
    assert s.scored < 0.4 * len(q) * len(x)  # few leaves are needed, though no k-th score was known
    scores = q @ x.T
    for i in range(len(q)):
        order = sorted((-int(v), int(j)) for v, j in zip(scores[i], ids) if j != qid[i])[:20]
        assert sorted((-int(v), int(j)) for v, j in zip(s.score[i], s.id[i])) == sorted(order)
