"""Long texts, repeated rows and ids, many labels: defined results in bounded time and memory."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from examlark.llm import bpe, langid, licenses, media, ngram_join, quality

from . import brute


def _frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


# 1


def _plain_vector(text: str, dim: int) -> np.ndarray:
    """Rotate, bind and bundle, a trigram at a time."""
    out = np.zeros(dim)
    low = text.lower()
    words = "".join(c if c.isalpha() else " " for c in low).split()
    vec = lambda c: langid.letter_vectors(np.array([ord(c)]), dim)[0].astype(float)
    for w in words:
        s = f" {w} "
        for i in range(1, len(s) - 1):
            out += np.roll(vec(s[i - 1]), 2) * np.roll(vec(s[i]), 1) * vec(s[i + 1])
    return out


def test_language_is_the_plain_version(spark):
    rnd = random.Random(4)
    kinds = {"aa": ["bala", "kolo", "mina"], "bb": ["str", "wxyz", "qqr"], "cc": ["éà", "ßü", "ñandú"]}
    rows = [(i, "; ".join(rnd.choice(kinds[k]) + rnd.choice(["", "1", "X"]) for _ in range(rnd.randrange(1, 9))), k) for i, k in enumerate(rnd.choice(list(kinds)) for _ in range(120))]
    rows += [(900, None, "aa"), (901, "", None), (902, "12 34", "bb"), (903, rows[0][1], None), (None, "mina kolo", None), (904, "Bala " * 5000, None)]
    df = _frame(spark, rows, "doc_id long, text string, lang string")
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in langid.identify(df, langid.learn(df), ["doc_id"]).collect())
    held = {r.doc_id for r in df.filter(langid.held_out()).collect()}
    unit = lambda v: v / np.linalg.norm(v) if v.any() else v
    protos = {k: unit(sum(unit(_plain_vector(t or "", langid.DIM)) for i, t, x in rows if x == k and i not in held)) for k in kinds}
    want = Counter()
    for i, t, _ in rows:
        v = _plain_vector(t or "", langid.DIM)
        cos = {k: float(unit(v) @ p) for k, p in protos.items()}
        best = max(sorted(cos), key=lambda k: cos[k])
        want[(i, best, round(min(max(cos[best], 0), 1), 4)) if v.any() else (i, "und", 0.0)] += 1
    assert got == want


def test_short_texts_need_little_memory():
    import tracemalloc

    rnd = random.Random(0)
    texts = pa.array(["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(10_000)])
    tracemalloc.start()
    v = langid.text_vectors(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert v.shape == (10_000, langid.DIM) and peak < 150 << 20


def test_rare_and_many_languages(spark):
    rows = [(i, "the and of " * 5, "en") for i in range(3000)] + [(10_000 + i, "zyxw wvut " * 5, "rare") for i in range(8)] + [(20_000 + i, f"{chr(97 + i % 26)}o{chr(97 + i // 26)}a", f"l{i}") for i in range(300)]
    df = _frame(spark, rows, "doc_id long, text string, lang string")
    found = langid.learn(df, max_train=50)
    assert "rare" in found and "en" in found and len(found) > 150
    assert langid.identify(df.filter("lang = 'rare'"), found, ["doc_id"]).filter("lang_pred = 'rare'").count() == 8


# 2


def test_the_state_of_a_piece_stays_bounded():
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.default_path())
    c = bpe.codec(bpe.default_path())
    rnd = random.Random(5)
    piece = "".join(rnd.choice("abcdefghij") for _ in range(60_000))
    step, widest, out = bpe.Transducer(c.vocabulary), 0, []
    for at in range(0, len(piece), 333):
        out += step.feed(piece[at : at + 333].encode())
        widest = max(widest, len(step.held))
    want = lib.encode(piece, add_special_tokens=False).ids
    assert [*out, *step.finish()] == want and widest < 2 * step.window
    flat, n = c.transducers.run([piece.encode(), b"", *[p.encode() for p in ("the", "x" * 2000)] * 50])
    assert flat[: n[0]].tolist() == want and n[1] == 0 and flat[-n[-1] :].tolist() == lib.encode("x" * 2000, add_special_tokens=False).ids


def test_a_text_of_many_megabytes_is_cut_in_blocks():
    c = bpe.codec(bpe.default_path())
    text = "The quick brown fox jumps. " * 100_000
    assert max(map(len, c.blocks(text.strip()))) <= 4 * bpe.UNITS + 32 and "".join("".join(b) for b in c.blocks(text)) == text
    ids = c.encode(text)
    assert c.decode(ids) == text


# 3


def test_repeated_rows_do_not_add_bags(spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = _frame(spark, [(i, ("good words here. " if i % 2 else "$$ %% 11 ") * 30) for i in range(40)] * 50)
    seen = []
    fit = quality.Model.fit
    monkeypatch.setattr(quality.Model, "fit", lambda self, x, counts, y: (seen.append(len(counts)), fit(self, x, counts, y))[1])
    model = quality.learn(docs, labels)
    assert seen and seen[0] <= 40
    r = {x.doc_id: x.score for x in quality.score(docs, model, ["doc_id"]).collect()}
    assert all((r[i] >= 0.5) == bool(i % 2) for i in range(40))


def test_attention_is_the_plain_version():
    """Scores of whole texts, against a loop over passages."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["Good", "bad,", "123", "x"]) for _ in range(n)) for n in (0, 1, 63, 64, 65, 400)] + [None]
    x, n = quality.passages(pa.array(texts))
    assert n.tolist() == [1, 1, 1, 1, 2, 7, 1]
    model = quality.Model(0.5, x.mean(axis=0), x.std(axis=0) + 1e-6)
    got = model.score(x, n)
    p, at = model.p, 0
    for i, k in enumerate(n.tolist()):
        h = [np.tanh(((row - model.mean) / model.scale) @ p["W"] + p["b"]) for row in x[at : at + k]]
        e = np.array([(np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"] for v in h])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        assert abs(1 / (1 + np.exp(-(sum(w * v for w, v in zip(a, h)) @ p["c"] + p["d"][0]))) - got[i]) < 1e-9
        at += k


# 5


def test_ids_with_several_texts(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([3, 8, 30, 90]))] for _ in range(25)]
    rows = []
    for _ in range(250):
        x = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            x[rnd.randrange(len(x))] = rnd.choice(words)
        rows.append((rnd.randrange(120), " ".join(x)))
    rows += [(500, "a b c d e f"), (500, "x y z u v w"), (498, "a b c d e f"), (499, "x y z u v w"), (500, "")]
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(_frame(spark, rows), words=4, num=85).collect())
    plain = brute.near_duplicates(list(enumerate(t for _, t in rows)), 4, 85, 100)
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (_, r) in plain.items():
        a, b = root(rows[k][0]), root(rows[r][0])
        up[max(a, b)] = min(a, b)
    assert got == Counter((i, plain[k][0], root(i)) for k, (i, _) in enumerate(rows))


# 6


@pytest.mark.parametrize("text", ["%PDF-1" * 200_000, "GIF89a\0\0\0\0\0\0\0!!" * 60_000, "BM P5 RIFF" * 100_000])
def test_many_false_signatures_take_linear_time(text):
    began = time.time()
    r = media.columns(text)
    assert r["payload_bytes"] >= r["n_bytes"] and time.time() - began < 20


# 7


def _naive(text: str) -> list[tuple[int, int, str]]:
    """Every rule on the text, no gate, and a detection goes if one of a better rule contains it."""
    word = licenses.WORD
    found = [(m.start(), m.end(), i) for i, (_, _, p) in enumerate(licenses.RULES) for m in re.finditer(rf"(?<!{word})(?:{p})(?!{word})", text)]
    return sorted((a, b, licenses.RULES[i][0]) for a, b, i in found if not any(j < i and c <= a and b <= d for c, d, j in found))


def test_scan_is_the_naive_scanner():
    rnd = random.Random(7)
    bits = [p for _, p in licenses.PHRASES] + [n for _, names, _, _ in licenses.FAMILIES for n in names] + ["version", "v2.0", "3.0", "or later", "1.1", "cc by-nc", "4.0", "creative commons", "attribution", "share alike", "spdx-license-identifier: gpl-3.0-or-later", "word", "noncommercial"]
    bits += [re.sub(r"\(\?:([^()|]*)[^()]*\)\??|\[sc\]|\\d|[?*]", lambda m: m.group(1) or ("s" if m.group() == "[sc]" else ""), p).split("|")[0] for _, _, p in licenses.SIGNATURES]
    hits = 0
    for _ in range(60):
        text = rnd.choice([" ", ", ", "\n"]).join(rnd.choice(bits).lower() for _ in range(rnd.randrange(12)))
        got = licenses.scan(text)[1]
        assert got == _naive(text), text
        hits += len(got)
    assert hits > 100 and len(licenses.SIGNATURES) > 120


def test_license_scan_is_linear():
    for t in ["gpl version" + " " * 1_000_000, "gnu" + " " * 1_000_000 + "x", "the mit license. " * 30_000, "creative commons " * 50_000]:
        began = time.time()
        licenses.scan(t)
        assert time.time() - began < 20
