"""Retrieval by blocks, Hamming joins, formulas, JSON trees, range joins, slices of blocks: against plain versions."""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from examlark.functions import contracts as C
from examlark.functions import formulas
from examlark.functions import scalars as S
from examlark.operators import analytics, hashes, matching, retrieval, trees
from examlark.plans import packages
from examlark.sources import images

# BM25 -----------------------------------------------------------------------------------------------


def _corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    return [(i, " ".join(rnd.choices(words, weights, k=rnd.randrange(0, 40)))) for i in range(n)]


def _plain_bm25(queries, docs, k):
    words = {i: (t or "").split() if t is not None else None for i, t in docs}
    lengths = [len(w) for w in words.values() if w is not None]
    avg, n = sum(lengths) / len(lengths), len(docs)
    df = Counter(t for w in words.values() for t in set(w or ()))
    out = {}
    for q, text in queries:
        scores = {}
        for d, ws in words.items():
            tf = Counter(ws or ())
            s = sum(c * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / avg)) for t, c in Counter(text.split()).items() if tf[t])
            if any(tf[t] for t in text.split()):
                scores[d] = round(s, 6)
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_block_top_k_is_the_whole_ranking(spark):
    docs, rnd = [*_corpus(1, 900), (900, None), (901, ""), (902, "w5 w5 w5"), (903, "w5 w5 w5")], random.Random(2)
    queries = [(i, " ".join(f"w{rnd.randrange(200)}" for _ in range(rnd.randrange(1, 6)))) for i in range(20)] + [(20, "nothing here"), (21, "w0 w0 w1"), (22, "w5")]
    q, d = spark.createDataFrame(queries, "q int, text string"), spark.createDataFrame(docs, "d long, text string")
    index, most = retrieval.build(d, "d", "text", matching.terms(q, "q", "text").select("term").distinct(), size=16)
    best, scored = retrieval.block_top_k(q, "q", "text", index, most, 3)
    got = defaultdict(list)
    for r in sorted(best.collect(), key=lambda r: (r["query"], r["rank"])):
        got[r["query"]].append((r["doc"], r["score"]))
    want = _plain_bm25(queries, docs, 3)
    assert {k: [x for x, _ in v] for k, v in got.items()} == {k: [x for x, _ in v] for k, v in want.items() if v}
    assert all(abs(a[1] - b[1]) < 2e-6 for k in got for a, b in zip(got[k], want[k]))
    # what was scored: the first wave, and then blocks alone whose bound reaches the k-th score; all others fall short of it
    done = {(r["query"], r["block"]): r["wave"] for r in scored.collect()}
    bounds = {(r["query"], r["block"]): r["bound"] for r in most.join(matching.terms(q, "q", "text"), "term").groupBy(F.col("q").alias("query"), "block").agg(F.sum(F.col("w") * F.col("tf")).alias("bound")).collect()}
    assert set(done) <= set(bounds) and len(done) < 0.8 * len(bounds)
    for (query, block), bound in bounds.items():
        full = len(got[query]) == 3
        if (query, block) not in done:
            assert full and bound < got[query][-1][1]
    sizes = index.groupBy("block").agg(F.count_distinct("doc").alias("n")).collect()
    assert sum(r["n"] for r in sizes) == index.select("doc").distinct().count() and len(sizes) > 20
    for r in index.groupBy("block", "term").agg(F.max("w").alias("m")).join(most, ["block", "term"], "full").collect():
        assert r["m"] == r["w"]


def test_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])], "id int, v array<double>")
    got = [(r.query_id, r.id, r.score) for r in matching.vector_top_k(v.filter("id < 3"), v, "id", "v", 2).collect()]
    assert sorted(got) == [(1, 3, 0.707107), (1, 4, 1.0)]


def test_slices_of_blocks_lose_no_pair(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"b{i % 7}", rnd.choice([None, *range(-20, 40)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, block string, size int")
    score = F.lit(1) - F.abs(F.col("a.size") - F.col("b.size")) / F.lit(50.0)
    pairs = lambda near: sorted(tuple(r) for r in matching.blocked_pairs(df, "id", ["block"], score, 0.9, ["size"], near).collect())
    got = pairs(("size", 5))
    assert got == pairs(None) and len(got) > 1000 and len(set(got)) == len(got)


# hashes ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most,radius", [(1000000, 3), (20, 3), (4, 2), (2, 0)])
def test_all_pairs_within_a_radius(spark, most, radius):
    rnd = random.Random(most + radius)
    seeds = [rnd.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    some = {s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 8))) for s in seeds for _ in range(25)}
    some |= {seeds[0] & ~0xFFFF | i for i in range(60)}  # one value in most bands
    some = [x - (1 << 64) if x >> 63 else x for x in some]
    got = [tuple(r) for r in hashes.near_pairs(spark.createDataFrame([(x,) for x in some], "hash long"), radius, most).collect()]
    bits = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    want = {(a, b, bits(a, b)) for a in some for b in some if a < b and bits(a, b) <= radius}
    assert len(got) == len(set(got)) and set(got) == want


def test_similar_classes(spark):
    df = spark.createDataFrame([(5, 0), (3, 0), (9, 1), (2, 7), (8, None), (7, 1)], "id int, h long")
    assert sorted(tuple(r) for r in hashes.similar(df, "id", "h", 2).collect()) == [(2, 7, 2), (3, 7, 1)]
    assert hashes.similar(df.filter("false"), "id", "h", 2).count() == 0


def test_hash_of_pictures():
    rng = np.random.default_rng(0)
    big = rng.integers(0, 256, (64, 96)).astype(np.uint8)
    area = images.averaged(big)
    assert area.shape == (32, 32) and (area == (big.reshape(32, 2, 32, 3).sum(axis=(1, 3)) * 16 // 6)).all()
    small = np.kron(rng.integers(0, 256, (32, 32)).astype(np.uint8), np.ones((1, 1), np.uint8))
    assert images.dct_hash(np.kron(small, np.ones((3, 2), np.uint8))) == images.dct_hash(small)  # scaled alike
    assert images.dct_hash(np.full((5, 9), 255, np.uint8)) == "0" * 16 and images.dct_hash(None) is None
    near = np.clip(np.kron(small, np.ones((4, 4))) + rng.integers(-3, 4, (128, 128)), 0, 255).astype(np.uint8)
    assert bin(int(images.dct_hash(near), 16) ^ int(images.dct_hash(small), 16)).count("1") <= 6


@pytest.mark.parametrize("kind,channels", [(0, 1), (2, 3), (3, 1), (4, 2), (6, 4)])
def test_pictures_come_back(kind, channels):
    px = np.random.default_rng(kind).integers(0, 256, (7, 5, channels)).astype(np.uint8)
    light, alpha = images.pixels(packages._png(px, kind, [0, 1, 2, 3, 4]))
    want = px[..., 0] if channels < 3 else np.rint(px[..., :3].astype(float) @ [0.299, 0.587, 0.114]).astype(np.uint8)
    assert (light == want).all() and (alpha is None) == (channels not in (2, 4)) and (alpha is None or (alpha == px[..., -1]).all())
    assert (images.pixels(packages._bmp(px[..., 0]))[0] == px[..., 0]).all()


def test_crop_goes_by_alpha_first():
    light, alpha = np.full((20, 30), 255, np.uint8), np.zeros((20, 30), np.uint8)
    light[2, 2] = 0  # transparent ink
    light[8:10, 11:13] = 0
    alpha[5:18, 10:25] = 255
    assert images.crop_box(light, alpha) == (10, 6, 15, 12) and images.crop_box(light, None) == (0, 0, 15, 12)
    light[:] = 255
    assert images.crop_box(light, alpha) == (10, 5, 25, 18) and images.crop_box(light, alpha * 0) == (0, 0, 30, 20)


# formulas -------------------------------------------------------------------------------------------

BOTH = [
    (r"\frac{\sqrt{x}}{2}", "<math><mfrac><msqrt><mi>x</mi></msqrt><mn>2</mn></mfrac></math>", "(sqrt(x))/(2)"),
    (r"\frac{a+b}{\frac{1}{c}}", "<m:math xmlns:m='x'><m:mfrac><m:mrow><m:mi>a</m:mi><m:mo>+</m:mo><m:mi>b</m:mi></m:mrow><m:mfrac><m:mn>1</m:mn><m:mi>c</m:mi></m:mfrac></m:mfrac></m:math>", "(a+b)/((1)/(c))"),
    (r"x_1^{2}", "<msubsup><mi>x</mi><mn>1</mn><mn>2</mn></msubsup>", "x_(1)^(2)"),
    (r"{x^2}^3", "<msup><msup><mi>x</mi><mn>2</mn></msup><mn>3</mn></msup>", "(x^(2))^(3)"),
    (r"\left( a \times b \right) \leq 12.5", "<mrow><mo>(</mo><mi>a</mi><mo>&times;</mo><mi>b</mi><mo>)</mo><mo>≤</mo><mn>12.5</mn></mrow>", "(a*b)<=12.5"),
    (r"\sqrt[3]{x+\alpha}", "<mroot><mrow><mi>x</mi><mo>+</mo><mi>α</mi></mrow><mn>3</mn></mroot>", "root(3,x+alpha)"),
    (r"\begin{pmatrix}1&2\\3&x^2\\\end{pmatrix}", "<mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd><mtd><msup><mi>x</mi><mn>2</mn></msup></mtd></mtr></mtable>", "matrix(1,2;3,x^(2))"),
    (r"\text{area} = \Omega", "<mtext>area</mtext><mo>=</mo><mi>Ω</mi>", "area=Omega"),
    (r"{12}^2", "<msup><mn>12</mn><mn>2</mn></msup>", "12^(2)"),
    (r"(a,b)", "<mfenced><mi>a</mi><mi>b</mi></mfenced>", "(a,b)"),
    ("", "<math/>", ""),
]


@pytest.mark.parametrize("latex,mathml,want", BOTH)
def test_formulas_agree(latex, mathml, want):
    assert formulas.to_line(latex, "latex") == formulas.to_line(mathml, "mathml") == want


@pytest.mark.parametrize("notation,bad", [("latex", x) for x in (r"\frac{1}", "{x", "x}", "x^", r"x^{1}^{2}", r"\begin{a}x\end{b}", r"\sqrt[3", "{" * 400 + "}" * 400)] + [("mathml", x) for x in ("<mi>x", "</mi>", "<mfrac><mi>x</mi></mfrac>", "loose", "<mi>x</mo>", "a < b", "<mrow>" * 400 + "</mrow>" * 400)])
def test_malformed_formulas_are_null(notation, bad):
    assert formulas.to_line(bad, notation) is None


def _random_tree(rnd, depth):
    """(LaTeX, MathML) of a random formula."""
    if depth == 0:
        c = rnd.choice("abcxyz")
        return (c, f"<mi>{c}</mi>") if rnd.random() < 0.6 else ((n := str(rnd.randrange(1, 99))), f"<mn>{n}</mn>")
    kind, (a, x), (b, y) = rnd.randrange(6), _random_tree(rnd, depth - 1), _random_tree(rnd, depth - 1)
    r = lambda m: f"<mrow>{m}</mrow>"
    return [
        (rf"\frac{{{a}}}{{{b}}}", f"<mfrac>{r(x)}{r(y)}</mfrac>"), (rf"\sqrt{{{a}}}", f"<msqrt>{x}</msqrt>"), (f"{{{a}}}^{{{b}}}", f"<msup>{r(x)}{r(y)}</msup>"),
        (f"{{{a}}}_{{{b}}}", f"<msub>{r(x)}{r(y)}</msub>"), (rf"{a}+{b}", f"{x}<mo>+</mo>{y}"), (rf"\sqrt[{b}]{{{a}}}", f"<mroot>{r(x)}{r(y)}</mroot>") if "[" not in b else (rf"{a}-{b}", f"{x}<mo>−</mo>{y}"),
    ][kind]


def test_random_formulas_agree():
    rnd = random.Random(6)
    for _ in range(400):
        latex, mathml = _random_tree(rnd, rnd.randrange(0, 5))
        line = formulas.to_line(latex, "latex")
        assert line and line == formulas.to_line(mathml, "mathml")


def test_formula_columns(spark):
    df = spark.createDataFrame([(1, r"\frac12"), (2, None), (3, "{")], "id int, f string")
    assert {r.id: r.l for r in df.select("id", formulas.linear("f", "latex").alias("l")).collect()} == {1: "(1)/(2)", 2: None, 3: None}


# trees ----------------------------------------------------------------------------------------------


def _nodes(x, depth=0, path="$"):
    yield depth, path, x
    items = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
    for k, v in items:
        yield from _nodes(v, depth + 1, f"{path}.{k}" if isinstance(x, dict) else f"{path}[{k}]")


def _random_json(rnd, depth):
    if depth == 0 or rnd.random() < 0.2:
        return rnd.choice([None, 1, "x", True, [], {}, 2.5])
    if rnd.random() < 0.5:
        return [_random_json(rnd, depth - 1) for _ in range(rnd.randrange(0, 4))]
    return {"type": rnd.choice(["formula", "text", 3]), **{k: _random_json(rnd, depth - 1) for k in rnd.sample("abcd", rnd.randrange(0, 4))}}


def test_walks_meet_every_node(spark):
    rnd = random.Random(9)
    docs = {i: _random_json(rnd, 5) for i in range(40)}
    rows = [(i, json.dumps(x)) for i, x in docs.items()] + [(100, None), (101, "{no json")]
    df = spark.createDataFrame(rows, "id int, js string")
    got = trees.walk(df, "id", "js").select("id", "depth", "path", "empty", F.col("v").isNull().alias("none")).collect()
    want = Counter((i, d, p) for i, x in docs.items() for d, p, _ in _nodes(x))
    assert Counter((r.id, r.depth, r.path) for r in got if not r.empty and r.id < 100) == want
    empties = Counter((i, d + 1) for i, x in docs.items() for d, _, v in _nodes(x) if v in ([], {}))
    assert Counter((r.id, r.depth) for r in got if r.empty) == empties
    assert [(r.depth, r.none) for r in got if r.id >= 100] == [(0, True)] * 2
    count = {r.id: r.n for r in trees.count_kind(df, "id", "js", "formula").collect()}
    assert count == {**{i: sum(isinstance(v, dict) and v.get("type") == "formula" for _, _, v in _nodes(x)) for i, x in docs.items()}, 100: 0, 101: 0}


# ranges, scalars, contracts, paths --------------------------------------------------------------------


def test_sections_of_any_length(spark):
    rnd = random.Random(5)
    sections = [(i, i % 2, (lo := rnd.randrange(0, 3000)), lo + rnd.choice([-1, 0, 1, 7, 64, 1500, 2500])) for i in range(80)] + [(90, 0, None, 5), (91, 0, 0, 2**31 - 1)]
    questions = [(i, i % 3, rnd.choice([None, -1, *range(3000)])) for i in range(300)]
    q, s = spark.createDataFrame(questions, "id int, paper int, n int"), spark.createDataFrame(sections, "section int, paper int, lo int, hi int")
    got = sorted((r.id, r.section) for r in analytics.in_section(q, s, "paper", F.col("n"), "lo", "hi").collect())
    assert got == sorted((i, x) for i, p, n in questions for x, pp, lo, hi in sections if p == pp and n is not None and lo is not None and n >= 0 and lo <= n <= hi)
    assert analytics.in_section(q, s.filter("false"), "paper", F.col("n"), "lo", "hi").count() == 0


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_scalars_of_any_kind(spark):
    assert len(one(spark, S.expand_range(F.lit("1-1500")))) == 1500 and one(spark, S.expand_range(F.lit("5-3"))) == []
    assert one(spark, S.range_bounds(F.lit(" 7 ~ 2000000000 ")))["hi"] == 2000000000 and one(spark, S.range_bounds(F.lit("a"))) is None
    assert one(spark, S.safe_int(F.lit(3.7))) == 3 and one(spark, S.safe_int(F.lit(-3.7))) == -3 and one(spark, S.safe_int(F.lit("3.7"))) is None and one(spark, S.safe_int(F.lit(True))) == 1
    assert one(spark, S.safe_int(F.lit(float("nan")))) is None and one(spark, S.safe_int(F.lit(1e300))) is None


def test_regions_are_convex(spark):
    js = '{"questions":[{"number":"1","type":"choice","points":{"top_left":[0,0],"top_right":[900,10],"bottom_right":[%s],"bottom_left":[0,900]}}]}'
    ok = lambda p: one(spark, C.regions_ok(C.parse(F.lit(js % p), "regions"), ["choice"]))
    assert ok("950,980") and not ok("10,20") and not ok("1950,980")


def test_paths_keep_lost_nodes(spark):
    n = [("a", None), ("b", "a"), ("x", "gone"), ("y", "x"), ("z", "y"), *[(f"n{i}", f"n{i - 1}" if i else "b") for i in range(40)]]
    got = {r.node: (r.path, r.depth) for r in analytics.paths(spark.createDataFrame([(i, p, i) for i, p in n], "node string, parent string, label string"), "node", "parent", "label").collect()}
    assert len(got) == len(n) and got["x"] == got["y"] == got["z"] == (None, None) and got["n39"][1] == 41 and got["n1"][0] == "a/b/n0/n1"
    with pytest.raises(ValueError):
        analytics.paths(spark.createDataFrame([("a", "b", "a"), ("b", "a", "b")], "node string, parent string, label string"), "node", "parent", "label", depth=8).count()


def test_entry_survives_without_its_optional_part(spark):
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'version_resolve' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q if k[2:3].isdigit()), sorted(q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(__file__).resolve().parent.parent)).returncode == 0
