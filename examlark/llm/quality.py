"""Operator 3: quality as attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is described by features of its bytes and
words, and encoded by a layer of tanh. Gated attention (a tanh and a sigmoid branch) weighs the passages;
the weights are learnt from document labels alone, together with the encoder, by gradient descent on the
driver. A document's score is the logistic of a linear function of the weighted passage representation.

Training uses at most ``MAX_BAGS`` labelled documents, chosen by hash, and of each at most ``MAX_PASSAGES``
passages, spread evenly; both are documented bounds. Of rows that repeat a doc_id one text is learnt from, that of the
smallest hash. Scoring takes every passage of every text.

Cases: a null or empty text is one empty passage and gets a score; without labels of both kinds the score
is the share of label 1 (0.5 without labels); null labels are left out; a null doc_id is not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PASSAGE = 64
MAX_BAGS, MAX_PASSAGES = 5000, 48
HIDDEN, ATTENTION, EPOCHS, SEED = 24, 16, 25, 7
N_FEATURES = 24


def _classes() -> np.ndarray:
    """Of each byte: 0 space, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other mark, 6 beyond ASCII, 7 control."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = 6 if b >= 0x80 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 0 if c == " " or 9 <= b <= 13 else 7 if b < 32 or b == 127 else 4 if c in ".,;:?'\"-" else 5
    return out


CLASSES = _classes()


def passages(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passages of each text; at least one)."""
    data, offsets = common.utf8(col)
    starts, ends, first = common.word_spans(data, offsets)
    n_words = np.diff(first)
    n_pass = np.maximum((n_words + PASSAGE - 1) // PASSAGE, 1)
    total = int(n_pass.sum())
    out = np.zeros((total, N_FEATURES), np.float64)
    if not len(starts):
        return out, n_pass
    lens = ends - starts
    text_of_word = np.repeat(np.arange(len(n_words)), n_words)
    base = np.cumsum(n_pass) - n_pass
    within = np.arange(len(starts)) - first[:-1][text_of_word]
    passage = base[text_of_word] + within // PASSAGE
    words = np.bincount(passage, minlength=total).astype(np.float64)
    some = np.maximum(words, 1)
    # bytes of words, by class
    flat_first = np.cumsum(lens) - lens
    byte_passage = np.repeat(passage, lens)
    src = data[np.repeat(starts - flat_first, lens) + np.arange(int(lens.sum()))]
    kind = CLASSES[src]
    by_class = np.bincount(byte_passage * 8 + kind, minlength=total * 8).reshape(total, 8)
    size = np.maximum(by_class.sum(axis=1), 1)
    out[:, 0:7] = (by_class / size[:, None])[:, 1:8]
    out[:, 7] = size / some
    mean = np.bincount(passage, lens, total) / some
    out[:, 8] = np.sqrt(np.maximum(np.bincount(passage, lens.astype(np.float64) ** 2, total) / some - mean**2, 0))
    hashes = common.word_hashes(data, starts, ends, True)
    repeated = np.zeros(len(hashes), bool)
    repeated[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    out[:, 9] = np.bincount(passage, repeated, total) / some
    order = np.lexsort((hashes, passage))
    h, p = hashes[order], passage[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])]
    out[:, 10] = np.bincount(p, new, total) / some
    begin, last = CLASSES[data[starts]], CLASSES[data[ends - 1]]
    out[:, 11] = np.bincount(passage, begin == 2, total) / some
    out[:, 12] = np.bincount(passage, last == 4, total) / some
    out[:, 13] = np.bincount(passage, last == 5, total) / some
    out[:, 14] = np.bincount(passage, (lens == 1) & (begin == 5), total) / some
    upper = np.bincount(np.repeat(np.arange(len(starts)), lens), kind == 2, len(starts))
    out[:, 15] = np.bincount(passage, (upper >= 2) & (upper * 2 >= lens), total) / some
    out[:, 16] = np.bincount(passage, begin == 3, total) / some
    out[:, 17] = np.bincount(passage, lens >= 14, total) / some
    out[:, 18] = np.bincount(passage, lens <= 3, total) / some
    # lines that end in the passage
    gap_lines = np.zeros(len(starts))
    lines = np.cumsum(data == 10)
    gap_lines[1:] = (lines[starts[1:]] - lines[starts[:-1]]) * (text_of_word[1:] == text_of_word[:-1])
    out[:, 19] = np.bincount(passage, gap_lines, total) / some
    out[:, 20] = np.minimum(words, PASSAGE) / PASSAGE
    out[:, 21] = np.log1p(np.repeat(n_words, n_pass))
    common_share = np.bincount(p, new & (np.r_[(h[1:] == h[:-1]) & (p[1:] == p[:-1]), False]), total)
    out[:, 22] = common_share / some
    out[:, 23] = words > 0
    return out, n_pass


class Model:
    """Encoder, gated attention and classifier; ``prior`` alone if nothing can be learnt."""

    def __init__(self, prior: float, mean: np.ndarray | None = None, scale: np.ndarray | None = None) -> None:
        self.prior, self.mean, self.scale = prior, mean, scale
        rng = np.random.default_rng(SEED)
        g = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"W": g(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, ATTENTION), "U": g(HIDDEN, ATTENTION), "w": g(ATTENTION, 1)[:, 0], "c": g(HIDDEN, 1)[:, 0], "d": np.zeros(1)}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, at = self.p, np.cumsum(counts) - counts
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
        a = e / np.repeat(np.add.reduceat(e, at), counts)
        z = np.add.reduceat(h * a[:, None], at)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        at = np.cumsum(counts) - counts
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(counts))
            rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
            for k in range(0, len(order), 64):
                bags = order[k : k + 64]
                n = counts[bags]
                rows = np.repeat(at[bags] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                grads = self._grads(x[rows], n, y[bags])
                step += 1
                for name, gr in grads.items():
                    gr = gr + 1e-4 * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * gr
                    v2[name] = 0.999 * v2[name] + 0.001 * gr * gr
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.999**step)) + 1e-8)

    def _grads(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, n)
        dy = (f["y"] - y) / len(y)
        dz = np.repeat(dy, n)[:, None] * p["c"]
        at = np.cumsum(n) - n
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at), n))
        dts = de[:, None] * p["w"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = dz * f["a"][:, None] + dt @ p["V"].T + ds @ p["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        return {"W": x.T @ dpre, "b": dpre.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "d": np.array([dy.sum()])}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(counts), self.prior)
        return self.forward((x - self.mean) / self.scale, counts)["y"]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    sample = (
        labels.filter(~held_out(doc_id) & F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
        .select(doc_id, F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64(doc_id), doc_id, "y")
        .limit(MAX_BAGS)
    )
    sample = sample.groupBy(doc_id).agg(F.max("y").alias("y"))
    rows = docs.select(doc_id, text).join(F.broadcast(sample), doc_id)  # at most MAX_BAGS keys
    rows = rows.groupBy(doc_id).agg(F.max("y").alias("y"), F.min_by(text, F.xxhash64(text)).alias(text))  # and as many rows

    def fn(col: pa.Array) -> dict[str, pa.Array]:
        x, n = passages(col)
        at = np.cumsum(n) - n
        pick = [a + np.unique(np.linspace(0, k - 1, min(k, MAX_PASSAGES)).astype(np.int64)) for a, k in zip(at, n)]
        flat = x[np.concatenate(pick)] if pick else x
        return {"x": common.lists(flat.astype(np.float32).ravel(), np.array([len(k) * N_FEATURES for k in pick]), pa.float32())}

    got = common.map_appending(rows, [doc_id, "y"], text, "x array<float>", fn).toArrow().combine_chunks()
    if got.num_rows == 0:
        return Model(0.5)
    bags = sorted(((i, y, np.array(x, np.float64)) for i, y, x in zip(got[doc_id].to_pylist(), got["y"].to_pylist(), got["x"].combine_chunks().to_numpy(zero_copy_only=False))), key=lambda b: (b[0], b[1], b[2].tobytes()))
    y = np.array([b[1] for b in bags], np.float64)
    if y.min() == y.max():
        return Model(float(y.mean()))
    x = np.concatenate([b[2] for b in bags]).reshape(-1, N_FEATURES)
    counts = np.array([len(b[2]) // N_FEATURES for b in bags])
    model = Model(float(y.mean()), x.mean(axis=0), x.std(axis=0) + 1e-6)
    model.fit((x - model.mean) / model.scale, counts, y)
    return model


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The kept columns and the score."""

    def fn(col: pa.Array) -> dict[str, pa.Array]:
        x, n = passages(col)
        return {name: pa.array(np.clip(model.score(x, n), 0.0, 1.0))}

    return common.map_appending(df, keep, text, f"`{name}` double", fn)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, common.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
