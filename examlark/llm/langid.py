"""Operator 1: language identification with hyperdimensional profiles.

Every letter has a random vector of +-1, derived from its code point. An n-gram's vector binds its letters
(elementwise product) after permuting them by their place (rotation). A text's vector bundles (adds) its
n-grams; a language's prototype bundles the unit vectors of its training texts. A text gets the language
whose prototype has the largest cosine, and that cosine, clipped to 0..1, as score.

Texts are lower-cased; what is not a letter counts as a word boundary. Prototypes are sums of integers, so
they do not depend on the order of rows. Of each language about ``max_train`` training texts are used, at most, chosen
by a hash of doc_id and text, so that a rare language keeps all of its own. Every language that has a row is learnt.

Cases: a null text or one without letters is `und` with score 0, as is every text when nothing can be
learnt; ties go to the first language in alphabetical order; a null doc_id is not held out; repeated rows
get equal results; of the input only the named columns are read or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIM, GRAM, SEED = 512, 3, 20240601
#: Training texts of each language, about; a documented bound.
MAX_TRAIN = 10_000
#: Texts whose n-grams are counted in one matrix.
ROWS = 512
#: N-grams whose vectors and counts are held at once.
GRAMS = 2048
SCALE = 1 << 20
UND = "und"
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)], bool)
    return _letters


def letter_vectors(points: np.ndarray, dim: int) -> np.ndarray:
    """A +-1 vector for each code point."""
    blocks = np.arange(dim // 64, dtype=np.uint64)
    bits = common.mix(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + blocks * np.uint64(0xD1B54A32D192ED03) + np.uint64(SEED))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def text_vectors(col: pa.Array, dim: int = DIM) -> np.ndarray:
    """The bundled n-gram vectors of texts (one row each; zero if a text has no letter)."""
    if len(col) > ROWS:
        return np.concatenate([text_vectors(col.slice(at, ROWS), dim) for at in range(0, len(col), ROWS)])
    texts = pc.utf8_lower(col.fill_null("")).to_pylist()
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    letter = letters()[codes]
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    del texts
    owner = np.repeat(np.arange(len(lens), dtype=np.int32), lens)  # a text and the separator after it
    owner = np.concatenate([owner[:1], owner])
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # one boundary after a word
    codes, owner, letter = np.where(letter, codes, np.uint32(32))[keep], owner[keep], letter[keep]
    out = np.zeros((len(lens), dim), np.float32)
    if len(codes) < 3:
        return out
    known = np.zeros(0x110000, bool)
    known[codes] = True
    alphabet = np.flatnonzero(known)
    n = len(alphabet)
    few = n**3 <= 1 << 23
    index = np.zeros(0x110000, np.int32 if few else np.int64)
    index[alphabet] = np.arange(n)
    index = index[codes]
    mid = letter[1:-1]  # around each letter; between two texts stands a boundary
    gram = index[:-2][mid] * n
    gram += index[1:-1][mid]
    gram *= n
    gram += index[2:][mid]
    text = owner[1:-1][mid]
    del codes, owner, letter, keep, index, mid
    if few:
        seen = np.zeros(n**3, bool)
        seen[gram] = True
        grams = np.flatnonzero(seen)
        place = np.zeros(n**3, np.int32)
        place[grams] = np.arange(len(grams))
        gram = place[gram]
    else:
        grams, gram = np.unique(gram, return_inverse=True)
    vectors = letter_vectors(alphabet, dim)
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    for at in range(0, len(grams), GRAMS):  # bounded work arrays, whatever the alphabet
        g = grams[at : at + GRAMS]
        bound = (first[g // (n * n)] * second[g // n % n] * vectors[g % n]).astype(np.float32)
        inside = (gram >= at) & (gram < at + len(g)) if len(grams) > GRAMS else slice(None)
        counts = np.bincount(text[inside] * np.int32(len(g)) + (gram[inside] - at), minlength=len(lens) * len(g))
        out += counts.reshape(len(lens), len(g)).astype(np.float32) @ bound
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_train: int = MAX_TRAIN) -> dict[str, np.ndarray]:
    """Prototypes (unit vectors) by language, from rows that are not held out."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.filter(~held_out("id") & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    few = sizes.limit(common.BROADCAST_KEYS + 1).count() <= common.BROADCAST_KEYS
    unit = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.join(F.broadcast(sizes) if few else sizes, "lang").filter(unit * F.col("n") < max_train)

    @common.tidy
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in common.slices(batch, "text", common.CHUNK_BYTES // 2):
                v = text_vectors(common.column(part, "text"))
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                unit = np.rint(v / np.maximum(norm, 1e-9) * SCALE).astype(np.int64)
                names = np.array(common.column(part, "lang").to_pylist(), object)
                for name in set(names.tolist()):
                    sums[name] = sums.get(name, 0) + unit[names == name].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = rows.select("lang", "text").mapInArrow(bundle, "lang string, v array<bigint>")
    sums = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).collect()  # a row of DIM numbers for each language
    out = {r["lang"]: np.array([p["x"] for p in r["v"]], float) / SCALE for r in found}
    return {k: v / max(np.linalg.norm(v), 1e-9) for k, v in sorted(out.items())}


def identify(df: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The kept columns, the predicted language and its cosine."""
    langs = list(prototypes)
    matrix = np.stack([prototypes[k] for k in langs]).astype(np.float32).T if langs else np.zeros((DIM, 0), np.float32)

    def fn(col: pa.Array) -> dict[str, pa.Array]:
        v = text_vectors(col)
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        if not langs:
            return {names[0]: pa.array([UND] * len(v), pa.string()), names[1]: pa.array(np.zeros(len(v)))}
        cos = (v @ matrix) / np.maximum(norm, 1e-9)[:, None]
        best, known = cos.argmax(axis=1), norm > 0
        score = np.where(known, np.clip(cos[np.arange(len(v)), best].astype(np.float64), 0, 1), 0.0)
        return {names[0]: pa.array([langs[i] if k else UND for i, k in zip(best, known)], pa.string()), names[1]: pa.array(score)}

    return common.map_appending(df, keep, text, f"`{names[0]}` string, `{names[1]}` double", fn)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
