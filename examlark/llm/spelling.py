"""Operator 12: grouping spelling variants by two-dimensional range reporting.

Words are near if one edit of a code point (inserted, deleted, replaced) makes one of the other. If the edit is at place i of
the longer word (of either, where lengths are equal), both have the same prefix before i and the same suffix
behind. In the forward order of all words of a length, those with a prefix are an interval; in the order of reversed
words, those with a suffix are one. A wavelet tree over the reversed ranks, in forward order, reports what lies in both
intervals, for every word and every place of an edit: exactly the near words, and the word itself.

Words are dealt to trees by what an edit leaves alone. For words of length f (and the shorter ones of length f - 1, which only ask), the
places of an edit are cut into halves; inside a half, the letters before and behind it are the key. A key with more than
``MAX_KEY`` words is cut into the two halves of its places, whose keys have more letters, and so on: a key for a
single place leaves one letter open, so that no key can grow with the input. Keys are hashed into buckets, and each bucket is a task's
set of trees. A near pair is reported once: at the place of its edit, and of equal letters in a row at the first.

A word's form is its near word of largest count (ties: the smallest in code-point order), if that is at least ``ratio`` times
its own; following forms leads to the root, in steps that double (counts grow by ``ratio``, so that paths are short).

Cases: null and empty texts have no words; a null doc_id is the empty text in the hash that deletes letters; repeated rows
count as often as they stand; an empty table has no words; other columns play no part; runs of any length are words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words for a key before it is cut in two; rows for a bucket, and least number of buckets.
MAX_KEY, BUCKET_ROWS, LEAST_BUCKETS = 4096, 20_000, 64
LETTERS = "A-Za-z\u00C0-\u00FF"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased; where crc32 of <doc_id>:<run> is divisible by ``every``, one letter is left out."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text, F.lit(f"([{LETTERS}]{{{least_length},}})"), 1)).alias("r"))
    runs = runs.select("d", F.translate("r", _UPPER, _LOWER).alias("w")).select("w", F.length("w").alias("l"), F.crc32(F.concat_ws(":", "d", "w").cast("binary")).alias("h"))
    at = F.pmod("h", "l").cast("int")
    word = F.when(F.pmod("h", F.lit(every)) == 0, F.concat(F.col("w").substr(F.lit(1), at), F.col("w").substr(at + 2, F.col("l")))).otherwise(F.col("w"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.length("word") >= least_length) & (F.col("n") >= least_count))


# ---------------------------------------------------------------- wavelet tree


class Wavelet:
    """Of a permutation: which values of a range stand in an interval of places, for many questions at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        now = values.astype(np.int64)
        for bit in range(max(int(len(values) - 1).bit_length(), 1) - 1, -1, -1):
            ones = (now >> bit) & 1
            zeros = np.r_[0, np.cumsum(1 - ones)]
            self.levels.append((bit, zeros, int(zeros[-1])))
            now = np.r_[now[ones == 0], now[ones == 1]]

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, value) of all values in [low, high) at places [left, right)."""
        q = np.flatnonzero((left < right) & (low < high))
        a, b, base = left[q], right[q], np.zeros(len(q), np.int64)
        for bit, zeros, n in self.levels:
            a0, b0 = zeros[a], zeros[b]
            a1, b1 = n + a - a0, n + b - b0
            half = base + (1 << bit)
            stay = (a0 < b0) & (half > low[q]) & (base < high[q])
            go = (a1 < b1) & (half < high[q]) & (half + (1 << bit) > low[q])
            q, a, b, base = np.r_[q[stay], q[go]], np.r_[a0[stay], a1[go]], np.r_[b0[stay], b1[go]], np.r_[base[stay], half[go]]
        return q, base


def _ranks(rows: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of code points in their order."""
    if rows.shape[1] == 0:
        return np.zeros(len(rows), np.int64)
    return np.unique(np.ascontiguousarray(rows).view(f"U{rows.shape[1]}")[:, 0], return_inverse=True)[1].astype(np.int64)


def near_in(longer: np.ndarray, shorter: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs whose edit is at a place in [a, b) of the longer word, each once.

    longer: (n, f) code points, shorter: (m, f - 1). Returns numbers of rows: x < n of a longer word, y of its partner, which is
    a longer word where y < n, else a shorter one."""
    n, f = longer.shape
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n == 0 or n + len(shorter) < 2:
        return none
    both = lambda x, y: np.concatenate([x, y]).astype(np.int64)
    # prefixes of length i, and suffixes behind place i
    prefix = {a: _ranks(np.concatenate([longer[:, :a], shorter[:, :a]]))}
    for i in range(a + 1, b):
        prefix[i] = np.unique(prefix[i - 1] << 21 | both(longer[:, i - 1], shorter[:, i - 1]), return_inverse=True)[1]
    suffix = {b - 1: _ranks(np.concatenate([longer[:, b:][:, ::-1], shorter[:, b - 1 :][:, ::-1]]))}
    for i in range(b - 2, a - 1, -1):
        suffix[i] = np.unique(suffix[i + 1] << 21 | both(longer[:, i + 1], shorter[:, i]), return_inverse=True)[1]
    forward, backward = np.argsort(prefix[b - 1][:n], kind="stable"), np.argsort(suffix[a][:n], kind="stable")
    rank = np.empty(n, np.int64)
    rank[backward] = np.arange(n)
    tree = Wavelet(rank[forward])
    ask, place, left, right, low, high = [], [], [], [], [], []
    for i in range(a, b):
        p, s = prefix[i][:n][forward], suffix[i][:n][backward]
        l, r = (np.searchsorted(p, prefix[i], side=x) for x in ("left", "right"))
        lo, hi = (np.searchsorted(s, suffix[i], side=x) for x in ("left", "right"))
        own = np.arange(len(prefix[i])) < n  # a longer word finds itself
        some = np.flatnonzero((r - l > own) & (hi - lo > own))
        for to, x in ((ask, some), (place, np.full(len(some), i)), (left, l[some]), (right, r[some]), (low, lo[some]), (high, hi[some])):
            to.append(x)
    ask, place = np.concatenate(ask), np.concatenate(place)
    q, value = tree.report(*(np.concatenate(x).astype(np.int64) for x in (left, right, low, high)))
    x, y, i = backward[value], ask[q], place[q]
    first = (i == 0) | (longer[x, i] != longer[x, np.maximum(i - 1, 0)])  # of equal letters in a row, any may be the one too many
    keep = np.where(y < n, x < y, first)
    return x[keep], y[keep]


_OUT = "word string, near string, near_n bigint"


def _bucket(table: pa.Table) -> pa.Table:
    """Near pairs, in both directions, of a bucket's rows."""
    words = np.array(table["word"].to_pylist(), object)
    counts = table["n"].to_numpy()
    lengths = np.array([len(w) for w in words], np.int64)
    f, a, b = (table[c].to_numpy() for c in ("f", "a", "b"))
    order = np.lexsort((lengths, b, a, f))
    cuts = np.flatnonzero(np.r_[True, (f[order][1:] != f[order][:-1]) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    left, right = [], []
    for rows in np.split(order, cuts[1:]):
        size = int(f[rows[0]])
        long, short = rows[lengths[rows] == size], rows[lengths[rows] < size]
        grid = lambda ids, k: np.array(words[ids].tolist(), f"U{k}").view(np.uint32).reshape(len(ids), k) if len(ids) else np.zeros((0, k), np.uint32)
        x, y = near_in(grid(long, size), grid(short, size - 1), int(a[rows[0]]), int(b[rows[0]]))
        left.append(long[x])
        right.append(np.r_[long, short][y])
    x, y = np.concatenate([*left, *right]), np.concatenate([*right, *left])
    return pa.table([pa.array(words[x].tolist(), pa.string()), pa.array(words[y].tolist(), pa.string()), pa.array(counts[y], pa.int64())], names=["word", "near", "near_n"])


# ---------------------------------------------------------------- Spark


def _key() -> Column:
    """What an edit in [a, b) of a word of length f leaves alone."""
    behind = F.col("b") + 1 - (F.col("f") - F.length("word"))
    return F.xxhash64("f", "a", "b", F.substr("word", F.lit(1), F.col("a")), F.substr("word", behind))


def _halves(df: DataFrame) -> DataFrame:
    """Each row's places, cut in two."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    two = F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b").alias("b")))
    return df.select("word", "n", "f", F.inline(two)).filter("a < b").withColumn("key", _key())


def near_words(words: DataFrame, max_key: int = MAX_KEY) -> DataFrame:
    """(word, near, near_n) of all near pairs of the distinct words (word, n), in both directions."""
    rows = words.select("word", F.col("n").cast("bigint").alias("n"), F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("f"))
    rows = _halves(rows.withColumns({"a": F.lit(0), "b": F.col("f")}))
    done = None
    while True:  # ends: a range of one place is not cut
        large = rows.groupBy("key", "a", "b").agg(F.count(F.lit(1)).alias("c")).filter((F.col("c") > max_key) & (F.col("b") - F.col("a") > 1)).select("key").distinct()
        large = common.materialize(large, "large-keys")
        if large.isEmpty():
            done = rows if done is None else done.unionByName(rows)
            break
        kept = common.keep_ids(rows, large, "key", "left_anti").select(*rows.columns)
        done = kept if done is None else done.unionByName(kept)
        rows = common.materialize(_halves(common.keep_ids(rows, large, "key")), "cut-keys")
    buckets = max(LEAST_BUCKETS, words.count() * 4 // BUCKET_ROWS)
    done = done.select("word", "n", "f", "a", "b", F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"))
    return done.groupBy("bucket").applyInArrow(_bucket, _OUT)


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """words: (word, n), distinct. Returns word, form, root, n, n_near, form_n."""
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    is_form = -F.col("best.m") >= F.lit(ratio) * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"))
    out = common.materialize(out, "forms")
    up = common.materialize(out.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if up.join(further, "root", "left_semi").isEmpty():
            break
        up = common.materialize(up.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return out.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(common.materialize(vocabulary(docs), "vocabulary"))
