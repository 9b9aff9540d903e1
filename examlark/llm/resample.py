"""Operator 13: importance resampling towards a target distribution.

Features are runs of one and of two words, hashed into buckets. How often each bucket stands in the whole corpus and in the
target texts gives its gain, the logarithm of the ratio of smoothed shares; a document's weight is the mean gain of its features.
A draw without replacement takes the highest weights plus noise (Gumbel's, from a hash of the document's id).

Identical texts are collapsed first, by grouping full texts with their number; features are computed once for each text
and kept as bucket numbers; corpus counts are those of a text times its number. Weights go back to documents by a
SHA-256 of the text, noise comes after that. Texts that hold at least a thousandth of all rows (a thousand at most) are
joined by broadcast, so that no task gets all rows of a frequent text. Ranks come from a range partitioning that is written once: place in the part plus the sizes of
the parts before.

Cases: null and empty texts have no feature, weight 0, and are never drawn; equal texts have equal weights and each its
own noise; rows that repeat a doc_id are rows of their own, with equal noise; a null doc_id is the empty text in the hash and comes last
among ties; without target texts all buckets are smoothed alike; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 7, 25, 20
#: Texts with more than this share of the rows are joined by broadcast: there are at most as many.
HOT_SHARE = 1000
_LONG = 256


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()


def crc32_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Goes on from CRC-32 values with the bytes of spans, all spans at once."""
    lens = ends - starts
    order = np.argsort(-lens, kind="stable")
    s, at, n = ~state[order], starts[order], lens[order]
    some = np.searchsorted(-n, -_LONG, side="left")  # the longest go one by one
    live = len(n)
    for i in range(int(n[some]) if some < len(n) else 0):
        live = int(np.searchsorted(-n, -i, side="left"))
        part = s[some:live]
        s[some:live] = _TABLE[(part ^ data[at[some:live] + i]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty(len(n), np.uint32)
    out[order] = ~s
    for i in order[:some]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]))
    return out


def feature_buckets(col: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature of all texts, features of each text, words of each text)."""
    data, offsets = common.utf8(col)
    data = common.LOWER[data]
    starts, ends, first = common.word_spans(data, offsets, common.ALNUM)
    words = np.diff(first)
    one = crc32_on(np.zeros(len(starts), np.uint32), data, starts, ends)
    pos, text = common.inside_one_text(first, 2, len(starts))
    spaced = ~one[pos]
    spaced = ~(_TABLE[(spaced ^ np.uint32(32)) & np.uint32(255)] ^ (spaced >> np.uint32(8)))
    two = crc32_on(spaced, data, starts[pos + 1], ends[pos + 1])
    owner = np.r_[np.repeat(np.arange(len(words)), words), text]
    ids = (np.r_[one, two] % np.uint32(buckets)).astype(np.int32)
    return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words)), words


def features(texts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, n_words, and the bucket of every feature."""

    def fn(col: pa.Array) -> dict[str, pa.Array]:
        ids, n, words = feature_buckets(col)
        return {"n_words": pa.array(words, pa.int64()), "buckets": common.lists(ids.astype(np.int16), n, pa.int16())}

    return common.map_appending(texts, keep, text, "n_words bigint, buckets array<smallint>", fn)


def bucket_counts(found: DataFrame, times: str) -> DataFrame:
    """(bucket, n) of all features, each row's as often as the column ``times`` says."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            lists = common.column(batch, "buckets")
            n = np.diff(lists.offsets.to_numpy())
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            many = np.repeat(common.column(batch, times).to_numpy(zero_copy_only=False), n)
            total += np.rint(np.bincount(ids, weights=many, minlength=BUCKETS)).astype(np.int64)  # whole numbers below 2 ** 53
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return found.select("buckets", times).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of every bucket that the corpus has."""
    # one row with both totals
    totals = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total_s")).crossJoin(F.broadcast(target.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total_t"))))
    both = corpus.withColumnRenamed("n", "s").join(F.broadcast(target.withColumnRenamed("n", "t")), "bucket", "left").crossJoin(F.broadcast(totals))  # BUCKETS rows
    up = (F.coalesce("t", F.lit(0)).cast("double") + 1) * (F.col("total_s") + float(BUCKETS))
    down = (F.col("s").cast("double") + 1) * (F.col("total_t") + float(BUCKETS))
    return both.select("bucket", F.floor(F.log(up / down) * 1000).cast("bigint").alias("gain"))


def weigh(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of docs."""
    digest = F.sha2("text", 256)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    once = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select("text", "copies", F.unhex(digest).alias("digest"))
    found = common.materialize(features(once, ["digest", "copies"]), "features")
    aims = features(target.select(F.coalesce(text, F.lit("")).alias("text"), F.lit(1).alias("copies")), ["copies"])
    gain = np.zeros(BUCKETS, np.int64)
    for r in gains(bucket_counts(found, "copies"), bucket_counts(aims, "copies")).collect():  # BUCKETS rows
        gain[r["bucket"]] = r["gain"]

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = common.column(batch, "buckets")
            at = lists.offsets.to_numpy().astype(np.int64)
            sums = np.r_[0, np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])]
            n = np.diff(at)
            weight = (sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]) // np.maximum(n, 1)
            kept = [common.column(batch, c) for c in ("digest", "copies", "n_words")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n), pa.array(weight)], names=["digest", "copies", "n_words", "n_features", "weight"])

    weights = common.materialize(found.mapInArrow(run, "digest binary, copies bigint, n_words bigint, n_features bigint, weight bigint"), "weights")
    total = weights.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    value = F.struct("n_words", "n_features", "weight")
    frequent = F.col("copies") * HOT_SHARE >= total
    hot = weights.filter(frequent & (F.col("copies") > 1)).select("digest", value.alias("hot"))
    rest = weights.filter(~(frequent & (F.col("copies") > 1))).select(F.col("digest").alias("key"), value.alias("cold"))
    out = rows.select("doc_id", F.unhex(digest).alias("digest")).join(F.broadcast(hot), "digest", "left")  # HOT_SHARE rows at most
    lone = F.concat(F.lit(b"\x00"), F.unhex(F.hex(F.xxhash64("doc_id"))))  # as no digest is: spreads rows that are joined already
    out = out.withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(lone)).join(rest, "key", "left")
    return out.select("doc_id", F.coalesce("hot", "cold").alias("w")).select("doc_id", "w.n_words", "w.n_features", "w.weight")


def ranked(df: DataFrame, name: str, order: list) -> DataFrame:
    """df with the whole-table rank 1, 2, 3 ... by an order, for any number of rows: no task sees more than a range."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    placed = common.materialize(placed, "ranges")  # part << 33 | place; written once, so that it stays
    part = F.shiftright(F.col(name), 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each part
    sizes, before, at = sorted((r["part"], r["n"]) for r in sizes), [], 0
    for p, n in sizes:
        before.append((p, at))
        at += n
    first = spark.createDataFrame(before or [(0, 0)], T.StructType([T.StructField("_part", T.LongType()), T.StructField("_before", T.LongType())]))
    out = placed.join(F.broadcast(first), part == F.col("_part"))
    return out.withColumn(name, F.col("_before") + F.col(name).bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null where a row is not drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("bigint")
    scored = weigh(docs, target, doc_id, text).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))
    scored = common.materialize(scored, "scores")
    fit = F.col("n_words") >= least_words
    drawn = scored.filter(fit).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    columns = ["doc_id", "n_features", "weight", "score"]
    first = ranked(scored.filter(fit).select(*columns), "rank", order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return first.unionByName(scored.filter(~fit).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, common.table(spark, sf_dir, "benchmark").select("text"))
