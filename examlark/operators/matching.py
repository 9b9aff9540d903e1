"""Retrieval and matching: canonical hashes, BM25, vectors, score fusion. The formulas are published ones."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlark.functions.scalars import dot, normal_stem

#: Rows of a probe side that is broadcast, at most.
PROBE_ROWS = 10_000


def canonical(df: DataFrame, key: str, text: str) -> DataFrame:
    """First key of every normalised text."""
    h = F.sha2(normal_stem(text), 256)
    return df.groupBy(h.alias("canonical_hash")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    words = F.filter(F.split(normal_stem(text), " "), lambda w: w != "")
    return df.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, qkey: str, dkey: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, document, score) by Robertson's formula, for pairs that share a term.

    Documents are dealt by their key, once and with their text; their words, counts and scores then follow in the same task, so that of all
    these rows none is shuffled. The vocabulary is broadcast only if it is small; beyond, its joins shuffle document terms."""
    q = terms(queries, qkey, text).withColumnRenamed("tf", "qtf")
    vocabulary = q.select("term").distinct()
    small = vocabulary.limit(PROBE_ROWS * 100 + 1).count() <= PROBE_ROWS * 100
    few = small and q.limit(PROBE_ROWS * 100 + 1).count() <= PROBE_ROWS * 100
    # as many parts as asked for: a part's scores are many more than its documents
    dealt = docs.select(dkey, text).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), dkey)
    words = dealt.select(dkey, F.filter(F.split(normal_stem(text), " "), lambda w: w != "").alias("ws"))
    stats = words.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("ws")).alias("avgdl"))
    t = words.select(dkey, F.size("ws").alias("dl"), F.explode("ws").alias("term")).join(F.broadcast(vocabulary) if small else vocabulary, "term", "left_semi")
    t = t.groupBy(dkey, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df_ = t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # no larger than the vocabulary
    w = t.join(F.broadcast(df_) if small else df_, "term").crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = w.select("term", dkey, (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("w"))
    return w.join(F.broadcast(q) if few else q, "term").groupBy(qkey, dkey).agg(F.sum(F.col("w") * F.col("qtf")).alias("score"))


def top_k(scored: DataFrame, query: str, candidate: str, score: str, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller candidate; the rank limit runs before the shuffle, too."""
    w = Window.partitionBy(query).orderBy(F.desc(score), candidate)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Queries and vectors that meet in a task, about, and how much more than rounding a bound has to fall short by.
QUERY_BLOCK, VECTOR_BLOCK, SLACK = 2048, 8192, 2e-6


def vector_top_k(queries: DataFrame, vectors: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """Cosine top-k of a query set of any size, as (query_id, key, score, rank): both sides are counted and cut into blocks, and each
    two blocks meet in a task, as a product of matrices. A query's k best of each task are all that is shuffled.

    Exact: what comes near the k-th product is computed again, term by term. Of equal scores in a task the k smallest keys are kept.
    A vector whose norm is zero or not finite has no cosine: it is no candidate, and as a query it has no row. Vectors of different lengths have none with each other."""
    norm = lambda c: F.sqrt(dot(c, c))
    usable = (F.col("_norm") > 0) & (F.col("_norm") < float("inf"))
    side = lambda df: df.select(F.col(key).alias("_key"), F.col(vec).cast("array<double>").alias("_v"), norm(vec).alias("_norm"), F.size(vec).alias("_size")).filter(usable)
    many = lambda df, block: max(1, -(-df.count() // block))
    parts = {"_q": many(queries, QUERY_BLOCK), "_c": many(vectors, VECTOR_BLOCK)}
    own = lambda name: F.pmod(F.xxhash64("_key"), F.lit(parts[name])).cast("int").alias(name)
    every = lambda name: F.explode(F.sequence(F.lit(0), F.lit(parts[name] - 1))).alias(name)
    by = ["_size", "_q", "_c"]
    q, c = side(queries).select("*", own("_q"), every("_c")).groupBy(*by), side(vectors).select("*", own("_c"), every("_q")).groupBy(*by)
    kind = vectors.schema[key].dataType.simpleString()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        def read(t: pa.Table) -> tuple:
            v = t.column("_v").combine_chunks()
            return t.column("_key").to_numpy(), v.flatten().to_numpy().reshape(len(v), -1), t.column("_norm").to_numpy()

        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            (qk, qv, qn), (ck, cv, cn) = read(left), read(right)
            unit = (cv / cn[:, None]).T
            for at in range(0, len(qk), 256):
                k_, v_, n_ = qk[at : at + 256], qv[at : at + 256], qn[at : at + 256]
                s = (v_ / n_[:, None]) @ unit
                s[k_[:, None] == ck[None]] = -np.inf  # a query is no candidate of its own
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(k_), -np.inf)
                i, j = np.nonzero((s >= least[:, None] - SLACK) & (s > -np.inf))
                score = np.zeros(len(i))
                for d in range(v_.shape[1]):
                    score += v_[i, d] * cv[j, d]
                score /= n_[i] * cn[j]
                order = np.lexsort((ck[j], score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.r_[True, (i[1:] != i[:-1]) | (score[1:] != score[:-1])] if len(i) else np.zeros(0, bool)
                place = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
                out.append((k_[i[place < k]], ck[j[place < k]], score[place < k]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [[], [], []]
        types = [right.schema.field("_key").type] * 2 + [pa.float64()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=["query_id", key, "score"])

    s = q.cogroup(c).applyInArrow(meet, f"query_id {kind}, `{key}` {kind}, score double")
    return top_k(s.withColumn("score", F.round("score", 6)), "query_id", key, "score", k)


def fuse(text: Column, vector: Column, formula: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    """Weighted sum of decimals as DECIMAL(5,4), halves up; missing scores are 0."""
    part = lambda c, w: F.coalesce(c, F.lit(0.0)).cast("decimal(12,8)") * F.lit(Decimal(str(w)))
    return F.round(part(text, weights[0]) + part(vector, weights[1]) + part(formula, weights[2]), 4).cast("decimal(5,4)")


def accept(scored: DataFrame, query: str, candidate: str, score: str, least: float) -> DataFrame:
    """The best candidate of each query, accepted from a threshold on; ties to the smaller candidate."""
    best = scored.groupBy(query).agg(F.max(F.struct(F.col(score), F.negative(F.col(candidate)).alias("c"))).alias("b"))
    return best.select(query, F.negative(F.col("b.c")).alias(candidate), F.col(f"b.{score}").alias(score), (F.col(f"b.{score}") >= least).alias("accepted"))


def blocked_pairs(df: DataFrame, key: str, block: list[str], score: Column, least: float, columns: list[str], near: tuple[str, float] | None = None) -> DataFrame:
    """Pairs i < j inside a block whose score (over a.* and b.*) reaches a threshold.

    near: a numeric column, and the most it may differ by in such a pair. A block is then cut into slices of that width and
    a row meets its own slice and the next alone, so that a block with very many rows is many keys, and what is
    compared grows with what is found. Where the column is null, a row has no pair."""
    a, b = df.select(key, *block, *columns), df.select(key, *block, *columns)
    on = list(block)
    if near:  # two rows are in one slice, or in neighbours: each pair meets once
        slice_ = F.floor(F.col(near[0]) / F.lit(near[1])).alias("_slice")
        a, b = a.select("*", F.explode(F.array(slice_, slice_ + 1)).alias("_slice"), slice_.alias("_own")), b.select("*", slice_, slice_.alias("_own"))
        on.append("_slice")
    a, b = a.alias("a"), b.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
    ordered = F.col(f"a.{key}") < F.col(f"b.{key}")
    if near:  # of neighbours, either may have the smaller key
        ordered = ordered | ((F.col("a._own") != F.col("b._own")) & (F.col(f"a.{key}") != F.col(f"b.{key}")))
        pairs = a.join(b, [*on, ordered]).withColumn("pair_score", score).filter(F.col("pair_score") >= least)
        return pairs.select(F.least(F.col(f"a.{key}"), F.col(f"b.{key}")).alias("source_id"), F.greatest(F.col(f"a.{key}"), F.col(f"b.{key}")).alias("target_id"), "pair_score")
    return a.join(b, [*on, ordered]).withColumn("pair_score", score).filter(F.col("pair_score") >= least).select(F.col(f"a.{key}").alias("source_id"), F.col(f"b.{key}").alias("target_id"), "pair_score")
