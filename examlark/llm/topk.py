"""Operator 10: exact top-k by inner product, with ball-tree branch and bound in every shard.

Rows are dealt into shards by a hash of vec_id. A shard's rows come to one task, which builds a ball tree over them once
and streams the queries past it. A node's inner products are at most q.centre + |q| radius. Every query first goes down
to the child of the higher bound, level by level, and scores that leaf, so that it has a k-th score before anything else. A descent then leaves nodes out, inner ones as well,
whose bound is below a query's current k-th score, and every query visits its leaves in the order of that
bound, until it falls below the k-th score, which rises on the way. Shards are searched in waves: one of sixteen, then four times as many, then the others; the k-th
scores that a wave gives travel with the queries to the next, so that each shard prunes with what is already known. A k-th
score is a lower bound of the true one, so no result is lost; nodes whose bound equals it are searched, for ties.

Components become floor(64 x). Scores are exact (in doubles while they stay below 2^53, in 64-bit integers
beyond). Rows repeating a vec_id are candidates one by one, but a query's own vec_id is none of its
candidates, and repeated query rows count once. Vectors that are null, empty, or hold null or non-finite
components take no part; vectors of different lengths do not meet. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAF = 256
SHARD_ROWS, BLOCK_ROWS, FIRST = 16384, 2048, 16


class Ball:
    """A node: its rows (sorted by vec_id in leaves), centre and radius."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, exact: np.dtype) -> None:
        part = x[rows].astype(np.float64)
        self.centre = part.mean(axis=0)
        far = ((part - self.centre) ** 2).sum(axis=1)
        self.radius = math.sqrt(float(far.max()))
        self.children: list[Ball] = []
        self.number = int(rows[0])  # of a leaf: no other has this row
        if len(rows) > LEAF and self.radius > 0:
            a = part[far.argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            order = np.argsort(part @ (b - a), kind="stable")
            half = len(rows) // 2
            self.children = [Ball(x, ids, rows[order[:half]], exact), Ball(x, ids, rows[order[half:]], exact)]
        else:
            self.ids, self.x = ids[rows], x[rows].astype(exact)


class Search:
    """Top k of a block of queries; ``floor`` is each query's known k-th score."""

    def __init__(self, q: np.ndarray, qid: np.ndarray, floor: np.ndarray, k: int, exact: np.dtype) -> None:
        self.q, self.qid, self.k = q.astype(exact), qid, k
        self.wide = q.astype(np.float64)
        self.norm = np.sqrt((self.wide**2).sum(axis=1))
        self.floor = floor.astype(np.float64).copy()
        self.score = np.full((len(q), k), -np.inf if exact == np.float64 else np.iinfo(np.int64).min, exact)
        self.id = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
        self.full = np.zeros(len(q), np.int64)
        self.scored = 0  # pairs, for tests

    def bound(self, ball: Ball, rows: np.ndarray) -> np.ndarray:
        top = self.wide[rows] @ ball.centre + self.norm[rows] * ball.radius
        return top + 1e-9 * (1 + np.abs(top))

    def visit(self, root: Ball) -> None:
        first = self.descend(root)
        found: list[tuple[Ball, np.ndarray, np.ndarray]] = []  # leaves, with the rows that reach them and their bounds
        open_ = [(root, np.arange(len(self.q)))]
        while open_:
            ball, rows = open_.pop()
            bound = self.bound(ball, rows)
            some = bound >= self.floor[rows]
            rows, bound = rows[some], bound[some]
            if len(rows) and ball.children:
                open_ += [(child, rows) for child in ball.children]
            elif len(rows):
                new = first[rows] != ball.number
                found.append((ball, rows[new], bound[new]))
        if not found:
            return
        leaf = np.repeat(np.arange(len(found)), [len(r) for _, r, _ in found])
        rows, bound = np.concatenate([r for _, r, _ in found]), np.concatenate([b for _, _, b in found])
        order = np.lexsort((-bound, rows))
        leaf, rows, bound = leaf[order], rows[order], bound[order]
        head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        turn = np.arange(len(rows)) - np.repeat(head, np.diff(np.r_[head, len(rows)]))
        order = np.lexsort((rows, leaf, turn))  # every query's best leaf, then its second, and so on
        leaf, rows, bound, turn = leaf[order], rows[order], bound[order], turn[order]
        cut = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (turn[1:] != turn[:-1])])
        for a, b in zip(cut, np.r_[cut[1:], len(rows)]):
            mine = rows[a:b][bound[a:b] >= self.floor[rows[a:b]]]
            if len(mine):
                self.take(found[leaf[a]][0], mine)

    def descend(self, root: Ball) -> np.ndarray:
        """Scores each query's leaf at the end of the way down by the higher bound; the leaf's number, by query."""
        first = np.full(len(self.q), -1, np.int64)
        open_ = [(root, np.arange(len(self.q)))]
        while open_:
            ball, rows = open_.pop()
            rows = rows[self.bound(ball, rows) >= self.floor[rows]]
            if not len(rows):
                continue
            if not ball.children:
                first[rows] = ball.number
                self.take(ball, rows)
                continue
            left, right = ball.children
            go = self.bound(left, rows) >= self.bound(right, rows)
            open_ += [(left, rows[go]), (right, rows[~go])]
        return first

    def take(self, ball: Ball, rows: np.ndarray) -> None:
        """Merges a leaf into the best k of some queries."""
        self.scored += len(rows) * len(ball.ids)
        got = self.q[rows] @ ball.x.T
        good = (got >= self.floor[rows][:, None]) & (ball.ids[None, :] != self.qid[rows][:, None])
        for i in np.flatnonzero(good.any(axis=1)):
            r, hit = rows[i], np.flatnonzero(good[i])
            s = np.concatenate([self.score[r, : self.full[r]], got[i, hit]])
            d = np.concatenate([self.id[r, : self.full[r]], ball.ids[hit]])
            best = np.lexsort((d, -s))[: self.k]
            self.full[r] = n = len(best)
            self.score[r, :n], self.id[r, :n] = s[best], d[best]
            if n == self.k:
                self.floor[r] = max(self.floor[r], float(s[best[-1]]))


OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Shard:
    """A ball tree over a shard's rows, which many blocks of queries pass."""

    def __init__(self, x: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.x, self.ids = x[order], ids[order]
        self.most = float(np.abs(x.astype(np.float64)).max(initial=0))
        self.trees: dict[np.dtype, Ball] = {}

    def search(self, q: np.ndarray, qid: np.ndarray, floor: np.ndarray, k: int) -> pa.RecordBatch:
        """(query_id, vec_id, score) of the block's best k in the shard; in doubles where they are exact."""
        top = self.most * float(np.abs(q.astype(np.float64)).max(initial=0)) * q.shape[1]
        exact = np.dtype(np.float64 if top < 2**52 else np.int64)
        if exact not in self.trees:
            self.trees[exact] = Ball(self.x, self.ids, np.arange(len(self.ids)), exact)
        s = Search(q, qid, floor, k, exact)
        s.visit(self.trees[exact])
        keep = np.arange(k)[None, :] < s.full[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(s.qid, s.full)), pa.array(s.id[keep]), pa.array(s.score[keep].astype(np.int64))], schema=OUT)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    col = common.column(batch, "v")
    return col.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def searched(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """rows: dim, shard, id, v; asked: the same and floor. Sorted by shard, rows before queries; one shard is open at a time."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None
        for batch in batches:
            keys = np.stack([common.column(batch, c).to_numpy().astype(np.int64) for c in ("dim", "shard", "ask")])
            cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                part, (dim, shard, ask) = batch.slice(a, b - a), keys[:, a].tolist()
                if at != (dim, shard):
                    at, held, tree = (dim, shard), [], None
                if not ask:
                    held.append((_matrix(part), common.column(part, "id").to_numpy()))
                    continue
                if tree is None and held:
                    tree, held = Shard(np.concatenate([x for x, _ in held]), np.concatenate([i for _, i in held])), []
                if tree is None:
                    continue
                for c in range(0, part.num_rows, BLOCK_ROWS):
                    block = part.slice(c, BLOCK_ROWS)
                    floor = common.column(block, "floor").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    yield tree.search(_matrix(block), common.column(block, "id").to_numpy(), floor, k)

    none = F.lit(None).cast("bigint").alias("floor")
    both = rows.select("dim", "shard", F.lit(0).alias("ask"), "id", "v", none).unionByName(asked.select("dim", "shard", F.lit(1).alias("ask"), "id", "v", "floor"))
    return both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "ask").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: each query's k largest integer inner products."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    valid = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, finite)
    coded = F.transform(embedding, lambda x: F.floor(x.cast("double") * 64).cast("bigint"))
    pick = lambda df: df.filter(valid).select(F.col(vec_id).cast("bigint").alias("id"), coded.alias("v")).withColumn("dim", F.size("v"))
    rows = common.materialize(pick(vectors), "topk-rows")
    asked = common.materialize(pick(queries).dropDuplicates(["id", "v"]), "topk-queries")
    n = rows.count()
    shards = max(1, -(-n // SHARD_ROWS))
    if 1 < n <= SHARD_ROWS * 4:
        shards = max(shards, min(8, -(-n // 2048)))  # smaller shards while there are few
    first = -(-shards // FIRST)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def to(low: int, high: int) -> Column:
        return F.explode(F.sequence(F.lit(low), F.lit(high)).cast("array<int>")).alias("shard") if high >= low else F.explode(F.array().cast("array<int>")).alias("shard")

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for low, high in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))(sorted({0, min(first, shards), min(5 * first, shards), shards}))):
        floor = asked.select("id").limit(0).withColumn("floor", F.lit(0).cast("bigint")) if found is None else found.withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        wave = asked.join(floor, "id", "left").select("dim", to(low, high - 1), "id", "v", "floor")
        got = searched(rows.filter(F.col("shard").between(low, high - 1)), wave, k)
        if high < shards:
            got = common.materialize(got, "topk-wave")
        found = got if found is None else found.union(got)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(e, e.filter(F.col("vec_id") % 20 == 0), 20)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
