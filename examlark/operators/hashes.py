"""All pairs of 64-bit hashes within a Hamming radius, by multi-index hashing.

If two hashes differ in at most r bits, then of r + 1 bands of bits at least one is equal in both (the pigeonhole
principle). Equal hashes are collapsed first, then hashes meet by band. A band's value that many hashes have is cut
further: what is left of the bits is cut into r + 1 bands again, one of which has to be equal, too; up to ``STEPS`` times.
What many hashes share even then is a dense cluster, most of whose pairs are near: it is compared in blocks, in many tasks. No pair is lost, and a pair comes
from one key alone: that of the first equal band at every step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlark.functions.scalars import hamming
from examlark.operators.matching import PROBE_ROWS
from examlark.sources.config import cut

BITS = 64
#: Hashes of a key before its bits are cut further.
MOST = 1024
#: Times that bits are cut, and blocks of what is still large then.
STEPS, BLOCKS = 3, 16


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bands(fixed: int, radius: int) -> list[int]:
    """The bits outside ``fixed`` in radius + 1 masks of like size; none if there are fewer bits than that."""
    free = [i for i in range(BITS) if not fixed >> i & 1]
    n = radius + 1
    return [sum(1 << i for i in free[len(free) * j // n : len(free) * (j + 1) // n]) for j in range(n)] if len(free) >= n else []


def groups(df: DataFrame, key: str, value: str) -> DataFrame:
    """(hash, first, copies): distinct hashes with their smallest key."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("hash")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))


def near_pairs(hashes: DataFrame, radius: int, most: int = MOST) -> DataFrame:
    """(a, b, distance) of distinct hashes (column hash) with a < b that differ in 1 to ``radius`` bits."""
    paths: list[tuple[int, list[int]]] = [(0, [])]  # bits that a key fixes, and bands before each of its own that have to differ
    rows = hashes.select("hash", F.lit(0).alias("path"), F.lit(0).cast("bigint").alias("key"))
    found = []
    step = [0]
    while True:
        deeper = []
        for p in step:
            parts = bands(paths[p][0], radius)
            for j, m in enumerate(parts):
                paths.append((paths[p][0] | m, paths[p][1] + parts[:j]))
                deeper.append((p, len(paths) - 1, _signed(paths[p][0] | m)))
        table = hashes.sparkSession.createDataFrame(deeper, "path int, next int, mask bigint")
        rows = rows.join(F.broadcast(table), "path").select("hash", F.col("next").alias("path"), F.col("hash").bitwiseAND(F.col("mask")).alias("key"))  # radius + 1 rows for a path
        rows = cut(rows)
        step = [n for _, n, _ in deeper]
        open_ = [n for n in step if bands(paths[n][0], radius)]
        sizes = rows.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n"))
        hot = cut(sizes.filter((F.col("n") > most) & F.col("path").isin(open_)).select("path", "key"))
        few = F.broadcast(hot) if hot.count() <= PROBE_ROWS * 10 else hot
        cold = rows if hot.isEmpty() else rows.join(few, ["path", "key"], "left_anti")
        earlier = {n: [_signed(m) for m in paths[n][1]] for n in step}
        found.append(_met(cold, earlier, radius, 1))
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, found)
        rows = rows.join(few, ["path", "key"], "left_semi")
        if len(found) == STEPS:
            return reduce(DataFrame.unionByName, [*found, _met(rows, earlier, radius, BLOCKS)])
        hot_paths = {r["path"] for r in hot.select("path").distinct().collect()}  # a few masks
        step = [n for n in step if n in hot_paths]


def _met(rows: DataFrame, earlier: dict[int, list[int]], radius: int, blocks: int) -> DataFrame:
    """Near pairs of rows that share a key, if all earlier bands differ; a key's rows in blocks that each meet all of it."""
    first = min(earlier)
    masks = F.array(*[F.array(*map(F.lit, earlier[n])).cast("array<bigint>") for n in sorted(earlier)])  # paths of one step follow each other
    x = rows.select("path", "key", F.pmod(F.xxhash64("hash"), F.lit(blocks)).alias("block"), F.col("hash").alias("a"))
    y = rows.select("path", "key", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"), F.col("hash").alias("b"), F.element_at(masks, F.col("path") - (first - 1)).alias("earlier"))
    differ = F.forall("earlier", lambda m: F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(m) != 0)
    near = (F.col("a") < F.col("b")) & (hamming("a", "b") <= radius) & differ
    return x.join(y, ["path", "key", "block"]).filter(near).select("a", "b", hamming("a", "b").alias("distance"))


def similar(df: DataFrame, key: str, value: str, radius: int) -> DataFrame:
    """(source_id, target_id, distance): the smallest keys of each two classes of equal hashes that are near."""
    g = groups(df, key, value)
    g = cut(g)
    near = near_pairs(g.select("hash"), radius)
    a, b = g.select(F.col("hash").alias("a"), F.col("first").alias("i")), g.select(F.col("hash").alias("b"), F.col("first").alias("j"))
    return near.join(a, "a").join(b, "b").select(F.least("i", "j").alias("source_id"), F.greatest("i", "j").alias("target_id"), "distance")
