"""Closures of relations between entities: what each leads to, in how many steps, which cycles there are, and levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examlark.sources.config import stored, work_folder


#: Rows of a join of ways, for each known pair and each that a single edge would add, up to which ways are joined with ways.
WIDE = 8


def closure(edges: DataFrame, source: str = "source", target: str = "target", most: int | None = None) -> DataFrame:
    """(source, target, distance): all pairs with a path, by its least number of edges; an entity on a cycle reaches itself.

    With all pairs of up to n edges known, a pair of n + j has an entity n edges from its source, and j from its target: pairs of
    exactly n edges, joined with those of up to n, give all of up to 2n. So steps are the logarithm of the longest distance. Where
    many ways lead to the same pairs, and that join has many more rows than there are pairs, a step goes along one edge. It ends
    when no way leads on (or after ``most`` edges). Null ends lead nowhere. The result has a row for each pair, which is the caller's
    to bound; steps are written as Parquet, and all that are known are one table, so that no plan grows with them."""
    spark = edges.sparkSession
    folder, paths, n = work_folder(spark, "closure"), [], 1
    new = edges.select(F.col(source).alias("source"), F.col(target).alias("target")).dropna().distinct().withColumn("distance", F.lit(1))
    kind = new.schema
    while True:
        new.select(*kind.names).write.parquet(path := f"{folder}/{len(paths)}")
        paths.append(path)
        known = spark.read.schema(kind).parquet(*paths)
        step = n if most is None else min(n, most - n)
        if step <= 0:
            return known
        last = spark.read.schema(kind).parquet(path).filter(F.col("distance") == n).select("source", F.col("target").alias("node"))
        near = lambda k: F.count_if(F.col("distance") <= k).cast("double")
        starts = known.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("all"), near(1).alias("one"), near(step).alias("more"))
        ends = last.groupBy("node").agg(F.count(F.lit(1)).alias("ways"))
        all_, one, more = starts.join(ends, "node", "left").agg(F.sum("all"), F.sum(F.col("one") * F.col("ways")), F.sum(F.col("more") * F.col("ways"))).first()
        if not one:
            return known
        if more > WIDE * (all_ + one):
            step = 1
        on = known.filter(F.col("distance") <= step).select(F.col("source").alias("node"), "target", F.col("distance") + n)
        found = last.join(on.toDF("node", "target", "distance"), "node").groupBy("source", "target").agg(F.min("distance").alias("distance"))
        new = found.join(known.select("source", "target"), ["source", "target"], "left_anti")
        n += step


def cycles(reach: DataFrame) -> DataFrame:
    """(node, length, cycle): of a closure, the entities on cycles, the length of their shortest one, and the cycle's name: the
    smallest entity that leads to it and is led to by it."""
    own = reach.filter("source = target").select(F.col("source").alias("node"), F.col("distance").alias("length"))
    back = reach.select(F.col("target").alias("source"), F.col("source").alias("target"))
    both = reach.select("source", "target").join(back, ["source", "target"]).groupBy(F.col("source").alias("node")).agg(F.min("target").alias("cycle"))
    return own.join(both, "node")


#: Edges that one task takes at once; what is left of a larger graph is taken apart until no more are left.
ALONE = 1_000_000


def rings(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, cycle) of the entities on cycles, as ``cycles`` of a closure has them, without the closure: strongly connected
    components, by colours as long as there are many edges, the rest in one task.

    Entities that nothing leads to, or that lead nowhere, are on no cycle and go, as long as that takes many away. Then each takes the
    largest entity that leads to it as its colour, in the next round the smallest, and so on; what leads back to that one inside a
    colour is a cycle, and the rest goes on inside colours, which no cycle leaves. Rows are edges, never pairs."""
    e = _pairs(edges, source, target)
    loops = e.filter("source = target").select(F.col("source").alias("node"), F.col("source").alias("cycle"))
    found, e, largest = [], e.filter("source <> target"), True
    while True:
        e, n = _core(e)
        if n <= ALONE:
            break
        colour = _spread(e, e.select(F.col("source").alias("node")).union(e.select("target")).distinct().withColumn("colour", F.col("node")), largest)
        of = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"_{end}"))
        e = stored(e.join(of("source"), "source").join(of("target"), "target").filter("_source = _target").select("source", "target", F.col("_source").alias("colour")), "relations")
        back = _reached(e, "target", "source")
        found.append(back.groupBy("colour").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("cycle")).filter("n > 1").join(back, "colour").select("node", "cycle"))
        gone = back.select("node")
        e = e.select("source", "target").join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti")
        largest = not largest
    if n:
        found.append(_alone(e, _rings, "ring").select("node", F.min("node").over(Window.partitionBy("ring")).alias("cycle")))
    if not found:
        return loops
    found = stored(reduce(DataFrame.unionByName, found), "relations")
    return found.unionByName(loops.join(found, "node", "left_anti"))


def _pairs(edges: DataFrame, source: str, target: str) -> DataFrame:
    return stored(edges.select(F.col(source).alias("source"), F.col(target).alias("target")).dropna().distinct(), "relations")


def _core(e: DataFrame) -> tuple[DataFrame, int]:
    """Edges between entities that are led to and lead on, and their number; given up when a step takes less than an eighth away,
    or when one task takes the rest."""
    e = stored(e, "relations")
    n = e.count()
    while n > ALONE:
        inner = e.select(F.col("source").alias("node")).intersect(e.select(F.col("target").alias("node")))
        e = stored(e.join(inner.withColumnRenamed("node", "source"), "source", "left_semi").join(inner.withColumnRenamed("node", "target"), "target", "left_semi"), "relations")
        before, n = n, e.count()
        if n * 8 > before * 7:
            break
    return e, n


def _alone(e: DataFrame, of: Callable[[list[int], list[int]], list[int | None]], name: str) -> DataFrame:
    """(node, name) of all ends of at most ALONE edges, in one task: ``of`` has the place in the second list where each entity's
    targets begin, and the targets, and says a number of each entity or none. Entities are of any type that Arrow encodes."""
    kind = e.select("source").union(e.select("target")).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = list(batches)
        if not sum(b.num_rows for b in read):
            return
        ends = pa.chunked_array([b.column(i) for i in (0, 1) for b in read]).combine_chunks().dictionary_encode()
        codes, nodes = ends.indices.to_numpy(), len(ends.dictionary)
        sources, targets = np.split(codes, 2)
        order = np.argsort(sources, kind="stable")
        start = np.searchsorted(sources[order], np.arange(nodes + 1)).tolist()
        said = pa.array(of(start, targets[order].tolist()), pa.int32())
        yield from pa.Table.from_arrays([ends.dictionary, said], names=["node", name]).to_batches(max_chunksize=10_000)

    return e.select(F.col("source").cast(kind), F.col("target").cast(kind)).repartition(1).mapInArrow(run, T.StructType([T.StructField("node", kind), T.StructField(name, T.IntegerType())])).filter(F.col(name).isNotNull())


def _rings(start: list[int], after: list[int]) -> list[int | None]:
    """A member of each entity's strongly connected component, if that has others (Tarjan, without recursion)."""
    nodes = len(start) - 1
    at, seen, low, ring = start[:-1], [0] * nodes, [0] * nodes, [None] * nodes
    open_, on, clock = [], [False] * nodes, 0
    for root in range(nodes):
        way = [] if seen[root] else [root]
        while way:
            x = way[-1]
            if not seen[x]:
                clock += 1
                seen[x] = low[x] = clock
                open_.append(x)
                on[x] = True
            while at[x] < start[x + 1]:
                y = after[at[x]]
                at[x] += 1
                if not seen[y]:
                    way.append(y)
                    break
                if on[y] and seen[y] < low[x]:
                    low[x] = seen[y]
            else:
                way.pop()
                if way and low[x] < low[way[-1]]:
                    low[way[-1]] = low[x]
                if low[x] == seen[x]:
                    single = open_[-1] == x
                    while True:
                        y = open_.pop()
                        on[y] = False
                        if not single:
                            ring[y] = x
                        if y == x:
                            break
    return ring


def _levels(start: list[int], after: list[int]) -> list[int | None]:
    """The number of edges of the longest path to each entity, as ``levels`` has it."""
    nodes = len(start) - 1
    left, level = [0] * nodes, [None] * nodes
    for y in after:
        left[y] += 1
    now, n = [x for x in range(nodes) if not left[x]], 0
    while now:
        next_ = []
        for x in now:
            level[x] = n
            for y in after[start[x] : start[x + 1]]:
                left[y] -= 1
                if not left[y]:
                    next_.append(y)
        now, n = next_, n + 1
    return level


#: Edges that a step of a search goes along before it is written.
HOPS = 4


def _spread(e: DataFrame, colour: DataFrame, largest: bool) -> DataFrame:
    """(node, colour): the largest colour of an entity and all that lead to it, or the smallest; a step follows those alone that changed."""
    most, better = (F.max, F.col("_to") > F.col("colour")) if largest else (F.min, F.col("_to") < F.col("colour"))
    colour = stored(colour, "relations")
    new = colour
    while True:
        far, reach = new, []
        for _ in range(HOPS):
            far = e.join(far.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(most("colour").alias("colour"))
            reach.append(far)
        step = reduce(DataFrame.unionByName, reach).groupBy("node").agg(most("colour").alias("_to"))
        better_ = F.coalesce(better, F.lit(False))
        both = stored(colour.join(step, "node", "left").select("node", F.when(better_, F.col("_to")).otherwise(F.col("colour")).alias("colour"), better_.alias("_new")), "relations")
        colour, new = both.select("node", "colour"), both.filter("_new").select("node", "colour")
        if new.isEmpty():
            return colour


def _reached(e: DataFrame, start: str, end: str) -> DataFrame:
    """(node, colour): what the edges of a colour lead to from the entity that gives it its name, itself included."""
    hop = e.select(F.col(start).alias("node"), F.col(end).alias("next"), "colour")
    new = stored(e.select("colour").distinct().select(F.col("colour").alias("node"), "colour"), "relations")
    got = new
    while True:
        far, reach = new, []
        for _ in range(HOPS):
            far = hop.join(far, ["node", "colour"]).select(F.col("next").alias("node"), "colour").distinct()
            reach.append(far)
        new = stored(reduce(DataFrame.unionByName, reach).distinct().join(got, ["node", "colour"], "left_anti"), "relations")
        if new.isEmpty():
            return got
        got = stored(got.unionByName(new), "relations")


#: Entities of a step that are sent to all tasks.
FEW = 10_000


def levels(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, level): the number of edges of the longest path that leads to an entity; null on a cycle, and behind one.

    Entities that nothing leads to are level 0; each step takes those away whose last predecessor has gone. When one task
    takes the edges that are left, it takes all further steps."""
    return _leveled(_pairs(edges, source, target))


def _leveled(e: DataFrame) -> DataFrame:
    ends = e.select(F.col("source").alias("node"), F.lit(0).alias("n")).union(e.select("target", F.lit(1)))
    state = stored(ends.groupBy("node").agg(F.sum("n").alias("open")).withColumn("level", F.when(F.col("open") == 0, 0)), "relations")
    n = 0
    while True:
        now, left = state.agg(F.count_if(F.col("level") == n), F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("open"))), F.lit(0))).first()
        if not now or not left:
            return state.select("node", "level")
        if left <= ALONE:
            rest = e.join(state.filter("level IS NULL").select(F.col("node").alias("target")), "target", "left_semi")
            rest = rest.join(state.filter(F.col("level").isNull() | (F.col("level") == n)).select(F.col("node").alias("source")), "source", "left_semi")
            more = _alone(rest.select("source", "target"), _levels, "more")
            return stored(state.join(more, "node", "left").select("node", F.coalesce("level", F.col("more") + n).alias("level")), "relations")
        gone = state.filter(F.col("level") == n).select(F.col("node").alias("source"))
        gone = e.join(F.broadcast(gone) if now <= FEW else gone, "source").groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("gone"))
        open_ = F.col("open") - F.coalesce("gone", F.lit(0))
        state = state.join(gone, "node", "left").select("node", open_.alias("open"), F.when(F.col("level").isNull() & (open_ == 0), n + 1).otherwise(F.col("level")).alias("level"))
        state, n = stored(state, "relations"), n + 1


def levels_and_rings(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, level, cycle): ``levels`` and ``rings`` of the same edges; cycles are looked for where no level was found alone."""
    e = _pairs(edges, source, target)
    level = _leveled(e)
    behind = level.filter("level IS NULL").select(F.col("node").alias("source"))
    return level.join(rings(e.join(behind, "source", "left_semi")), "node", "left")
