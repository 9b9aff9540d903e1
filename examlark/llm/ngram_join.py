"""Operator 5: n-gram Jaccard join with PartEnum signatures.

Sets are put into bands of size; an instance of the scheme serves a band and those sets of the band below
that can match into it. With k the largest Hamming distance of two linked sets of an instance, the feature
domain is dealt into n1 = k // 2 + 1 + m partitions (first level), each of them into three cells (second level), and
the subsets of two of the three cells are enumerated: 3 n1 subsets. Linked sets differ in at most k features, so at
most k // 2 partitions hold two or more of these; in each of the other m + 1 or more, at most one cell differs, and
the subset of the two others has equal content in both sets. A set signs all subsets but the m of fewest features
(ties by content, then by place). Of the subsets that agree, the one that comes last in this order has m others that
agree below it, in either set, so that neither leaves it out: linked sets always share a signature, while empty and
nearly empty subsets, which many sets share, sign for hardly any set. In an instance with k = 0 only equal sets are linked,
and the whole set signs. Signatures only propose pairs; every link is verified on the whole sets.

Before that, a parity sketch of 512 or 1024 bits of each set bounds the Hamming distance of a pair from below (every
differing bit needs a differing shingle), so that pairs that are similar, but not enough, are dropped. Sketches
travel only for sets that share a signature with another one.

Equal sets become one vertex first. In a bucket of sets with one signature no pairs are enumerated: every
set meets the bucket's smallest id (its best such pivot first), and only sets of a bucket that are still in
different components after that meet each other. The result is each document's component.

Cases: null, empty and wordless texts have no shingles and are linked with nothing; with fewer words than a
shingle the whole sequence is one; rows that repeat a doc_id are one document, which is linked with whatever
any of its texts is linked with; a null doc_id has a null component; equal texts are linked, whatever their number.
Only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

RATIO = 1.3
SKETCH = 16  # words of 64 bits
#: Sets of at most so many shingles carry a sketch of 512 bits, which is the wide one folded.
NARROW = 600
#: Sets with their sketches that are broadcast, at most (150 bytes each).
FACTS = 100_000
_INST = np.uint64(0xA24BAED4963EE407)


def shingles(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted, text after text; how many each text has)."""
    data, offsets = common.utf8(col)
    starts, ends, first = common.word_spans(data, offsets)
    words = common.word_hashes(data, starts, ends, True)
    pos, text = common.inside_one_text(first, n, len(words))
    grams = common.gram_hashes(words, n)[pos] if len(pos) else np.zeros(0, np.uint64)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.array([common.gram_hashes(words[first[i] : first[i + 1]], int(count[i]))[0] for i in short], np.uint64)
        grams = np.concatenate([grams, common.mix(whole + count[short].astype(np.uint64))])
        text = np.concatenate([text, short])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    if len(grams):
        new = np.r_[True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])]
        grams, text = grams[new], text[new]
    return grams, np.bincount(text, minlength=len(count))


def bands(num: int, den: int, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest size of each band, and of its instance k and m."""
    ratio = max(RATIO, den / num * 1.001)
    low = [1]
    while low[-1] < most:
        low.append(int(low[-1] * ratio) + 1)
    low_ = np.array(low, np.int64)
    k = (2 * (low_[1:] - 1) * (den - num)) // (den + num)
    return low_, k, np.maximum(1, -(-(k // 2 + 1) // 8))


def signatures(grams: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, text after text; how many each text has)."""
    low, k, spare = bands(num, den)
    band = np.searchsorted(low, counts, side="right") - 1
    some = np.flatnonzero(counts > 0)
    up = some[counts[some] * den >= low[band[some] + 1] * num]
    text = np.concatenate([some, up])
    inst = np.concatenate([band[some], band[up] + 1])
    whole = k[inst] == 0
    equal_text, equal_inst = text[whole], inst[whole]
    text, inst = text[~whole], inst[~whole]
    order = np.lexsort((inst, text))
    text, inst = text[order], inst[order]
    sums = np.zeros(len(counts), np.uint64)
    if len(equal_text):
        sums[some] = np.add.reduceat(common.mix(grams ^ _INST), (np.cumsum(counts) - counts)[some])
    equal = common.mix(sums[equal_text] + common.mix(equal_inst.astype(np.uint64) * _INST))
    if not len(text):
        by = np.argsort(equal_text, kind="stable")
        return equal[by], np.bincount(equal_text, minlength=len(counts))
    at, size = (np.cumsum(counts) - counts)[text], counts[text]
    entry = np.repeat(np.arange(len(text)), size)
    e = grams[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    first_level = k[inst] // 2 + 1 + spare[inst]
    cells = 3 * first_level
    base = np.cumsum(cells) - cells
    place = base[entry] + (((e >> np.uint64(32)) * cells.astype(np.uint64)[entry]) >> np.uint64(32)).astype(np.int64)  # grows with e: already in order
    head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    total = int(cells.sum())
    content, held = np.zeros(total, np.uint64), np.zeros(total, np.int64)
    content[place[head]] = np.add.reduceat(common.mix(e ^ _INST), head)
    held[place[head]] = np.diff(np.r_[head, len(e)])
    content, held = content.reshape(-1, 3), held.reshape(-1, 3)
    owner = np.repeat(np.arange(len(text)), first_level)
    group = np.arange(len(owner)) - np.repeat(np.cumsum(first_level) - first_level, first_level)
    tag = common.mix(inst[owner].astype(np.uint64) * _INST + group.astype(np.uint64))
    two = np.stack([common.mix(content[:, i] * np.uint64(0x9E3779B97F4A7C15) + common.mix(content[:, j] + np.uint64(j)) + tag + np.uint64(3 * i + j)) for i, j in ((0, 1), (0, 2), (1, 2))], axis=1).ravel()
    full = np.stack([held[:, i] + held[:, j] for i, j in ((0, 1), (0, 2), (1, 2))], axis=1).ravel()
    owner = np.repeat(owner, 3)
    rank = (owner.astype(np.uint64) << np.uint64(44)) | (np.minimum(full, 255).astype(np.uint64) << np.uint64(36)) | (two >> np.uint64(28))
    order = np.argsort(rank, kind="stable") if len(text) < 1 << 20 else np.lexsort((two >> np.uint64(28), np.minimum(full, 255), owner))
    left_out = (np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)) < np.repeat(spare[inst], cells)
    keep = np.ones(len(owner), bool)
    keep[order[left_out]] = False
    found, of = np.concatenate([two[keep], equal]), np.concatenate([text[owner[keep]], equal_text])
    by = np.argsort(of, kind="stable")
    return found[by], np.bincount(of, minlength=len(counts))


def _sizes(a: Column, b: Column, num: int, den: int) -> Column:
    return (F.least(a, b) * den >= F.greatest(a, b) * num)


class Join:
    """The steps over one input; each table that is used twice is written to the shared folder."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int) -> None:
        self.docs, self.n, self.num, self.den = docs, n, num, den  # columns id and text

    def meta(self) -> DataFrame:
        size = self.n

        def fn(col: pa.Array) -> dict[str, pa.Array]:
            g, c = shingles(col, size)
            at, has = (np.cumsum(c) - c)[c > 0], c > 0
            out = {"n": pa.array(c.astype(np.int64))}
            for name, salt in (("h1", 0x1B873593), ("h2", 0x85EBCA6B2)):
                h = np.zeros(len(c), np.uint64)
                if len(at):
                    h[has] = np.add.reduceat(common.mix(g ^ np.uint64(salt)), at)
                out[name] = pa.array(h.view(np.int64))
            bit = np.repeat(np.arange(len(c)), c) * (64 * SKETCH) + (g >> np.uint64(64 - 10)).astype(np.int64)
            odd = (np.bincount(bit, minlength=len(c) * 64 * SKETCH) & 1).astype(np.uint8)
            words = np.packbits(odd.reshape(len(c), -1), axis=1).view(np.int64)
            narrow = c <= NARROW
            words[narrow, : SKETCH // 2] ^= words[narrow, SKETCH // 2 :]
            words[narrow, SKETCH // 2 :] = 0
            return out | {f"k{i}": pa.array(np.ascontiguousarray(words[:, i])) for i in range(SKETCH)}

        return common.map_appending(self.docs, ["id"], "text", "n bigint, h1 bigint, h2 bigint, " + ", ".join(f"k{i} bigint" for i in range(SKETCH)), fn)

    def signed(self, ids: DataFrame) -> DataFrame:
        size, num, den = self.n, self.num, self.den

        def fn(col: pa.Array) -> dict[str, pa.Array]:
            g, c = shingles(col, size)
            s, k = signatures(g, c, num, den)
            return {"sigs": common.lists(s.view(np.int64), k, pa.int64())}

        some = common.keep_ids(self.docs, ids, "id")
        return common.map_appending(some, ["id"], "text", "sigs array<bigint>", fn).select("id", F.explode("sigs").alias("sig"))

    def sets(self, ids: DataFrame) -> DataFrame:
        size = self.n

        def fn(col: pa.Array) -> dict[str, pa.Array]:
            g, c = shingles(col, size)
            return {"s": common.lists(g.view(np.int64), c, pa.int64())}

        return common.map_appending(common.keep_ids(self.docs, ids, "id"), ["id"], "text", "s array<bigint>", fn)

    def verified(self, pairs: DataFrame) -> DataFrame | None:
        """The pairs (a, b) that are linked, by their whole sets; None if there are none."""
        pairs = common.materialize(pairs, "pairs")
        n = pairs.count()
        if not n:
            return None
        ids = common.materialize(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
        sets = self.sets(ids)
        few = F.broadcast(pairs) if n <= common.BROADCAST_PAIRS else pairs  # else the sets are shuffled for either end
        left = sets.select(F.col("id").alias("a"), F.col("s").alias("x")).join(few, "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
        common_ = F.size(F.array_intersect("x", "y")).cast("bigint")
        linked = both.select("a", "b", common_.alias("i"), (F.size("x") + F.size("y")).alias("t"))
        linked = common.materialize(linked.filter(F.col("i") * self.den >= (F.col("t") - F.col("i")) * self.num).select("a", "b").distinct(), "links")
        return None if linked.isEmpty() else linked

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(id, n, vertex of each row; id, component of vertices that have a link)."""
        c = F.col
        meta = common.materialize(self.meta(), "meta")
        vertices = common.materialize(meta.filter("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("id").alias("vertex")), "vertices")
        rows = common.materialize(meta.join(vertices, ["h1", "h2", "n"], "left").select("id", "n", F.coalesce("vertex", "id").alias("vertex")), "rows")
        links: list[DataFrame] = []
        several = rows.filter("id IS NOT NULL").groupBy("id").agg(F.min("vertex").alias("b"), F.max("vertex").alias("z")).filter("b <> z")
        several = common.materialize(several.select("id", "b"), "repeated-ids")
        if not several.isEmpty():  # an id of several texts holds their vertices together
            links.append(common.materialize(rows.join(several, "id").select(c("vertex").alias("a"), "b").filter("a <> b").distinct(), "links"))

        s = self.signed(vertices.select(c("vertex").alias("id")).distinct()).repartition("sig")
        full = s.groupBy("sig").agg(F.min("id").alias("pivot"), F.max("id").alias("q")).filter("pivot <> q").drop("q")
        multi = common.materialize(s.join(full.hint("shuffle_hash"), "sig").select("sig", "id", "pivot"), "buckets")
        ids = common.materialize(multi.select("id").distinct(), "bucket-ids")
        facts = common.materialize(common.keep_ids(meta.filter("n > 0"), ids, "id").drop("h1", "h2"), "facts")
        hint = F.broadcast if facts.count() <= FACTS else (lambda x: x)  # counted

        fits = lambda a, b: _sizes(c(a), c(b), self.num, self.den)
        sketch = lambda key, n, x: hint(facts.select(c("id").alias(key), c("n").alias(n), *[c(f"k{i}").alias(f"{x}{i}") for i in range(SKETCH)]))

        def near(a: str, b: str, na: str, nb: str) -> Column:
            """Not more differing bits than a linked pair of these sizes can have differing shingles."""
            x, y = ([c(f"{v}{i}") for i in range(SKETCH)] for v in (a, b))
            fold = lambda v, i: v[i].bitwiseXOR(v[i + SKETCH // 2])
            wide = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(SKETCH)), F.lit(0))
            folded = sum((F.bit_count(fold(x, i).bitwiseXOR(fold(y, i))) for i in range(SKETCH // 2)), F.lit(0))
            bits = F.when(F.least(na, nb) > NARROW, wide).otherwise(folded)
            return bits * (self.den + self.num) <= (c(na) + c(nb)) * (self.den - self.num)

        stars = multi.filter("id <> pivot").groupBy("id", "pivot").count()
        stars = stars.join(sketch("id", "n", "x"), "id").join(sketch("pivot", "pn", "y"), "pivot").filter(fits("n", "pn") & near("x", "y", "n", "pn"))
        stars = common.materialize(stars.select("id", "pivot", "count").dropDuplicates(["id", "pivot"]), "stars")
        best = stars.groupBy("id").agg(F.max(F.struct("count", F.negative("pivot").alias("p"))).alias("m")).select(c("id").alias("a"), F.negative(c("m.p")).alias("b"))

        def extended(found: DataFrame | None, more: DataFrame | None) -> DataFrame | None:
            if more is not None:
                links.append(more)
            elif found is not None or not links:
                return found
            return common.materialize(graph.components(reduce(DataFrame.union, links), "a", "b"), "components")

        none = self.docs.sparkSession.createDataFrame([], "id bigint, component bigint")
        found = extended(None, self.verified(best)) or none

        def of(df: DataFrame, key: str, name: str) -> DataFrame:
            return df.join(found.select(c("id").alias(key), c("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))

        rest = of(of(stars.select(c("id").alias("a"), c("pivot").alias("b")), "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
        rest = rest.join(best, ["a", "b"], "left_anti")
        found = extended(found, self.verified(rest))

        left = of(multi, "id", "c")
        split = left.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("sig")
        left = common.materialize(left.join(split, "sig", "left_semi").filter("id <> pivot").select("sig", "id", "c"), "open")
        x = left.join(sketch("id", "na", "x"), "id").select("sig", c("id").alias("a"), "na", c("c").alias("ca"), *[f"x{i}" for i in range(SKETCH)])
        y = left.join(sketch("id", "nb", "y"), "id").select("sig", c("id").alias("b"), "nb", c("c").alias("cb"), *[f"y{i}" for i in range(SKETCH)])
        apart = (c("a") < c("b")) & (c("ca") != c("cb")) & fits("na", "nb") & near("x", "y", "na", "nb")
        cross = x.join(y, (x["sig"] == y["sig"]) & apart).select("a", "b").distinct()
        return rows, extended(found, self.verified(cross))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of each row; linked at den * intersection >= num * union."""
    rows, found = Join(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")), words, num, den).run()
    out = rows.join(found.withColumnRenamed("id", "vertex"), "vertex", "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "vertex").alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=4, num=85)
