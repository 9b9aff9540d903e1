"""Top-k retrieval by BM25 over blocks of documents with their maxima.

The index has postings with their impacts (a document's whole BM25 weight of a term) and the document's block; and for
each block and term the largest impact. A query's bound on a block is the sum of the maxima of its terms. Blocks are
scored in waves, those with the highest bounds first; after each wave the k-th score so far cuts off all blocks whose
bound does not reach it. What is scored is query x block, never query x document, until a block has passed. In the blocks that
are left, terms whose maxima together fall short of the k-th score are looked up for those documents alone that can still reach it.

Blocks hold documents alike in impact, so that bounds are tight: documents are grouped by their strongest term and its
level; those of a frequent term are cut by hash into blocks, rare terms share blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlark.functions.scalars import normal_stem
from examlark.operators.matching import PROBE_ROWS, bm25, terms, top_k
from examlark.sources.config import stored

#: Documents of a block, and blocks that a query scores in each wave before the last, which takes all that are left.
BLOCK, WAVES = 8, (16,)
#: A term that every document has once: its rows are the table of document lengths. No text has it.
MARK = ""
#: Scores are rounded to six places; a bound has to fall short by more than that.
SLACK = 2e-6


#: Rows that are broadcast, at most.
FEW = PROBE_ROWS * 10


def build(docs: DataFrame, key: str, text: str, vocabulary: DataFrame | None = None, size: int = BLOCK, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """The index, (block, term, doc, w) and (block, term, w): each block's postings, and its largest weight of each term.

    Documents are read and cut into words once. vocabulary (term, distinct): other terms have no postings, which no query of that
    vocabulary can tell. How many documents a term leads is no more than it is in, so that its own frequency says into how many blocks they go."""
    ws = docs.select(F.col(key).alias("doc"), F.filter(F.split(normal_stem(text), " "), lambda w: w != "").alias("ws"))
    rows = ws.select("doc", F.size("ws").alias("dl"), F.explode(F.concat(F.coalesce("ws", F.array().cast("array<string>")), F.array(F.lit(MARK)))).alias("term"))
    few = vocabulary is not None and vocabulary.limit(PROBE_ROWS * 100 + 1).count() <= PROBE_ROWS * 100
    if vocabulary is not None:
        known = vocabulary.select("term").unionByName(docs.sparkSession.createDataFrame([(MARK,)], "term string"))
        rows = rows.join(F.broadcast(known) if few else known, "term", "left_semi")
    t = stored(rows.groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "frequencies")
    mark = F.col("term") == MARK
    n, total, told = t.filter(mark).agg(F.coalesce(F.sum("tf"), F.lit(0)), F.sum(F.col("tf") * F.col("dl")), F.sum(F.when(F.col("dl").isNotNull(), F.col("tf")))).first()
    df = t.filter(~mark).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = t.filter(~mark).join(F.broadcast(df) if few else df, "term")
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(total / told if told else 1.0)))
    # a document's own terms: no more than its text has
    found = w.select("doc", "term", "df", weight.alias("w")).groupBy("doc").agg(F.collect_list(F.struct("term", "w")).alias("weights"), F.max(F.struct("w", "term", "df")).alias("lead"))
    level, parts = F.floor(F.log2("lead.w") * 2), F.ceil(F.col("lead.df") / (2 * size))
    rare = F.xxhash64(F.lit("shared"), F.pmod(F.xxhash64("lead.term"), F.lit(max(1, -(-n // size)))))
    block = F.when(F.col("lead.df") < size, rare).otherwise(F.xxhash64("lead.term", level, F.pmod(F.xxhash64("doc"), parts)))
    index = stored(found.select(block.alias("block"), "doc", F.inline("weights")), "index")
    return index, stored(index.groupBy("block", "term").agg(F.max("w").alias("w")), "maxima")


def block_top_k(queries: DataFrame, key: str, text: str, index: DataFrame, most: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query, doc, score, rank) of the k best documents of each query, ties to the smaller document; and the
    (query, block, bound, wave) that were scored.

    Exact: a block that is left out has a bound below the k-th score of its query."""
    q = stored(terms(queries.withColumnRenamed(key, "query"), "query", text).withColumnRenamed("tf", "qtf"), "query-terms")
    asked = q.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("query").alias("queries")).first()
    hint = lambda df, rows: F.broadcast(df) if rows <= FEW else df  # noqa: E731  a side of no more rows than that
    mine = hint(q, asked["terms"])
    left = stored(most.join(mine, "term").groupBy("query", "block").agg(F.sum(F.col("w") * F.col("qtf")).alias("bound")), "bounds")
    if asked["queries"] == 0:
        return top_k(left.select("query", F.lit(None).cast(index.schema["doc"].dataType).alias("doc"), F.col("bound").alias("score")), "query", "doc", "score", k), left.withColumn("wave", F.lit(0))

    def scores(wave: DataFrame) -> DataFrame:
        wanted = wave.select("query", "block").join(mine, "query")  # a query's terms in each of its blocks
        return index.join(wanted, ["block", "term"]).groupBy("query", "doc").agg(F.round(F.sum(F.col("w") * F.col("qtf")), 6).alias("score"))

    best, scored = None, []
    for i, limit in enumerate(WAVES):  # limited in each task before the shuffle
        order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
        wave = left.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")
        found = scores(hint(wave, asked["queries"] * limit))
        best = stored(top_k(found if best is None else found.unionByName(best.drop("rank")), "query", "doc", "score", k), "best")
        floor = best.groupBy("query").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("query", "floor")
        left = left.join(hint(wave.select("query", "block"), asked["queries"] * limit), ["query", "block"], "left_anti").join(hint(floor, asked["queries"]), "query", "left")
        left = left.filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)).drop("floor")
        scored.append(wave.withColumn("wave", F.lit(i)))
    scored.append(left.withColumn("wave", F.lit(len(WAVES))))
    # of what is left, first the terms without which no document reaches the k-th score; then all terms of those that still can
    top = most.groupBy("term").agg(F.max("w").alias("w")).join(mine, "term").select("query", "term", "qtf", (F.col("w") * F.col("qtf")).alias("most"))
    rising = Window.partitionBy("query").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a query's terms
    top = top.join(hint(floor, asked["queries"]), "query", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0)) - SLACK).withColumn("sum", F.sum("most").over(rising))
    top = top.withColumn("weak", F.col("sum") < F.col("floor"))
    rest = top.groupBy("query", "floor").agg(F.coalesce(F.sum(F.when(F.col("weak"), F.col("most"))), F.lit(0.0)).alias("rest"))
    strong = hint(top.filter(~F.col("weak")).select("query", "term", "qtf"), asked["terms"])
    reached = index.join(left.select("query", "block").join(strong, "query"), ["block", "term"]).groupBy("query", "block", "doc").agg(F.sum(F.col("w") * F.col("qtf")).alias("part"))
    reached = reached.join(hint(rest, asked["queries"]), "query").filter(F.col("part") + F.col("rest") >= F.col("floor")).select("query", "block", "doc")
    found = index.join(reached, ["block", "doc"]).join(mine, ["query", "term"]).groupBy("query", "doc").agg(F.round(F.sum(F.col("w") * F.col("qtf")), 6).alias("score"))
    best = top_k(found.unionByName(best.drop("rank")), "query", "doc", "score", k)
    return best, reduce(DataFrame.unionByName, scored)


def bm25_top_k(queries: DataFrame, docs: DataFrame, qkey: str, dkey: str, text: str, k: int) -> DataFrame:
    """(query, document, score, rank): the k best documents of each query that share a term with it.

    A query set that can be broadcast is scored beside the documents, whose scores are cut to k in each task before anything is shuffled:
    that costs less than an index that is used once. Larger ones go through the index."""
    q = terms(queries, qkey, text)
    if q.limit(FEW + 1).count() <= FEW:
        scored = bm25(queries, docs, qkey, dkey, text)
        return top_k(scored.withColumn("score", F.round("score", 6)), qkey, dkey, "score", k).select(qkey, dkey, "score", "rank")
    vocabulary = stored(q.select("term").distinct(), "vocabulary")
    index, most = build(docs, dkey, text, vocabulary)
    best, _ = block_top_k(queries, qkey, text, index, most, k)
    return best.withColumnsRenamed({"query": qkey, "doc": dkey})
