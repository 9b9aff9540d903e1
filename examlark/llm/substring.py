"""Operator 8: substring dedup on a compacted de Bruijn graph of word k-mers.

The edges of the graph are the windows of ``window`` consecutive words that occur more than once, its nodes the
windows one word shorter. To find the edges, every window goes to the bucket of its smallest inner k-mer, and a run of
consecutive windows of one document with the same minimizer travels as one row; a bucket keeps the windows that
occur more than once, each with the source coordinates (document, place) of its first occurrence, by (doc_id, text
hash, place). An edge is so drawn once, at its first occurrence.

Compaction. In- and out-degrees are counted over all edges (``degrees``). First occurrences that follow each other in a
document are one chain as far as the nodes between them do not branch (``chains``); chains that end and begin at
one node that does not branch are linked by a join, and connected links are the non-branching paths (``paths``).

Verification. Every occurrence of a piece of a chain is a claim: these words equal those at the chain's source
coordinates. The 128-bit BLAKE2 digests of the words at both places are compared; what differs (windows share the
64 bits of a minimizer and 48 of their own without being equal) is counted again, window by window, by digests alone.
Words that a verified piece covers go.

A minimizer that a sample finds in a large share of all runs (a passage that very many documents share) is
hot: its windows are counted one by one by a pre-aggregated count and a join with the counted, broadcast result.
The sample only chooses the way, never the result.

Cases: a null or empty text has no words; a text shorter than a window loses nothing; all copies of a repeated
window go, the first as well; rows that repeat a doc_id are told apart by their text, and equal rows repeat
each other; a null doc_id is an id like others; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, graph

WINDOW, KMER = 35, 8
#: Windows in one path, at most; bytes of a window's hash in a path.
PATH, BYTES = 2048, 6
SAMPLE = 16
NULL_ID = -(1 << 63)
#: Distinct hot edges that are broadcast, at most; ranges of one document whose digests are asked for in one row; places that are joined as one.
HOT_EDGES, RANGES, BIN = 500_000, 4096, 512
#: A piece of a document: windows lo to hi, which occurred first at (rid, rth, rlo) and the following places.
PIECE = "id bigint, th bigint, lo int, hi int, rid bigint, rth bigint, rlo int"


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    level, width = x, 1
    while width * 2 <= size:
        level = np.minimum(level[:-width], level[width:])
        width *= 2
    return np.minimum(level[: len(x) - size + 1], level[size - width : size - width + len(x) - size + 1])


def edges(col: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the text, minimizer, hash) of every window."""
    data, offsets = common.utf8(col)
    starts, ends, first = common.word_spans(data, offsets)
    none = np.zeros(0, np.int64)
    if len(starts) < window:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    words = common.word_hashes(data, starts, ends, False)
    pos, text = common.inside_one_text(first, window, len(words))
    k = min(KMER, window)
    least = sliding_min(common.gram_hashes(words, k), window - k + 1)
    return text, pos - first[text], least[pos], common.rolling_hashes(words, window)[pos]


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id (never null) and th, which together name a row's text, and the id as it was."""
    own = F.col(doc_id).cast("bigint")
    return df.select(F.coalesce(own, F.lit(NULL_ID)).alias("id"), F.xxhash64(F.col(text)).alias("th"), own.alias("own"), F.col(text).alias("text"))


def runs(docs: DataFrame, window: int, hot: np.ndarray, n_bytes: int = BYTES) -> DataFrame:
    """(key, id, th, start, hashes): the runs of windows of all buckets that are not hot."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                text, place, least, edge = edges(common.column(part, "text"), window)
                if len(hot):
                    cold = ~np.isin(least, hot)
                    text, place, least, edge = text[cold], place[cold], least[cold], edge[cold]
                if not len(text):
                    continue
                new = np.r_[True, (text[1:] != text[:-1]) | (least[1:] != least[:-1]) | (place[1:] != place[:-1] + 1)]
                head = np.flatnonzero(new)
                run_of = np.cumsum(new) - 1
                head = np.flatnonzero(new | ((np.arange(len(text)) - head[run_of]) % PATH == 0))
                size = np.diff(np.r_[head, len(text)])
                offs = np.zeros(len(head) + 1, np.int32)
                np.cumsum(size * n_bytes, out=offs[1:])
                body = np.ascontiguousarray(edge.view(np.uint8).reshape(-1, 8)[:, :n_bytes])
                ids, th = (common.column(part, c).to_numpy()[text[head]] for c in ("id", "th"))
                packed = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offs), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([pa.array(least[head].view(np.int64)), pa.array(ids), pa.array(th), pa.array(place[head].astype(np.int32)), packed], names=["key", "id", "th", "start", "hashes"])

    return docs.mapInArrow(run, "key bigint, id bigint, th bigint, start int, hashes binary")


def _repeated(t: pa.Table, n_bytes: int) -> pa.RecordBatch:
    """Pieces of runs whose windows occur more than once in their bucket. Rows come sorted by id, th and start."""
    hashes = t["hashes"].combine_chunks()
    offs = np.frombuffer(hashes.buffers()[1], np.int32)[hashes.offset : hashes.offset + len(hashes) + 1]
    body = np.frombuffer(hashes.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(-1, n_bytes)
    wide = np.zeros((len(body), 8), np.uint8)
    wide[:, :n_bytes] = body
    size = np.diff(offs) // n_bytes
    row = np.repeat(np.arange(len(size)), size)
    ids, th, start = (t[c].to_numpy() for c in ("id", "th", "start"))
    edge = common.mix(wide.view(np.uint64)[:, 0] + common.mix(t["key"].to_numpy().view(np.uint64))[row] * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(edge, kind="stable")
    new = np.r_[True, edge[order][1:] != edge[order][:-1]]
    group = np.cumsum(new) - 1
    first = np.zeros(len(edge), np.int64)
    first[order] = order[new][group]
    many = np.zeros(len(edge), bool)
    many[order] = np.bincount(group)[group] > 1
    fresh = np.r_[True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1])]  # equal rows have equal pieces
    at = np.flatnonzero(many & fresh[row])
    rep = first[at]
    cut = np.r_[True, (np.diff(at) != 1) | (np.diff(rep) != 1) | (row[at][1:] != row[at][:-1]) | (row[rep][1:] != row[rep][:-1])] if len(at) else np.zeros(0, bool)
    head = np.flatnonzero(cut)
    tail = np.r_[head[1:], len(at)] - 1 if len(head) else head
    base = np.cumsum(size) - size
    place = lambda x: start[row[x]] + (x - base[row[x]])
    rows, reps = row[at[head]], row[rep[head]]
    cols = [ids[rows], th[rows], place(at[head]).astype(np.int32), place(at[tail]).astype(np.int32), ids[reps], th[reps], place(rep[head]).astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["id", "th", "lo", "hi", "rid", "rth", "rlo"])


def bucket_repeats(p: DataFrame, n_bytes: int = BYTES) -> DataFrame:
    """The repeated pieces; reads sorted buckets as a stream, one open bucket at a time."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = common.column(batch, "key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))  # the last bucket may go on
            if cut == 0 and rest and common.column(rest[-1], "key")[-1].as_py() == key[-1]:
                rest.append(batch)
                continue
            done = [*rest, batch.slice(0, cut)] if cut else rest
            if done:
                yield _repeated(pa.Table.from_batches(done), n_bytes)
            rest = [batch.slice(cut)]
        if rest:
            yield _repeated(pa.Table.from_batches(rest), n_bytes)

    return p.repartition("key").sortWithinPartitions("key", "id", "th", "start").mapInArrow(run, PIECE)


def hot_minimizers(docs: DataFrame, window: int) -> np.ndarray:
    """Minimizers of so many paths that one would fill a good part of a partition; at most 4 for each partition."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = docs.filter(F.pmod(F.xxhash64("id", "th"), F.lit(SAMPLE)) == 0)
    counts = common.materialize(runs(sample, window, np.zeros(0, np.uint64)).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "minimizers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") > max(512 / SAMPLE, total / (4 * parts))).select("key").limit(4 * parts).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def hot_repeats(docs: DataFrame, window: int, hot: np.ndarray) -> DataFrame:
    """The repeated pieces of the hot buckets, a window at a time."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                text, place, least, edge = edges(common.column(part, "text"), window)
                some = np.flatnonzero(np.isin(least, hot))
                if len(some):
                    ids, th = (common.column(part, c).to_numpy()[text[some]] for c in ("id", "th"))
                    arrays = [pa.array(least[some].view(np.int64)), pa.array(edge[some].view(np.int64)), pa.array(ids), pa.array(th), pa.array(place[some].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "edge", "id", "th", "lo"])

    e = docs.mapInArrow(run, "key bigint, edge bigint, id bigint, th bigint, lo int")
    many = e.groupBy("key", "edge").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "lo")).alias("f")).filter("n > 1")
    many = common.materialize(many.select("key", "edge", F.col("f.id").alias("rid"), F.col("f.th").alias("rth"), F.col("f.lo").alias("rlo")), "hot-edges")
    few = many.limit(HOT_EDGES + 1).count() <= HOT_EDGES
    found = e.join(F.broadcast(many) if few else many, ["key", "edge"]).select("id", "th", "lo", F.col("lo").alias("hi"), "rid", "rth", "rlo")
    return found.dropDuplicates(["id", "th", "lo"])  # equal rows


def pieces(docs: DataFrame, window: int, n_bytes: int = BYTES) -> DataFrame:
    """(id, th, pieces: array of lo, hi, rid, rth, rlo) of each document that holds a repeated window, as long as can be."""
    hot = hot_minimizers(docs, window)
    found = bucket_repeats(runs(docs, window, hot, n_bytes), n_bytes)
    if len(hot):
        found = found.union(hot_repeats(docs, window, hot))
    fields = ("lo", "hi", "rid", "rth", "rlo")
    by_doc = found.groupBy("id", "th").agg(F.collect_list(F.struct(*fields)).alias("pieces"))  # no more than its windows

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = common.column(batch, "pieces")
            n = np.diff(col.offsets.to_numpy())
            flat = col.flatten()
            lo, hi, rid, rth, rlo = (flat.field(f).to_numpy() for f in fields)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((lo, doc))
            lo, hi, rid, rth, rlo = lo[order], hi[order], rid[order], rth[order], rlo[order]
            apart = np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] != hi[:-1] + 1) | (rid[1:] != rid[:-1]) | (rth[1:] != rth[:-1]) | (rlo[1:] - lo[1:] != rlo[:-1] - lo[:-1])] if len(lo) else np.zeros(0, bool)
            head = np.flatnonzero(apart)
            tail = np.r_[head[1:], len(lo)] - 1 if len(head) else head
            merged = pa.StructArray.from_arrays([pa.array(x) for x in (lo[head], hi[tail], rid[head], rth[head], rlo[head])], list(fields))
            offsets = np.r_[0, np.cumsum(np.bincount(doc[head], minlength=len(n)))].astype(np.int32)
            yield common.appended(batch, ["id", "th"], {"pieces": pa.ListArray.from_arrays(pa.array(offsets), merged)})

    return by_doc.mapInArrow(run, "id bigint, th bigint, pieces array<struct<lo:int,hi:int,rid:bigint,rth:bigint,rlo:int>>")


def _with_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows by (id, th) with their documents' text, once for equal rows; of few documents, counted, no other text is shuffled."""
    few = rows.limit(common.BROADCAST_KEYS + 1).count() <= common.BROADCAST_KEYS
    some = docs.join(F.broadcast(rows.select("id", "th").distinct()), ["id", "th"], "left_semi") if few else docs
    return some.groupBy("id", "th").agg(F.first("text").alias("text")).join(rows, ["id", "th"])


def nodes(docs: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(id, th, place, node, n_in, n_out): the ends of every edge at its first occurrence; inside a run of edges a node has
    one edge on either side."""
    own = F.filter("pieces", lambda x: (x["rid"] == F.col("id")) & (x["rth"] == F.col("th")) & (x["rlo"] == x["lo"]))
    drawn = found.select("id", "th", own.alias("own")).filter(F.size("own") > 0).select("id", "th", F.col("own.lo").alias("lo"), F.col("own.hi").alias("hi"))

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                data, offsets = common.utf8(common.column(part, "text"))
                starts, ends, first = common.word_spans(data, offsets)
                h = common.rolling_hashes(common.word_hashes(data, starts, ends, False), window - 1)
                lo, hi = common.column(part, "lo"), common.column(part, "hi")
                n = np.diff(lo.offsets.to_numpy())
                row = np.repeat(np.arange(len(n)), n)
                lo, hi = lo.flatten().to_numpy().astype(np.int64), hi.flatten().to_numpy().astype(np.int64)
                size = hi - lo + 2
                at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                of = np.repeat(row, size)
                n_in = (at > np.repeat(lo, size)).astype(np.int8)
                n_out = (at <= np.repeat(hi, size)).astype(np.int8)
                ids, th = (common.column(part, c).to_numpy()[of] for c in ("id", "th"))
                cols = [ids, th, at.astype(np.int32), h[first[of] + at].view(np.int64), n_in, n_out]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["id", "th", "place", "node", "n_in", "n_out"])

    rows = _with_texts(docs, drawn).select("id", "th", "text", "lo", "hi")
    return rows.mapInArrow(run, "id bigint, th bigint, place int, node bigint, n_in tinyint, n_out tinyint").dropDuplicates(["id", "th", "place"])


def degrees(ends: DataFrame) -> DataFrame:
    """(node) of those that branch: with more than one edge in or out."""
    d = ends.groupBy("node").agg(F.sum("n_in").alias("i"), F.sum("n_out").alias("o"))
    return d.filter("i > 1 OR o > 1").select("node")


def chains(ends: DataFrame, branching: DataFrame) -> DataFrame:
    """(chain, id, th, lo, hi, u, v): consecutive first occurrences between nodes where a run ends or the graph branches."""
    inner = ends.filter("n_in = 1 AND n_out = 1")
    stops = ends.filter("n_in = 0 OR n_out = 0").unionByName(inner.join(branching, "node", "left_semi").select(ends.columns))
    by = Window.partitionBy("id", "th").orderBy("place")  # places of one document
    c = stops.withColumn("hi", F.lead("place").over(by) - 1).withColumn("v", F.lead("node").over(by)).filter("n_out = 1")
    return c.select(F.monotonically_increasing_id().alias("chain"), "id", "th", F.col("place").alias("lo"), "hi", F.col("node").alias("u"), "v")


def paths(chain: DataFrame, branching: DataFrame) -> DataFrame:
    """(chain, path): chains that meet at a node that does not branch are one path, named by its smallest chain."""
    ends = chain.select(F.col("chain").alias("a"), F.col("v").alias("node")).join(branching, "node", "left_anti")
    links = ends.join(chain.select(F.col("chain").alias("b"), F.col("u").alias("node")), "node").select("a", "b")
    found = graph.components(links, "a", "b").withColumnRenamed("id", "chain").withColumnRenamed("component", "path")
    return chain.select("chain").join(found, "chain", "left").select("chain", F.coalesce("path", "chain").alias("path"))


def compacted(docs: DataFrame, found: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The chains, and (chain, path): the compacted graph of ``pieces``."""
    ends = common.materialize(nodes(docs, found, window), "nodes")
    branching = common.materialize(degrees(ends), "branching")
    chain = common.materialize(chains(ends, branching), "chains")
    return chain, common.materialize(paths(chain, branching), "paths")


def repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """path, n_words, doc_id and place of every non-branching path of repeated windows: a passage and where its first chain starts."""
    docs = _keyed(df, doc_id, text)
    chain, path = compacted(docs, common.materialize(pieces(docs, window), "pieces"), window)
    c = chain.join(path, "chain").groupBy("path").agg((F.sum(F.col("hi") - F.col("lo") + 1) + window - 1).alias("n_words"), F.min(F.struct("id", "lo")).alias("s"))
    return c.select("path", "n_words", F.when(F.col("s.id") != NULL_ID, F.col("s.id")).alias(doc_id), F.col("s.lo").alias("place"))


def _digests(text: str | None, ranges: list[tuple[int, int]]) -> list[bytes]:
    words = (text or "").encode("utf-8").split()
    return [hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest() for a, b in ranges]


def claims(docs: DataFrame, found: DataFrame, chain: DataFrame, window: int) -> DataFrame:
    """(id, th, rid, rth, lo, n, digest): pieces cut at the ends of the chains that they follow, with the digest of the n words
    at the chain's coordinates; null for first occurrences themselves."""
    p = found.select("id", "th", F.inline("pieces"))
    c = chain.select(F.col("id").alias("rid"), F.col("th").alias("rth"), F.col("lo").alias("clo"), F.col("hi").alias("chi"))
    bins = lambda x, y: F.explode(F.sequence(F.floor(x / BIN), F.floor(y / BIN)))
    p = p.withColumn("bin", bins(F.col("rlo"), F.col("rlo") + F.col("hi") - F.col("lo")))
    c = c.withColumn("bin", bins(F.col("clo"), F.col("chi")))
    p = p.join(c, ["rid", "rth", "bin"]).filter("rlo <= chi AND rlo + hi - lo >= clo").filter(F.col("bin") == F.floor(F.greatest("rlo", "clo") / BIN))
    a, b = F.greatest("rlo", "clo"), F.least(F.col("rlo") + F.col("hi") - F.col("lo"), F.col("chi"))
    p = p.select("id", "th", "rid", "rth", (F.col("lo") + a - F.col("rlo")).alias("lo"), (b - a + window).alias("n"), a.alias("at"))
    p = common.materialize(p, "claims")
    first = (F.col("id") == F.col("rid")) & (F.col("th") == F.col("rth")) & (F.col("lo") == F.col("at"))
    asked = p.filter(~first).select("rid", "rth", "at", "n").distinct()
    many = asked.groupBy("rid", "rth").count().filter(F.col("count") > RANGES).withColumn("blocks", F.ceil(F.col("count") / RANGES)).drop("count")
    asked = asked.join(many, ["rid", "rth"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("at", "n"), "blocks"), F.lit(0)))
    asked = asked.groupBy(F.col("rid").alias("id"), F.col("rth").alias("th"), "block").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))
    asked = common.materialize(asked, "ranges")
    out = "rid bigint, rth bigint, at int, n int, digest binary"

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows = []
                for i, t, text, ranges in zip(*(common.column(part, x).to_pylist() for x in ("id", "th", "text", "ranges"))):
                    got = _digests(text, [(r["at"], r["at"] + r["n"]) for r in ranges])
                    rows += [(i, t, r["at"], r["n"], d) for r, d in zip(ranges, got)]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["rid", "rth", "at", "n", "digest"])

    told = _with_texts(docs, asked).select("id", "th", "text", "ranges").mapInArrow(run, out).dropDuplicates(["rid", "rth", "at", "n"])
    told = common.materialize(told, "digests")
    return p.join(told, ["rid", "rth", "at", "n"], "left").withColumn("digest", F.when(~first, F.coalesce("digest", F.lit(b"")))).select("id", "th", "rid", "rth", "lo", "n", "digest")


def recounted(docs: DataFrame, claim: DataFrame, failed: DataFrame, window: int) -> DataFrame:
    """(id, th, lo, n) of windows that occur more than once by digest, among all claims on sources that a failed claim names."""
    again = claim.join(failed, ["rid", "rth"], "left_semi").groupBy("id", "th").agg(F.collect_list(F.struct("lo", "n")).alias("ranges"))

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, text, ranges in zip(*(common.column(batch, x).to_pylist() for x in ("id", "th", "text", "ranges"))):
                at = sorted({k for r in ranges for k in range(r["lo"], r["lo"] + r["n"] - window + 1)})
                got = _digests(text, [(k, k + window) for k in at])
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int64()), pa.array([t] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(got, pa.binary())], names=["id", "th", "lo", "digest"])

    w = common.materialize(docs.join(again, ["id", "th"]).select("id", "th", "text", "ranges").mapInArrow(run, "id bigint, th bigint, lo int, digest binary"), "recounted")
    many = w.groupBy("digest").count().filter("count > 1").select("digest")
    return w.join(many, "digest", "left_semi").select("id", "th", "lo", F.lit(window).alias("n")).distinct()


def _cut(docs: DataFrame) -> DataFrame:
    """own, n_words, n_removed, kept_text and bad (source of a claim that does not hold) of documents with their claims."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                out: list[tuple[int, int, str, list[dict[str, int]]]] = []
                for t, marks in zip(*(common.column(part, c).to_pylist() for c in ("text", "claims"))):
                    words = (t or "").encode("utf-8").split()
                    bad, cover = [], np.zeros(len(words) + 1, np.int64)
                    for m in marks or ():
                        a, b = m["lo"], m["lo"] + m["n"]
                        if m["digest"] is None or hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest() == m["digest"]:
                            cover[a] += 1
                            cover[b] -= 1
                        else:
                            bad.append({"rid": m["rid"], "rth": m["rth"]})
                    keep = np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist() if marks else range(len(words))
                    out.append((len(words), len(words) - len(keep), b" ".join([words[i] for i in keep]).decode("utf-8"), bad))
                n, gone, kept, bad_ = zip(*out)
                kind = pa.list_(pa.struct([("rid", pa.int64()), ("rth", pa.int64())]))
                yield pa.RecordBatch.from_arrays([common.column(part, "own"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(bad_, kind)], names=["own", "n_words", "n_removed", "kept_text", "bad"])

    return docs.select("own", "text", "claims").mapInArrow(run, "own bigint, n_words bigint, n_removed bigint, kept_text string, bad array<struct<rid:bigint,rth:bigint>>")


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, n_bytes: int = BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of each row."""
    docs = _keyed(df, doc_id, text)
    found = common.materialize(pieces(docs, window, n_bytes), "pieces")
    chain, _ = compacted(docs, found, window)
    claim = common.materialize(claims(docs, found, chain, window), "claimed")

    few = found.limit(common.BROADCAST_KEYS + 1).count() <= common.BROADCAST_KEYS
    keys = F.broadcast(found.select("id", "th"))  # only if few
    some = docs.join(keys, ["id", "th"], "left_semi") if few else docs

    def cut(claim: DataFrame) -> DataFrame:
        marks = claim.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "n", "digest", "rid", "rth")).alias("claims"))
        return common.materialize(_cut(some.join(marks, ["id", "th"], "left")), "cut")

    done = cut(claim)
    failed = done.filter(F.size("bad") > 0).select(F.inline("bad")).distinct()
    if not failed.isEmpty():
        right = recounted(docs, claim, failed, window)
        none = [F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("rid"), F.lit(0).cast("bigint").alias("rth")]
        rest = claim.join(failed, ["rid", "rth"], "left_anti").select("id", "th", "lo", "n", "digest", "rid", "rth")
        done = cut(rest.unionByName(right.select("id", "th", "lo", "n", *none)))
    if few:  # the others need no join
        others = docs.join(keys, ["id", "th"], "left_anti")
        done = done.unionByName(_cut(others.withColumn("claims", F.lit(None).cast("array<struct<lo:int,n:int,digest:binary,rid:bigint,rth:bigint>>"))))
    return done.select(F.col("own").alias(doc_id), "n_words", "n_removed", "kept_text")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(common.table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
