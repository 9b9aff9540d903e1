"""Operator 9: line dedup by an exact set-similarity join.

A line is the set of its lower-cased (A-Z) words; sets of fewer than ``min_tokens`` words are left alone (op9_lines
and the pipeline take all lines of one word or more). A line goes if an earlier line, by (doc_id, text hash, line
number), has a Jaccard similarity of at least num / den, whether or not that one goes itself.

Equal sets meet first: only the first line of each goes on. Words are ordered by rarity (counts of all words of
all documents in a table of hash slots, whose size is fixed; ties by hash), and two similar sets share a word of
their prefixes; a set so small that only an equal one reaches num / den (fewer than four words at 80 / 100) has none.
In the bucket of a prefix word, pairs must pass the length filter, the positional filter and a parity sketch (each
differing bit needs a differing word). A line needs only one earlier match, so a bucket gives each line its nearest
earlier candidate alone, and says if there were more. Candidates are verified on the whole sets; only lines whose
candidate failed and that had more meet all others that pass. Groups of copies are so never spread out into all
their pairs, and no candidate is lost. The bucket of a word that a sample finds in very many prefixes is dealt in blocks,
and every two blocks meet in a task of their own; the sample only chooses the way. Texts are shuffled only for documents
that lose lines, as long as these, counted, are few enough to be broadcast. The first line of each set is found once and
written. Prefix words are most of what is shuffled: they travel as packed columns (``packed``), many rows of a few buckets at a time.

Cases: null texts stay null; empty texts, empty lines and white space are no lines to compare and stay; line
ends are \\n; a document may become empty; rows that repeat a doc_id are told apart by their text, and equal
rows are one document, which is compared once; a null doc_id comes before all others. Columns other than the text pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .substring import NULL_ID

MIN_TOKENS = 5
#: The least words of a line for which no line that has any is left out.
ALL = 1
#: Slots of the table of word counts: its size does not depend on the data.
SLOT_BITS = 20
#: Sets of more words than the second carry a sketch of 256 bits, of more than the first one of 128, others of 64; a narrow one is a wide one folded.
WIDE = (40, 128)
#: One of so many lines is sampled for frequent prefix words; lines of a block of a frequent word's bucket.
SAMPLE, BUCKET_BLOCK = 16, 16384
#: Rows of the part of the buckets that is compared at once, about, and prefix words that a task gathers before it deals them out.
PART_ROWS, GATHERED = 200_000, 1_000_000
#: Gathered prefix words whose columns are laid out at once, about, and pairs that are compared at once.
SPAN, AT_ONCE = 1 << 16, 500_000


def line_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number, hash) of every word."""
    data, offsets = common.utf8(col)
    starts, ends, first = common.word_spans(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    return text, breaks[starts] - breaks[offsets[:-1]][text], common.word_hashes(data, starts, ends, True)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def word_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all words of all texts, by slot."""
    width = 1 << 14

    @common.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)  # saturates at 2^31 - 1, which no longer tells common words apart
        salt, held = 0, []
        for batch in batches:
            for part in common.slices(batch, "text"):
                data, offsets = common.utf8(common.column(part, "text"))
                starts, ends, _ = common.word_spans(data, offsets)
                held.append(_slot(common.word_hashes(data, starts, ends, True)).astype(np.int32))
                salt = (salt + len(starts)) % 61
                if len(held) == 16:
                    total += np.bincount(np.concatenate(held), minlength=1 << SLOT_BITS)
                    held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << SLOT_BITS)
        if total.any():
            rows = np.minimum(total, (1 << 31) - 1).astype(np.int32).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array(list(rows), pa.list_(pa.int32()))], names=["g", "salt", "n"])

    def add(t: pa.Table) -> pa.Table:
        n = np.minimum(t["n"].combine_chunks().flatten().to_numpy().reshape(-1, width).sum(axis=0, dtype=np.int64), (1 << 31) - 1)
        return pa.table([pa.array([t["g"][0].as_py()], pa.int32()), pa.array([t["salt"][0].as_py()], pa.int32()), pa.array([n.astype(np.int32)], pa.list_(pa.int32()))], names=["g", "salt", "n"])

    kind = "g int, salt int, n array<int>"
    parts = docs.select("text").mapInArrow(count, kind).groupBy("g", "salt").applyInArrow(add, kind)
    out = np.zeros((1 << SLOT_BITS) // width * width, np.int64).reshape(-1, width)
    for r in parts.groupBy("g").applyInArrow(add, kind).toLocalIterator():  # 64 rows
        out[r["g"]] = r["n"]
    return np.minimum(np.log2(1 + out.ravel()) * 128, 4095).astype(np.uint16)


#: A line's place; the same for the later and the earlier one of a pair.
KEY, X, Y = ["id", "th", "ln"], ["xi", "xt", "xl"], ["yi", "yt", "yl"]


#: What a bucket needs of a line, in order, and how it is packed.
FACTS = {"w": "<i8", "id": "<i8", "th": "<i8", "ln": "<i4", "s": "<i4", "p": "<i4", "side": "u1", "b0": "<i8", "b1": "<i8", "b2": "<i8", "b3": "<i8"}


def packed(cols: list[np.ndarray]) -> bytes:
    """Columns of equal length, ``FACTS`` in order and sorted by the first, as planes of bytes: what varies little takes no room."""
    step = cols[0].copy()
    step[1:] = cols[0][1:] - cols[0][:-1]
    return b"".join(np.ascontiguousarray(c.astype(kind, copy=False)).view(np.uint8).reshape(len(step), -1).T.tobytes() for c, kind in zip([step, *cols[1:]], FACTS.values()))


def unpacked(blob: bytes) -> list[np.ndarray]:
    sizes = [np.dtype(kind).itemsize for kind in FACTS.values()]
    n, at, out = len(blob) // sum(sizes), 0, []
    for size, kind in zip(sizes, FACTS.values()):
        out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return [np.cumsum(out[0]), *out[1:]]


PAIRS = "xi bigint, xt bigint, xl int, yi bigint, yt bigint, yl int, apart int, more boolean"


def _pairs(t: pa.Table, num: int, den: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Candidates among rows sorted by bucket (and side, if there is one)."""
    sided = "side" in t.column_names
    w, ids, th, ln = (t[c].to_numpy() for c in ("w", "id", "th", "ln"))
    s, p = t["s"].to_numpy().astype(np.int64), t["p"].to_numpy().astype(np.int64)
    b = np.stack([t[f"b{i}"].to_numpy() for i in range(4)]).view(np.uint64)
    half = np.stack([b[0] ^ b[2], b[1] ^ b[3]])
    fold = half[0] ^ half[1]
    width = np.where(s > WIDE[1], 2, np.where(s > WIDE[0], 1, 0)) if not every else np.full(len(s), 2)
    probe = t["probe"].to_numpy(zero_copy_only=False) if every else None
    head = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    size = np.diff(np.r_[head, len(w)])
    rank = np.arange(len(w)) - np.repeat(head, size)  # lines before it in the bucket
    todo = rank
    if sided:
        side = t["side"].to_numpy()
        todo = np.where(side == 2, rank, np.where(side == 1, np.repeat(np.add.reduceat((side == 0).astype(np.int64), head), size), 0))
    elif probe is not None:
        todo = np.where(probe, rank, 0)
    done, total = 0, np.cumsum(todo)
    while done < len(w):
        base = total[done - 1] if done else 0
        to = max(done + 1, int(np.searchsorted(total, base + AT_ONCE, side="right")))
        n = todo[done:to]
        x = np.repeat(np.arange(done, to), n)
        y = x - rank[x] + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        done = to
        ok = np.minimum(s[x], s[y]) * den >= np.maximum(s[x], s[y]) * num
        x, y = x[ok], y[ok]
        both = s[x] + s[y]
        need = (both * num + den + num - 1) // (den + num)
        ok = np.minimum(s[x] - p[x], s[y] - p[y]) >= need
        x, y, most = x[ok], y[ok], (both - 2 * need)[ok]
        apart = np.bitwise_count(fold[x] ^ fold[y]).astype(np.int64)
        both_wide = np.minimum(width[x], width[y])
        for least, words_ in ((1, half), (2, b)):
            some = np.flatnonzero((both_wide >= least) & (apart <= most))
            if len(some):
                apart[some] = sum(np.bitwise_count(v[x[some]] ^ v[y[some]]).astype(np.int64) for v in words_)
        ok = (apart <= most) & ((ids[x] != ids[y]) | (th[x] != th[y]) | (ln[x] != ln[y]))
        x, y, apart = x[ok], y[ok], apart[ok]
        if not len(x):
            continue
        # the later line is x
        swap = (ids[x] < ids[y]) | ((ids[x] == ids[y]) & ((th[x] < th[y]) | ((th[x] == th[y]) & (ln[x] < ln[y]))))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        more = np.zeros(len(x), bool)
        if every:
            mine = probe[x]
            x, y, apart, more = x[mine], y[mine], apart[mine], more[mine]
        else:  # of each x the nearest y
            order = np.lexsort((y, apart, x))
            x, y, apart = x[order], y[order], apart[order]
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            more = np.diff(np.r_[first, len(x)]) > 1
            x, y, apart = x[first], y[first], apart[first]
        for at in range(0, len(x), 100_000):
            i, j = x[at : at + 100_000], y[at : at + 100_000]
            cols = [ids[i], th[i], ln[i], ids[j], th[j], ln[j], apart[at : at + 100_000].astype(np.int32), more[at : at + 100_000]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=[*X, *Y, "apart", "more"])


class Lines:
    def __init__(self, docs: DataFrame, num: int, den: int, min_tokens: int) -> None:
        self.docs, self.num, self.den, self.min = docs, num, den, min_tokens  # id, th, text

    def described(self, rarity: np.ndarray) -> DataFrame:
        """A row for each line that is compared: its place (id, th, ln), set (h1, h2, s), sketch and prefix, rarest first."""
        num, den, least = self.num, self.den, self.min
        shared = self.docs.sparkSession.sparkContext.broadcast(rarity)  # of fixed size

        @common.tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rare = shared.value
            for batch in batches:
                for part in common.slices(batch, "text"):
                    text, line, h = line_words(common.column(part, "text"))
                    if not len(h):
                        continue
                    group = np.cumsum(np.r_[False, (text[1:] != text[:-1]) | (line[1:] != line[:-1])])
                    place = (group.astype(np.uint64) << np.uint64(44)) | (rare[_slot(h)].astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
                    order = np.argsort(place) if group[-1] < 1 << 20 else np.lexsort((place, group))
                    h, group = h[order], group[order]
                    new = np.r_[True, (h[1:] != h[:-1]) | (group[1:] != group[:-1])]
                    h, group, order = h[new], group[new], order[new]
                    good = np.bincount(group)[group] >= least
                    h, group, order = h[good], group[good], order[good]
                    if not len(h):
                        continue
                    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                    s = np.diff(np.r_[head, len(h)])
                    word = order[head]
                    prefix = np.where(s * den >= (s + 1) * num, s - (num * s + den - 1) // den + 1, 0)  # 0: only equal sets are similar
                    at = np.arange(len(h)) - np.repeat(head, s)
                    bit, one = (h >> np.uint64(40)) & np.uint64(255), np.uint64(1)
                    sketch = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == w, one << (bit & np.uint64(63)), np.uint64(0)), head).view(np.int64) for w in range(4)]
                    ids, th = (common.column(part, c).to_numpy()[text[word]] for c in ("id", "th"))
                    key = ((h[at < np.repeat(prefix, s)] >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                    set_hash = [np.add.reduceat(common.mix(h ^ np.uint64(salt)), head).view(np.int64) for salt in (0x1B873593, 0x85EBCA6B2)]
                    cols = [ids, th, line[word].astype(np.int32), *set_hash, s.astype(np.int32), *sketch]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), common.lists(key, prefix, pa.int32())], names=["id", "th", "ln", "h1", "h2", "s", "b0", "b1", "b2", "b3", "prefix"])

        return self.docs.mapInArrow(run, "id bigint, th bigint, ln int, h1 bigint, h2 bigint, s int, b0 bigint, b1 bigint, b2 bigint, b3 bigint, prefix array<int>")

    def nearest(self, firsts: DataFrame, sample: DataFrame) -> DataFrame:
        """Of rows (id, th, ln, s, b0..b3, prefix): each line's nearest earlier candidate of a block of a bucket, and whether there are
        more. Rows of a part of the buckets meet in one task, those of a task's lines as one packed value. sample: as for ``candidates``."""
        hot = sorted(self.frequent(sample))
        hot_words, blocks = np.array([w for w, _ in hot], np.int32), np.array([n for _, n in hot], np.int32)
        slots = 4 * int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total = firsts.agg(F.sum(F.size("prefix"))).first()[0] or 0
        parts, num, den = max(slots, total // PART_ROWS), self.num, self.den

        def dealt(t: pa.Table) -> Iterator[pa.RecordBatch]:
            lists_ = t["prefix"].combine_chunks()
            counts, w = np.diff(lists_.offsets.to_numpy()), lists_.flatten().to_numpy()
            line = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            p = np.arange(len(line), dtype=np.int32) - np.repeat(np.cumsum(counts, dtype=np.int32) - counts, counts)
            times = np.ones(len(w), np.int32)
            if len(hot_words):
                at = np.minimum(np.searchsorted(hot_words, w), len(hot_words) - 1)
                times = np.where(hot_words[at] == w, blocks[at], 1)
            cuts = np.searchsorted(np.cumsum(times), np.arange(0, times.sum(), GATHERED), side="left").tolist()
            facts = {c: t[c].to_numpy() for c in (*KEY, "s", "b0", "b1", "b2", "b3")}
            for lo, hi in zip(cuts, [*cuts[1:], len(w)]):
                if lo < hi:
                    yield from sent_off(facts, line[lo:hi], p[lo:hi], w[lo:hi], times[lo:hi])

        def sent_off(facts: dict[str, np.ndarray], line: np.ndarray, p: np.ndarray, w: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
            key, side = w.astype(np.int64), np.full(len(w), 2, np.uint8)
            part = (((key + (1 << 31)) * parts) >> 32).astype(np.int32)
            key <<= 32
            if times.max() > 1:  # a frequent word's line meets every block of its bucket
                ids, th, ln = (facts[c].astype(np.uint64) for c in KEY)
                b = (common.mix(common.mix(ids ^ common.mix(th)) + ln)[line] % times.astype(np.uint64)).astype(np.int64)
                j = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                line, p, part, key, side, b, times = (np.repeat(x, times) for x in (line, p, part, key, side, b, times))
                lo, hi, split = np.minimum(b, j), np.maximum(b, j), times > 1
                key = key | (lo << 16) | hi  # 0 and 0 where there is one block
                side = np.where(split & (lo != hi), np.where(b == lo, 0, 1), side).astype(np.uint8)
                part = np.where(split, (common.mix(key.view(np.uint64)) % np.uint64(parts)).astype(np.int32), part)
                del ids, th, ln, b, j, lo, hi, split
            order = np.lexsort((key, part))
            part = part[order]
            head = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            spans = head[np.flatnonzero(np.diff(head // SPAN, prepend=-1))].tolist()  # whole parts, whose columns are laid out together
            z = zstandard.ZstdCompressor(level=1)
            for lo, hi in zip(spans, [*spans[1:], len(order)]):
                rows = order[lo:hi]
                own = line[rows]
                cols = [key[rows], *(facts[c][own] for c in (*KEY, "s")), p[rows], side[rows], *(facts[f"b{i}"][own] for i in range(4))]
                some = head[np.searchsorted(head, lo) : np.searchsorted(head, hi)] - lo
                blobs = [z.compress(packed([c[x:y] for c in cols])) for x, y in zip(some.tolist(), [*some[1:].tolist(), hi - lo])]
                yield pa.RecordBatch.from_arrays([pa.array(part[lo + some].astype(np.int64)), pa.array(blobs, pa.binary())], names=["part", "rows"])

        @common.tidy
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            n = 0
            for batch in batches:
                held.append(batch)
                n += len(common.column(batch, "prefix").flatten())
                if n >= GATHERED:
                    yield from dealt(pa.Table.from_batches(held))
                    held, n = [], 0
            if n:
                yield from dealt(pa.Table.from_batches(held))

        def met(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            z = zstandard.ZstdDecompressor()
            cols = [np.concatenate(c) for c in zip(*(unpacked(z.decompress(b)) for b in blobs))]
            blobs.clear()
            order = np.lexsort((cols[6], cols[0]))
            for i, c in enumerate(cols):  # one at a time
                cols[i] = c[order]
            yield from _pairs(pa.table([pa.array(c) for c in cols], names=list(FACTS)), num, den, False)

        @common.tidy
        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for batch in batches:
                for part, blob in zip(common.column(batch, "part").to_pylist(), common.column(batch, "rows")):
                    if part != now and held:
                        yield from met(held)
                        held = []
                    now = part
                    held.append(blob.as_py())
            if held:
                yield from met(held)

        sent = firsts.select(*KEY, "s", "b0", "b1", "b2", "b3", "prefix").mapInArrow(deal, "part bigint, rows binary")
        return sent.repartition("part").sortWithinPartitions("part").mapInArrow(meet, PAIRS)

    def candidates(self, words: DataFrame, every: bool, sample: DataFrame) -> DataFrame:
        """Of rows (w, id, th, ln, s, p, b0..b3[, probe]): each line's nearest earlier candidate of a block of the bucket and
        whether there are more, or (every) all earlier candidates of the lines to probe. sample: the words of one of SAMPLE lines."""
        hot = self.frequent(sample)
        if not hot:
            return self.compared(words, every)
        table = F.broadcast(words.sparkSession.createDataFrame(hot, "w int, n bigint"))  # a row for each of a few words
        w = words.join(table, "w").withColumn("b", F.pmod(F.xxhash64("id", "th", "ln"), "n")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        lo, hi = F.least("b", "j"), F.greatest("b", "j")
        pair = F.shiftleft(F.col("w").cast("bigint"), 32).bitwiseOR(F.shiftleft(lo, 16)).bitwiseOR(hi)
        blocks = w.withColumn("side", F.when(lo == hi, 2).when(F.col("b") == lo, 0).otherwise(1)).withColumn("w", pair).drop("n", "b", "j")
        return self.compared(words.join(table, "w", "left_anti"), every).union(self.compared(blocks, every))

    def frequent(self, sample: DataFrame) -> list[tuple[int, int]]:
        """(word, blocks) of prefix words of so many lines that one task should not compare them."""
        parts = int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = sample.groupBy("w").count().filter(F.col("count") * SAMPLE > 2 * BUCKET_BLOCK).orderBy(F.desc("count"), "w").limit(4 * parts).collect()  # others stay whole, at any number
        return [(r["w"], min(1 << 15, -(-r["count"] * SAMPLE // BUCKET_BLOCK))) for r in rows]

    def compared(self, words: DataFrame, every: bool) -> DataFrame:
        """The comparisons of ``candidates``, dealt and sorted by bucket. With a side, only rows of sides 0 and 1 meet, or all of
        side 2. A bucket is a stream of blocks; what is open of it is a few numbers for each of its lines."""
        num, den, sided = self.num, self.den, "side" in words.columns

        @common.tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                w = common.column(batch, "w").to_numpy()
                cut = int(np.searchsorted(w, w[-1], side="left"))
                if cut == 0 and rest and common.column(rest[-1], "w")[-1].as_py() == w[-1]:
                    rest.append(batch)
                    continue
                if ready := [*rest, batch.slice(0, cut)]:
                    yield from _pairs(pa.Table.from_batches(ready).combine_chunks(), num, den, every)
                rest = [batch.slice(cut)]
            if rest:
                yield from _pairs(pa.Table.from_batches(rest).combine_chunks(), num, den, every)

        order = ["w", *(["side"] if sided else []), *(KEY if every else [])]
        return words.repartition("w").sortWithinPartitions(*order).mapInArrow(run, PAIRS)

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(id, th, ln, words) of wanted lines; only these are cut out of the texts."""

        @common.tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in common.slices(batch, "text"):
                    data, offsets = common.utf8(common.column(part, "text"))
                    lists_ = common.column(part, "lines")
                    owner = np.repeat(np.arange(part.num_rows), np.diff(lists_.offsets.to_numpy()))
                    want = np.unique((owner << 32) | lists_.flatten().to_numpy().astype(np.int64))
                    starts, ends, first = common.word_spans(data, offsets)
                    text = np.repeat(np.arange(part.num_rows), np.diff(first))
                    breaks = np.concatenate([[0], np.cumsum(data == 10)])
                    place = (text << 32) | (breaks[starts] - breaks[offsets[:-1]][text])
                    at = np.minimum(np.searchsorted(want, place), max(len(want) - 1, 0))
                    hit = want[at] == place if len(want) else np.zeros(len(place), bool)
                    if not hit.any():
                        continue
                    place, h = place[hit], common.word_hashes(data, starts[hit], ends[hit], True)
                    order = np.lexsort((h, place))
                    h, place = h[order], place[order]
                    new = np.r_[True, (h[1:] != h[:-1]) | (place[1:] != place[:-1])]
                    h, place = h[new], place[new]
                    head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                    row = place[head] >> 32
                    cols = [common.column(part, "id").to_numpy()[row], common.column(part, "th").to_numpy()[row], (place[head] & 0xFFFFFFFF).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), common.lists(h.view(np.int64), np.diff(np.r_[head, len(h)]), pa.int64())], names=["id", "th", "ln", "words"])

        small = wanted.limit(common.BROADCAST_KEYS + 1).count() <= common.BROADCAST_KEYS
        by_doc = wanted.groupBy("id", "th").agg(F.collect_list("ln").alias("lines"))
        docs = self.docs.join(F.broadcast(by_doc) if small else by_doc, ["id", "th"]).select("id", "th", "text", "lines")
        return docs.mapInArrow(run, "id bigint, th bigint, ln int, words array<bigint>")

    def matched(self, pairs: DataFrame) -> DataFrame:
        """(id, th, ln) of lines x that match their y, by the whole sets."""
        pairs = common.materialize(pairs, "pairs")
        ends = common.materialize(_as(pairs, X, KEY).union(_as(pairs, Y, KEY)).distinct(), "ends")
        sets = common.materialize(self.sets(ends), "sets")
        few = F.broadcast(pairs) if pairs.count() <= common.BROADCAST_PAIRS else pairs
        both = _as(sets, KEY, X, F.col("words").alias("x")).join(few, X).join(_as(sets, KEY, Y, F.col("words").alias("y")), Y)
        i, t = F.size(F.array_intersect("x", "y")).cast("bigint"), (F.size("x") + F.size("y")).cast("bigint")
        return common.materialize(_as(both.filter(i * self.den >= (t - i) * self.num), X, KEY).distinct(), "matched")

    def removed(self) -> DataFrame:
        """(id, th, lines): the numbers of the lines that go, of each document that loses any."""
        c = F.col
        lines = common.materialize(self.described(word_counts(self.docs)), "lines")
        same, facts = ["h1", "h2"], ["s", "b0", "b1", "b2", "b3", "prefix"]

        def words(rows: DataFrame, *more: str) -> DataFrame:
            return rows.select(*KEY, "s", "b0", "b1", "b2", "b3", *more, F.posexplode("prefix").alias("p", "w"))

        firsts = lines.groupBy(*same).agg(F.min(F.struct(*KEY)).alias("f"), *[F.first(x).alias(x) for x in facts]).select("f.*", "h1", *facts)
        firsts = common.materialize(firsts, "first-lines")
        zero, xor = F.lit(0).cast("bigint"), lambda *k: reduce(Column.bitwiseXOR, [c(f"b{i}") for i in k])
        tiers = {"b0": (xor(0, 1, 2, 3), xor(0, 2), c("b0")), "b1": (zero, xor(1, 3), c("b1")), "b2": (zero, zero, c("b2")), "b3": (zero, zero, c("b3"))}
        slim = firsts.withColumns({k: F.when(c("s") <= WIDE[0], v[0]).when(c("s") <= WIDE[1], v[1]).otherwise(v[2]) for k, v in tiers.items()})
        some = firsts.filter(F.pmod("h1", F.lit(SAMPLE)) == 0).select(F.explode("prefix").alias("w"))
        near = self.nearest(slim, some).groupBy(*X).agg(F.min(F.struct("apart", *Y)).alias("m"), F.max("more").alias("more"), F.min(F.struct(*Y)).alias("lo"), F.max(F.struct(*Y)).alias("hi"))
        near = common.materialize(near.select(*X, *[c(f"m.{y}").alias(y) for y in Y], (c("more") | (c("lo") != c("hi"))).alias("more")), "nearest")
        gone = self.matched(near.select(*X, *Y))

        open_ = common.materialize(_as(near.filter("more").join(_as(gone, KEY, X), X, "left_anti"), X, KEY), "open-lines")
        n = open_.count()
        if n:
            hint = F.broadcast if n <= common.BROADCAST_KEYS else (lambda x: x)  # counted
            probes = firsts.join(hint(open_), KEY, "left_semi")
            keys = words(probes).groupBy("w").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.max(F.struct(*KEY)).alias("last"))
            keys = common.materialize(keys, "open-words")
            small = keys.limit(common.BROADCAST_KEYS + 1).count() <= common.BROADCAST_KEYS
            rows, open_words = words(firsts), (F.broadcast(keys) if small else keys)
            fits = (c("s") * self.den >= c("lo") * self.num) & (c("hi") * self.den >= c("s") * self.num) & (F.struct(*KEY) <= c("last"))
            some = rows.join(open_words, (rows["w"] == open_words["w"]) & fits, "left_semi")
            some = some.join(hint(open_.withColumn("probe", F.lit(True))), KEY, "left").withColumn("probe", F.coalesce("probe", F.lit(False)))
            some = common.materialize(some.select("w", *KEY, "s", "p", "b0", "b1", "b2", "b3", "probe"), "open-rows")
            all_ = self.candidates(some, True, some.filter(F.pmod(F.xxhash64(*KEY), F.lit(SAMPLE)) == 0)).select(*X, *Y).distinct()
            gone = gone.union(self.matched(all_.join(near.select(*X, *Y), [*X, *Y], "left_anti")))

        later = lines.select(*KEY).join(firsts.select(*KEY), KEY, "left_anti").union(gone.distinct())
        return later.groupBy("id", "th").agg(F.collect_list("ln").alias("lines"))


def _as(df: DataFrame, old: list[str], new: list[str], *more: Column) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in zip(old, new)], *more)


def _told_apart(docs: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Sets th to 0 where an id has one text alone, so that a hash travels only where it tells texts apart."""
    several = common.materialize(docs.groupBy("id").agg(F.min("th").alias("a"), F.max("th").alias("b")).filter("a <> b").select("id"), "several-texts")
    n = several.limit(common.BROADCAST_KEYS + 1).count()
    if not n:
        return lambda df: df.withColumn("th", F.lit(0).cast("bigint"))
    flags = several.withColumn("_several", F.lit(True))
    flags = F.broadcast(flags) if n <= common.BROADCAST_KEYS else flags

    def narrow(df: DataFrame) -> DataFrame:
        th = F.when(F.col("_several"), F.col("th")).otherwise(F.lit(0)).cast("bigint")
        return df.join(flags, "id", "left").withColumn("th", th).select(*df.columns)

    return narrow


def _one_each(docs: DataFrame) -> DataFrame:
    """One of each rows that are equal in id and text."""
    several = common.materialize(docs.groupBy("id", "th").count().filter("count > 1").select("id", "th"), "repeated-rows")
    if several.isEmpty():
        return docs
    keys = F.broadcast(several) if several.limit(common.BROADCAST_KEYS + 1).count() <= common.BROADCAST_KEYS else several
    one = docs.join(keys, ["id", "th"], "left_semi").groupBy("id", "th").agg(F.first("text").alias("text"))
    return docs.join(keys, ["id", "th"], "left_anti").select("id", "th", "text").unionByName(common.materialize(one, "single-rows"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 80, den: int = 100, min_tokens: int = ALL) -> DataFrame:
    """The input's columns, the text without the lines that go, and `lines_kept` and `lines_removed`, which replace columns of these names."""
    th = F.xxhash64(F.col(text))
    docs = df.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NULL_ID)).alias("id"), th.alias("th"), F.col(text).alias("text"))
    narrow = _told_apart(docs)
    gone = common.materialize(Lines(_one_each(narrow(docs)), num, den, min_tokens).removed(), "removed-lines")
    rest = [c for c in df.columns if c != text and c not in ("lines_kept", "lines_removed")]
    names = [f"c{i}" for i in range(len(rest))]
    plain = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names)], F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NULL_ID)).alias("id"), th.alias("th"), F.col(text).alias("text"))
    plain = narrow(plain)
    fields = plain.select(*names).schema.fields

    @common.tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in common.slices(batch, "text"):
                col = common.column(part, "text")
                (data, offs), null = common.utf8(col), col.is_null().to_numpy(zero_copy_only=False)
                raw, offs = data.tobytes(), offs.tolist()
                blobs = [None if gone else z.compress(raw[a:b]) for gone, a, b in zip(null.tolist(), offs, offs[1:])]
                yield common.appended(part, [*names, "id", "th"], {"blob": pa.array(blobs, pa.binary())})

    @common.tidy
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[tuple[bytes | None, int, int]] = []
                for blob, lines in zip(common.column(part, "blob").to_pylist(), common.column(part, "lines").to_pylist()):
                    if blob is None:
                        out.append((None, 0, 0))
                        continue
                    body = z.decompress(blob)
                    if not lines:
                        out.append((body, body.count(b"\n") + 1, 0))
                        continue
                    drop = set(lines)
                    all_ = body.split(b"\n")
                    kept = [x for i, x in enumerate(all_) if i not in drop]
                    out.append((b"\n".join(kept), len(kept), len(all_) - len(kept)))
                t, k, r = zip(*out)
                yield common.appended(part, names, {"text": pa.array(t, pa.binary()).cast(pa.string()), "kept": pa.array(k, pa.int64()), "removed": pa.array(r, pa.int64())})

    few = gone.limit(common.BROADCAST_KEYS + 1).count() <= common.BROADCAST_KEYS
    keys = F.broadcast(gone.select("id", "th"))  # only if few
    some = plain.join(keys, ["id", "th"], "left_semi").select(*plain.columns) if few else plain
    packed = some.mapInArrow(pack, T.StructType([*fields, T.StructField("id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("blob", T.BinaryType())]))
    joined = packed.join(gone, ["id", "th"], "left").select(*names, "blob", "lines")
    done = joined.mapInArrow(unpack, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("kept", T.LongType()), T.StructField("removed", T.LongType())]))
    if few:  # the others need no join
        rest_ = plain.join(keys, ["id", "th"], "left_anti")
        n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint")
        done = done.unionByName(rest_.select(*names, "text", n_lines.alias("kept"), F.lit(0).cast("bigint").alias("removed")))
    back = {c: F.col(n).alias(c) for c, n in zip(rest, names)} | {text: F.col("text").alias(text)}
    return done.select(*[back[c] for c in df.columns if c in back], F.col("kept").alias("lines_kept"), F.col("removed").alias("lines_removed"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"), min_tokens=ALL)
    return done.select("doc_id", "lines_kept", "lines_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
