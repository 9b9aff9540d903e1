"""Operator 2: byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

Encoding. A text is cut into pieces by the vocabulary's pattern, a block at a time; a merge never crosses a piece.
Every piece goes through the transducer, which holds a window of its bytes. From the merge list it computes how many
bytes to the right of a token can still change it (``lookahead``): a merge (x, y) can only be undone by an earlier
merge that takes y's right end, that one only by a still earlier one, and so on, so the reach is the
heaviest chain of strictly decreasing ranks. Tokens that end that far from the window's right end are
stable: they are emitted and leave the window; where the piece ends, all are. Memory is constant, however long the piece.
Many pieces are driven at once, a step of each, with the merges of all windows as array operations; what the transducer
emitted for a short piece is remembered for the next time that it comes.

Decoding feeds the tokens' bytes to an incremental UTF-8 state machine, so a character that is split
over tokens, or over blocks of tokens, comes out whole; an ill-formed byte becomes U+FFFD.

Cases: a null or empty text has no tokens and decodes to ''; the text of a special token is that token,
as in the library's default; equal rows get equal results; other columns pass through.
"""

from __future__ import annotations

import codecs
import heapq
import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: White space beside a space.
ODD = ["  ", *(x for w in "\t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000" for x in (f" {w}", f"{w} "))]
#: Units that each of the two generations of a worker's cache holds.
CACHE = 120_000
#: Units of a text that are cut at once, and those that wait for one run of the transducer.
UNITS, WAITING = 8192, 200_000
#: Windows that are merged one by one, below.
FEW = 64
_NONE = 1 << 62
_SHIFT = 20


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.first = [vocab[c] for c, _ in sorted(symbols.items(), key=itemgetter(1))]
        self.rules: list[tuple[int, int, int]] = []
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rules.append((vocab[a], vocab[b], vocab[a + b]))
        self.ranks = {(a, b): r << _SHIFT | c for r, (a, b, c) in reversed(list(enumerate(self.rules)))}
        self.made = [c for _, _, c in self.rules]
        self._lookahead: int | None = None

    @property
    def lookahead(self) -> int:
        """Bytes to the right of a token's end that can still change the token."""
        if self._lookahead is None:
            made: dict[int, tuple[int, int]] = {}  # token: (rank of its merge, right part)
            for r, (_, b, c) in enumerate(self.rules):
                made.setdefault(c, (r, b))
            by_left: dict[int, tuple[list[int], list[int]]] = {}  # token: ranks of merges with it on the left, largest reach so far

            def reach(token: int, before: int) -> int:
                most = 0
                while True:
                    if got := by_left.get(token):
                        i = bisect_left(got[0], before)
                        most = max(most, got[1][i - 1] if i else 0)
                    if token not in made:
                        return most
                    before, token = made[token]

            for r, (a, b, _) in enumerate(self.rules):
                need = len(self.bytes[b]) + reach(b, r)
                ranks, most = by_left.setdefault(a, ([], []))
                ranks.append(r)
                most.append(max(need, most[-1] if most else 0))
            self._lookahead = max((reach(t, len(self.rules)) for t in self.bytes), default=0)
        return self._lookahead

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a window: lowest rank first, from the left."""
        ids = [self.first[b] for b in data]
        if len(ids) > 48:
            return self._merge_long(ids)
        get, made = self.ranks.get, self.made
        ranks = [get(pair, _NONE) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i] = made[best >> _SHIFT]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NONE)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if (v := self.ranks.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (v, i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            v, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = v & ((1 << _SHIFT) - 1), False, after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [t for t, live in zip(ids, alive) if live]


class Transducer:
    """Takes one piece in parts, gives its tokens as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.held = vocabulary, b""
        self.window = 2 * vocabulary.lookahead + 512

    def feed(self, data: bytes) -> Iterator[int]:
        step = self.window
        for at in range(0, len(data), step):
            self.held += data[at : at + step]
            if len(self.held) >= self.window:
                yield from self._emit(len(self.held) - self.v.lookahead)

    def finish(self) -> Iterator[int]:
        yield from self._emit(len(self.held))

    def _emit(self, stable: int) -> Iterator[int]:
        at = 0
        for t in self.v.merge(self.held):
            if at + len(self.v.bytes[t]) > stable:
                break
            at += len(self.v.bytes[t])
            yield t
        self.held = self.held[at:]


class Pairs:
    """The merges as an open-addressing table for arrays of pairs."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.base = np.int64(max(vocabulary.bytes) + 1)
        self.mask = np.int64((1 << max(4, (4 * len(vocabulary.ranks)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, -1, np.int64)
        self.values = np.full(int(self.mask) + 1, _NONE, np.int64)
        self.probes = 1
        for (a, b), v in vocabulary.ranks.items():
            key = a * int(self.base) + b
            at, n = self._slot(key), 1
            while self.keys[at] >= 0:
                at, n = (at + 1) & int(self.mask), n + 1
            self.keys[at], self.values[at], self.probes = key, v, max(self.probes, n)

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B1) >> 15) & int(self.mask)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank and product of each pair, or _NONE."""
        key = a * self.base + b
        at = ((key * np.int64(0x9E3779B1)) >> np.int64(15)) & self.mask
        found = self.keys[at]
        out = np.where(found == key, self.values[at], _NONE)
        todo = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            same = found == key[todo]
            out[todo[same]] = self.values[at[todo[same]]]
            todo = todo[~same & (found >= 0)]
        return out


class Transducers:
    """Many transducers, each on its own piece, that take a step at once: a window of bytes each, and all merges as array operations."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.pairs = vocabulary, Pairs(vocabulary)
        self.first = np.array(vocabulary.first, np.int64)
        self.window = 2 * vocabulary.lookahead + 512
        self.width = np.zeros(max(vocabulary.bytes) + 1, np.int64)
        self.width[list(vocabulary.bytes)] = [len(x) for x in vocabulary.bytes.values()]

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, number of tokens of each piece): every piece's lowest-ranked leftmost merge at once, until none is left."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        lens = np.array([len(p) for p in pieces], np.int64)
        word = np.repeat(np.arange(len(pieces)), lens)
        rank = np.full(len(ids), _NONE, np.int64)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same] = self.pairs.look(ids[same], ids[same + 1])
        while True:
            starts = np.cumsum(lens) - lens
            least = np.minimum.reduceat(rank, starts)
            at = np.flatnonzero((rank == np.repeat(least, lens)) & (rank < _NONE))
            if not len(at):
                return ids, lens
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]  # the leftmost of each piece
            ids[at] = rank[at] & ((1 << _SHIFT) - 1)
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            lens[word[at]] -= 1
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at -= np.arange(len(at))
            rank[at] = _NONE
            right = at[at + 1 < len(ids)]
            right = right[word[right] == word[right + 1]]
            rank[right] = self.pairs.look(ids[right], ids[right + 1])
            left = at[at > 0] - 1
            left = left[word[left] == word[left + 1]]
            rank[left] = self.pairs.look(ids[left], ids[left + 1])

    def merged(self, windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, number of tokens of each window); a few windows are merged one by one, which is the same and faster."""
        if len(windows) >= FEW:
            return self.merge_many(windows)
        got = [self.v.merge(w) for w in windows]
        return np.array([t for x in got for t in x], np.int64), np.array([len(x) for x in got], np.int64)

    def run(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, piece after piece; how many each has)."""
        held = [b""] * len(pieces)
        out: list[list[np.ndarray]] = [[] for _ in pieces]
        going, read = list(range(len(pieces))), 0
        while going:
            for i in going:
                held[i] += pieces[i][read : read + self.window]
            read += self.window
            flat, n = self.merged([held[i] for i in going])
            if read == self.window and all(len(p) <= read for p in pieces):
                return flat, n  # every piece has ended: all its tokens are stable
            at, on = np.cumsum(n), []
            for k, i in enumerate(going):
                tokens = flat[at[k] - n[k] : at[k]]
                if read < len(pieces[i]):
                    end = np.cumsum(self.width[tokens])
                    stable = int(np.searchsorted(end, len(held[i]) - self.v.lookahead, side="right"))
                    tokens, held[i] = tokens[:stable], held[i][int(end[stable - 1]) if stable else 0 :]
                    on.append(i)
                else:
                    held[i] = b""
                out[i].append(tokens)
            going = on
        return np.concatenate([t for x in out for t in x]) if pieces else np.zeros(0, np.int64), np.array([sum(map(len, x)) for x in out], np.int64)


class Codec:
    """Encodes texts a batch at a time through the transducer."""

    def __init__(self, path: str) -> None:
        self.vocabulary = v = Vocabulary(path)
        self.transducers = Transducers(v)
        self.pattern = regex.compile(PATTERN)
        self.split = self.pattern.findall
        special = sorted(v.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.table = [v.bytes.get(i, b"") for i in range(max(v.bytes) + 1)]
        self.cache: dict[str, bytes] = {}  # tokens as 32-bit integers
        self.old: dict[str, bytes] = {}

    def _learn(self, units: set[str]) -> None:
        """Puts the tokens of units into the cache."""
        if len(self.cache) > CACHE:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        units.difference_update(cache)
        plan: list[tuple[str, int]] = []
        pieces: list[bytes] = []
        for u in units:
            if (got := old.get(u)) is not None:
                cache[u] = got
                continue
            parts = [u] if u[1:].isalpha() and u[0] == " " else self.split(u)
            plan.append((u, len(parts)))
            pieces.extend([p.encode("utf-8") for p in parts])
        flat, lens = self.transducers.run(pieces)
        raw, ends = flat.astype(np.int32).tobytes(), (4 * np.cumsum(lens)).tolist()
        k = at = 0
        for u, n in plan:
            k += n
            cache[u] = raw[at : ends[k - 1]] if n else b""
            at = ends[k - 1] if n else at

    def blocks(self, text: str) -> Iterator[list[str]]:
        """Units that pieces do not cross, some at a time: ' word' between single spaces, or else the pieces themselves."""
        if not text:
            return
        if text[0] == " " or text[-1] == " " or any(x in text for x in ODD):  # pieces may cross a space
            found = (m.group() for m in self.pattern.finditer(text))
            while some := list(islice(found, UNITS)):
                yield some
            return
        at = 0
        while at < len(text):
            to = text.find(" ", at + 4 * UNITS)
            to = len(text) if to < 0 else to
            first, *rest = text[at:to].split(" ")
            yield [*([first] if first else ()), *[" " + w for w in rest]]
            at = to

    def parts(self, text: str) -> Iterator[list[str] | int]:
        """Blocks of units, and special tokens between them."""
        if not self.special or not self.special.search(text):
            yield from self.blocks(text)
            return
        at = 0
        for m in self.special.finditer(text):
            yield from self.blocks(text[at : m.start()])
            yield self.vocabulary.special[m.group()]
            at = m.end()
        yield from self.blocks(text[at:])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        plans: list[tuple[int, list[str] | int]] = []
        waiting = 0

        def flush() -> None:
            need = {u for _, p in plans if not isinstance(p, int) for u in p}
            self._learn(need)
            get = self.cache.__getitem__
            for i, p in plans:
                out[i].append(np.array([p], np.int32) if isinstance(p, int) else np.frombuffer(b"".join(map(get, p)), np.int32))
            for u in [u for u in need if len(u) > 64]:
                self.cache.pop(u, None)
            plans.clear()

        for i, text in enumerate(texts):
            for part in self.parts(text):
                plans.append((i, part))
                waiting += 1 if isinstance(part, int) else len(part)
                if waiting >= WAITING:
                    flush()
                    waiting = 0
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: Iterable[int], block: int = 4096) -> str:
        machine, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        get = self.table.__getitem__
        for at in range(0, len(ids), block):
            out.append(machine.decode(b"".join(map(get, ids[at : at + block]))))
        out.append(machine.decode(b"", final=True))
        return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """The kept columns and token_ids array<int>; with ``decoded`` also what these ids decode to, in the same pass."""
    path = path or default_path()

    def fn(col: pa.Array) -> dict[str, pa.Array]:
        c = codec(path)
        got = c.encode_batch([t or "" for t in col.to_pylist()])
        flat = np.concatenate(got) if got else np.zeros(0, np.int32)
        out = {"token_ids": common.lists(flat, np.array([len(x) for x in got], np.int64), pa.int32())}
        return out | {"decoded": pa.array([c.decode(x) for x in got], pa.string())} if decoded else out

    def forget() -> None:  # the worker may do something else next
        c = codec(path)
        c.cache, c.old = {}, {}

    return common.map_appending(df, keep, text, "token_ids array<int>" + ", decoded string" * decoded, fn, forget)


def decode(df: DataFrame, keep: list[str], ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """The kept columns and decoded string."""
    path = path or default_path()
    from pyspark.sql import types as T

    keep = [k for k in keep if k.lower() != "decoded"]  # gives way to the new one
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                col = common.column(part, ids)
                flat, off = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
                text = [c.decode(flat[off[i] : off[i + 1]]) for i in range(part.num_rows)]
                yield common.appended(part, keep, {"decoded": pa.array(text, pa.string())})

    return df.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode(docs, ["doc_id"], decoded=True)
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
