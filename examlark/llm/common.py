"""Shared helpers: shared-folder tables, size-checked broadcasts, vectorised text hashing."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest number of 8-byte keys that is broadcast; beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000
#: Largest number of pairs that is broadcast.
BROADCAST_PAIRS = 500_000
#: Text bytes that the vectorised functions take at once (a longer text goes alone).
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where it is unset, on a local master."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = getattr(spark.sparkContext, "_examlark_dir", None)
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="examlark-")
            spark.sparkContext._examlark_dir = at
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder, read back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/examlark/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi (anti) join on a key; the ids are broadcast only if they are counted and few enough."""
    small = ids.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(ids) if small else ids, key, how)


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def appended(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The kept columns of a batch, then new ones."""
    return pa.RecordBatch.from_arrays([column(batch, k) for k in keep] + list(new.values()), names=keep + list(new))


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Python workers live on between tasks: at a task's end, what it has freed goes back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return run


def map_appending(
    df: DataFrame, keep: list[str], text: str, new: str, fn: Callable[[pa.Array], dict[str, pa.Array]], done: Callable[[], None] | None = None, most: int = CHUNK_BYTES
) -> DataFrame:
    """mapInArrow that keeps some columns and appends what fn makes of the text column, a slice of rows of about ``most`` bytes of text at a time; done ends a task.

    A kept column that has the name of a new one (in whatever case) gives way to it."""
    made = T._parse_datatype_string(new).fields
    names = {f.name.lower() for f in made}
    keep = [k for k in keep if k.lower() not in names]
    read = [F.col(f"`{k}`") for k in keep]
    schema = T.StructType([f for f in df.select(*read).schema.fields] + made)
    src = df.select(*read) if text in keep else df.select(*read, text)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, most):
                yield appended(part, keep, fn(column(part, text)))
        if done:
            done()

    return src.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where its text passes a number of bytes, so that work arrays stay small."""
    if batch.num_rows == 0:
        return
    _, offsets = utf8(column(batch, text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if not wide and not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    offs, data = col.buffers()[1:]
    if offs is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> _S30)) * _C1
    x = (x ^ (x >> _S27)) * _C2
    return x ^ (x >> _S31)


def byte_table(is_word: Callable[[int], bool]) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], bool)


#: [^\x20\x09-\x0D]
NOT_SPACE = byte_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_spans(data: np.ndarray, offsets: np.ndarray, table_: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (byte positions), and the first word of each text (one more entry at the end)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = table_[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG_WORD = 1024


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time for all words at once."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data] if lower else data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))  # the eight bytes from any place on
    lens = ends - starts
    h = mix((eight[starts] & _MASKS[np.minimum(lens, 8)]) ^ (lens.astype(np.uint64) * _BASE))
    rest, at = np.flatnonzero((lens > 8) & (lens <= _LONG_WORD)), 8
    while len(rest):
        h[rest] = mix(h[rest] * _BASE + (eight[starts[rest] + at] & _MASKS[np.minimum(lens[rest] - at, 8)]))
        at += 8
        rest = rest[lens[rest] > at]
    for i in np.flatnonzero(lens > _LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (len - n + 1 of them; texts are not told apart)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * _BASE + words[i : i + m]
    return mix(out)


def rolling_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """As gram_hashes, in time that does not grow with n."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    size = 1
    level = words
    out, at = None, 0
    rest, power = n, np.array([_BASE])
    # doubling: level holds hashes of `size` words
    while rest:
        if rest & 1:
            piece = level[at : at + m]
            out = piece if out is None else out * power + piece
            at += size
        rest >>= 1
        if rest:
            level = level[: len(level) - size] * power + level[size:]
            level = mix(level)
            size *= 2
            power = power * _BASE + np.uint64(2)
    return mix(out)


def inside_one_text(first_word: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, text index) of the n-word windows that lie in one text."""
    counts = np.maximum(np.diff(first_word) - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first_word[:-1], counts)
    return pos, text


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column from flat values and lengths."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
