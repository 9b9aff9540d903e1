"""Operator 6: media columns by signature sniffing.

``store`` keeps a payload losslessly as 8-bit samples in a container (WAV, BMP or PGM). ``sniff`` finds
magic bytes with one Aho-Corasick pass, lets a validator of each format confirm structure and length,
corrects the declared type with what validates at the first byte, and carves whatever media validates
inside. ``payload_of`` reads the samples back from the place that the validator found.

Cases: a null or empty text is 64 bytes of 0; equal texts give equal values; magic bytes whose structure
does not validate are no media; embedded media lie inside the samples and may not overlap one another
(the first, then the longest, wins).
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

BLOCK = 64
#: (length, first sample, number of samples); the samples are empty for formats that are only recognised
Found = tuple[int, int, int] | None


def _wav(b: bytes, at: int) -> Found:
    if b[at + 8 : at + 12] != b"WAVE" or at + 12 > len(b):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    pos, fmt = at + 12, False
    while pos + 8 <= end:
        name, size = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        if pos + 8 + size > end:
            return None
        if name == b"fmt " and size >= 16:
            kind, channels, rate, byte_rate, align, bits = struct.unpack_from("<HHIIHH", b, pos + 8)
            fmt = kind == 1 and channels == 1 and bits == 8 and align == 1 and byte_rate == rate
        elif name == b"data":
            return (end - at, pos + 8 - at, size) if fmt else None
        pos += 8 + size + (size & 1)
    return None


def _bmp(b: bytes, at: int) -> Found:
    if at + 54 > len(b):
        return None
    size, _, first, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if header != 40 or planes != 1 or bits != 8 or packed or width <= 0 or width % 4 or height >= 0 or first < 54 or size != first - height * width or at + size > len(b):
        return None
    return size, first, -height * width


def _pgm(b: bytes, at: int) -> Found:
    parts, pos = [], at + 2
    while len(parts) < 3:
        if pos >= len(b) or b[pos] not in b" \t\r\n":
            return None
        while pos < len(b) and b[pos] in b" \t\r\n":
            pos += 1
        start = pos
        while pos < len(b) and 48 <= b[pos] <= 57 and pos - start < 10:
            pos += 1
        if pos == start:
            return None
        parts.append(int(b[start:pos]))
    n = parts[0] * parts[1]
    if parts[2] != 255 or n == 0 or pos >= len(b) or b[pos] not in b" \t\r\n" or pos + 1 + n > len(b):
        return None
    return pos + 1 + n - at, pos + 1 - at, n


def _png(b: bytes, at: int) -> Found:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, name = struct.unpack_from(">I", b, pos)[0], b[pos + 4 : pos + 8]
        if pos + 12 + size > len(b) or (first and name != b"IHDR") or zlib.crc32(b[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", b, pos + 8 + size)[0]:
            return None
        pos, first = pos + 12 + size, False
        if name == b"IEND":
            return pos - at, 0, 0
    return None


@lru_cache(maxsize=2)
def _gif_ends(b: bytes) -> dict[int, int]:
    return {}


@lru_cache(maxsize=2)
def _gif_chains(b: bytes) -> dict[int, int]:
    return {}


def _gif_chain(b: bytes, pos: int) -> int:
    """Where the chain of data blocks at a place ends."""
    ends, seen = _gif_chains(b), []
    while pos not in ends and pos < len(b) and b[pos]:
        seen.append(pos)
        pos += b[pos] + 1
    end = ends.get(pos, pos + 1)
    ends.update(dict.fromkeys(seen, end))
    return end


def _gif(b: bytes, at: int) -> Found:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    ends, seen = _gif_ends(b), []  # candidates whose blocks meet go on together: no block is read twice
    while pos not in ends:
        seen.append(pos)
        if pos >= len(b):
            end = -1
        elif b[pos] == 0x3B:
            end = pos + 1
        elif b[pos] == 0x21:
            pos = _gif_chain(b, pos + 2)
            continue
        elif b[pos] == 0x2C and pos + 10 < len(b):
            local = b[pos + 9]
            pos = _gif_chain(b, pos + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
            continue
        else:
            end = -1
        ends[pos] = end
    ends.update(dict.fromkeys(seen, ends[pos]))
    return (ends[pos] - at, 0, 0) if ends[pos] >= 0 else None


def _jpeg(b: bytes, at: int) -> Found:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        if b[pos + 1] == 0xDA:
            end = _next(b, b"\xff\xd9", pos)
            return (end + 2 - at, 0, 0) if end is not None else None
        size = struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2 or not 0xC0 <= b[pos + 1] <= 0xFE:
            return None
        pos += 2 + size
    return None


@lru_cache(maxsize=8)
def _places(b: bytes, what: bytes) -> list[int]:
    return [m.start() for m in re.finditer(re.escape(what), b)]


def _next(b: bytes, what: bytes, at: int) -> int | None:
    """The first place of a mark from one on; a text is searched once for all its candidates."""
    places = _places(b, what)
    i = bisect_left(places, at)
    return places[i] if i < len(places) else None


def _pdf(b: bytes, at: int) -> Found:
    if not b[at + 5 : at + 6].isdigit():
        return None
    end, xref = _next(b, b"%%EOF", at), _next(b, b"startxref", at)
    return (end + 5 - at, 0, 0) if end is not None and xref is not None and xref < end else None


def _gzip(b: bytes, at: int) -> Found:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    d = zlib.decompressobj(31)
    try:
        pos = at
        while not d.eof and pos < len(b):
            d.decompress(b[pos : pos + 65536], 1 << 20)
            while d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
            pos += 65536
    except zlib.error:
        return None
    return (min(pos, len(b)) - len(d.unused_data) - at, 0, 0) if d.eof else None


#: Magic bytes, their types and validators.
SIGNATURES: list[tuple[bytes, str, Callable[[bytes, int], Found]]] = [
    (b"RIFF", "wav", _wav),
    (b"BM", "bmp", _bmp),
    (b"P5", "pgm", _pgm),
    (b"\x89PNG\r\n\x1a\n", "png", _png),
    (b"GIF87a", "gif", _gif),
    (b"GIF89a", "gif", _gif),
    (b"\xff\xd8\xff", "jpeg", _jpeg),
    (b"%PDF-", "pdf", _pdf),
    (b"\x1f\x8b\x08", "gzip", _gzip),
]
_automaton: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for i, (magic, _, _) in enumerate(SIGNATURES):
            _automaton.add_word(magic.decode("latin-1"), i)
        _automaton.make_automaton()
    return _automaton


def payload(text: str | None) -> bytes:
    b = (text or "").encode("utf-8")
    return b + bytes(-len(b) % BLOCK if b else BLOCK)


def store(data: bytes, kind: str) -> bytes:
    """The payload as 8-bit samples: sound, or rows of 64 grey pixels."""
    if kind == "wav":
        body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(data)) + data
        return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body
    if kind == "bmp":
        palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
        first = 54 + len(palette)
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", first + len(data), 0, first, 40, BLOCK, -(len(data) // BLOCK), 1, 8, 0, len(data), 2835, 2835, 256, 0) + palette + data
    if kind == "pgm":
        return f"P5\n{BLOCK} {len(data) // BLOCK}\n255\n".encode() + data
    raise ValueError(kind)


def kind_for(data: bytes) -> str:
    return ("wav", "bmp", "pgm")[zlib.crc32(data) % 3]


def sniff(media: bytes) -> tuple[str, Found, list[tuple[str, int, int]]]:
    """(true type, what its validator found, embedded media as (type, offset, length))."""
    hits: list[tuple[str, int, Found]] = []
    for end, i in automaton().iter(media.decode("latin-1")):
        magic, kind, valid = SIGNATURES[i]
        at = end + 1 - len(magic)
        if found := valid(media, at):
            hits.append((kind, at, found))
    whole = next(((k, f) for k, at, f in hits if at == 0), ("application/octet-stream", None))
    inside, until = [], 1
    for kind, at, found in sorted(hits, key=lambda h: (h[1], -h[2][0])):
        if at >= until and at > 0:
            inside.append((kind, at, found[0]))
            until = at + found[0]
    return *whole, inside


def payload_of(media: bytes) -> bytes:
    _, found, _ = sniff(media)
    return media[found[1] : found[1] + found[2]] if found else b""


def columns(text: str | None, declared: str = "wav") -> dict[str, object]:
    """Store, sniff, read back and describe one text."""
    data = payload(text)
    media = store(data, kind_for(data))
    kind, found, inside = sniff(media)
    back = media[found[1] : found[1] + found[2]] if found else b""
    samples = np.frombuffer(back, np.uint8)
    hist = np.bincount(samples >> 5, minlength=8)
    step = int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64)) if len(samples) > 1 else 0
    feature = f"{declared}>{kind};n={len(back)};sum={int(samples.sum(dtype=np.int64))};step={step};hist={','.join(map(str, hist.tolist()))};embedded={','.join(f'{k}@{o}+{n}' for k, o, n in inside)}"
    return {
        "n_bytes": len((text or "").encode("utf-8")), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-BLOCK:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature,
    }


def to_media(df: DataFrame, keep: list[str], text: str = "text", declared: str = "wav") -> DataFrame:
    """The kept columns, media binary and its declared type."""

    def fn(col: pa.Array) -> dict[str, pa.Array]:
        made = [store(d, kind_for(d)) for d in map(payload, col.to_pylist())]
        return {"media": pa.array(made, pa.binary()), "declared": pa.array([declared] * len(made))}

    return common.map_appending(df, keep, text, "media binary, declared string", fn)


FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(df: DataFrame, keep: list[str], text: str = "text", declared: str = "wav") -> DataFrame:
    """The kept columns and the digest of each text's media column."""

    def fn(col: pa.Array) -> dict[str, pa.Array]:
        rows = [columns(t, declared) for t in col.to_pylist()]
        return {(n := f.split()[0]): pa.array([r[n] for r in rows], pa.string() if f.endswith("string") else pa.int64()) for f in FIELDS.split(", ")}

    return common.map_appending(df, keep, text, FIELDS, fn)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(common.table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
