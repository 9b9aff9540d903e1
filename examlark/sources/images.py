"""Image columns: size, grey range, near-white test and crop box of PNG, BMP and GIF or JPEG headers, without an imaging library."""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlark.functions.scalars import IMAGE_SUFFIXES, suffix

X = TypeVar("X")


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).filter(suffix("path").isin(*IMAGE_SUFFIXES))


def size(b: bytes) -> tuple[int, int] | None:
    """Width and height, or None."""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack_from(">II", b, 16)
        if b[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack_from("<HH", b, 6)
        if b[:2] == b"BM":
            w, h = struct.unpack_from("<ii", b, 18)
            return w, abs(h)
        if b[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(b) and b[at] == 0xFF:
                if 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack_from(">HH", b, at + 5)
                    return w, h
                at += 2 + struct.unpack_from(">H", b, at + 2)[0]
    except struct.error:
        pass
    return None


def pixels(b: bytes) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Grey pixels of an 8-bit PNG (grey, colour or palette, not interlaced) or 24-bit BMP, and their alpha, if they have one. None if unreadable."""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            w, h, depth, kind, _, _, lace = struct.unpack_from(">IIBBBBB", b, 16)
            channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
            if depth != 8 or lace or channels is None:
                return None, None
            at, data, palette = 8, b"", b""
            while at + 12 <= len(b):
                n, name = struct.unpack_from(">I", b, at)[0], b[at + 4 : at + 8]
                data += b[at + 8 : at + 8 + n] if name == b"IDAT" else b""
                palette = b[at + 8 : at + 8 + n] if name == b"PLTE" else palette
                at += 12 + n
            raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * channels)
            out = np.zeros((h, w * channels), np.uint8)
            for y in range(h):
                out[y] = _unfilter(raw[y, 0], raw[y, 1:], out[y - 1] if y else np.zeros(w * channels, np.uint8), channels)
            px = out.reshape(h, w, channels).astype(np.float64)
            if kind == 3:
                px = np.frombuffer(palette, np.uint8).reshape(-1, 3)[out.reshape(h, w)].astype(np.float64)
        elif b[:2] == b"BM" and struct.unpack_from("<H", b, 28)[0] == 24:
            w, h = size(b)
            first, row = struct.unpack_from("<I", b, 10)[0], (w * 3 + 3) // 4 * 4
            px = np.frombuffer(b, np.uint8, row * h, first).reshape(h, row)[:, : w * 3].reshape(h, w, 3)[::-1, :, ::-1].astype(np.float64)
        else:
            return None, None
    except (struct.error, zlib.error, ValueError, IndexError):
        return None, None
    light = px[..., 0] if px.shape[2] < 3 else px[..., :3] @ np.array([0.299, 0.587, 0.114])
    return np.rint(light).astype(np.uint8), px[..., -1] if px.shape[2] in (2, 4) else None


def grey(b: bytes) -> np.ndarray | None:
    """Grey pixels; transparent ones are white. None if unreadable."""
    light, alpha = pixels(b)
    return light if alpha is None or light is None else np.where(alpha == 0, 255, light).astype(np.uint8)


def png(light: np.ndarray) -> bytes:
    """A grey PNG."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    h, w = light.shape
    raw = np.zeros((h, w + 1), np.uint8)
    raw[:, 1:] = light
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def _around(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """Left, top, right, bottom of what is set."""
    at = np.argwhere(mask)
    return (*map(int, at.min(axis=0)[::-1]), *map(int, at.max(axis=0)[::-1] + 1)) if len(at) else None


def crop_box(light: np.ndarray, alpha: np.ndarray | None, ink: int = 245, pad: int = 2) -> tuple[int, int, int, int]:
    """Left, top, right, bottom of the trimmed picture: first to what is not transparent, then, inside, to the ink with a margin. A picture without either stays whole."""
    h, w = light.shape
    l, t, r, b = (_around(alpha > 0) if alpha is not None else None) or (0, 0, w, h)  # noqa: E741
    box = _around(light[t:b, l:r] <= ink)
    if box is None:
        return l, t, r, b
    return l + max(box[0] - pad, 0), t + max(box[1] - pad, 0), min(l + box[2] + pad, r), min(t + box[3] + pad, b)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    out, x, up = bytearray(len(line)), line.tolist(), above.tolist()
    for i in range(len(x)):
        a, c = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            p = (a + up[i]) // 2
        else:
            e = a + up[i] - c
            p = min((a, up[i], c), key=lambda v: abs(e - v))
        out[i] = (x[i] + p) & 255
    return np.frombuffer(bytes(out), np.uint8)


#: Side of the averaged picture, and of the square of low frequencies that is hashed.
SIDE, LOW = 32, 8
#: Cosines of the transform, as whole numbers: with whole sums a hash is the same everywhere.
COSINES = np.rint(1024 * np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))).astype(np.int64)


def averaged(g: np.ndarray, side: int = SIDE) -> np.ndarray:
    """side x side means of the picture's areas in sixteenths; pixels count by what of them lies in an area, so that any size fits."""

    def shares(n: int) -> np.ndarray:
        area, pixel = np.arange(side)[:, None], np.arange(n)[None]
        return np.maximum(0, np.minimum((pixel + 1) * side, (area + 1) * n) - np.maximum(pixel * side, area * n)).astype(np.float64)

    sums = shares(g.shape[0]) @ g.astype(np.float64) @ shares(g.shape[1]).T  # whole numbers below 2 ** 53
    return np.rint(sums).astype(np.int64) * 16 // g.size


def dct_hash(g: np.ndarray | None) -> str | None:
    """64 bits as hexadecimal digits: which of the 8 x 8 lowest frequencies of the averaged picture's cosine transform are
    above the median of all but the constant one, whose bit is 0."""
    if g is None or not g.size:
        return None
    waves = (COSINES @ averaged(g) @ COSINES.T).ravel()
    bits = waves > np.sort(waves[1:])[31]
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


FIELDS = "width int, height int, bytes bigint, hash string, near_white boolean, box struct<left:int,top:int,right:int,bottom:int>, crop struct<left:int,top:int,right:int,bottom:int>, phash string"


#: Pictures whose results a task holds at once; of the pictures themselves it holds one.
SLICE = 256


def measure(files: DataFrame, near_white: int = 250, ink: int = 245, make: Callable[[pa.RecordBatch], Iterable[tuple[str, bytes]]] | None = None) -> DataFrame:
    """path, size, hash, whether nearly white (max >= t and min >= t - 10), the box of pixels <= ink, the crop, and the perceptual hash; unreadable: null or false.

    make: (path, content) of some rows of files, for pictures that are derived from a table: each is made and measured in one task, one at a time, and its
    bytes go nowhere else. Without it, files has columns path and content."""
    import hashlib

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = f"path string, {FIELDS}"
    schema = to_arrow_schema(_parse_datatype_string(kind))

    def judged(path: str, b: bytes) -> dict:
        w, h = size(b) or (None, None)
        light, alpha = pixels(b)
        g = light if alpha is None or light is None else np.where(alpha == 0, 255, light).astype(np.uint8)
        sides = ("left", "top", "right", "bottom")
        box = _around(g <= ink) if g is not None else None
        box = dict(zip(sides, box)) if box else None
        crop = dict(zip(sides, crop_box(light, alpha, ink))) if light is not None and light.size else None
        return {"path": path, "width": w, "height": h, "bytes": len(b), "hash": hashlib.sha256(b).hexdigest(), "near_white": bool(g is not None and g.size and g.max() >= near_white and g.min() >= max(0, near_white - 10)), "box": box, "crop": crop, "phash": dct_hash(g)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                if make is None:
                    made = ((path.as_py(), content.as_py()) for path, content in zip(*(c.slice(at, SLICE) for c in batch.columns[:2])))
                else:
                    made = make(batch.slice(at, SLICE))
                yield pa.RecordBatch.from_pylist([judged(path, b) for path, b in made], schema=schema)

    if make is not None:
        return files.mapInArrow(run, kind)
    return files.select("path", "content").mapInArrow(run, kind)


def retried(call: Callable[[], X], default: X | None = None, times: int = 8, wait: float = 0.35, reraise: bool = False) -> X | None:
    """A call inside a task, again after a fixed wait; then the default or the last error."""
    for i in range(times):
        try:
            return call()
        except Exception:
            if i == times - 1 and reraise:
                raise
            if i < times - 1:
                time.sleep(wait)
    return default


def copy_files(files: DataFrame, folder: str, prefix: str = "object") -> DataFrame:
    """Writes each content under a numbered name through Spark's own file system; returns path and target. files: path, content, index."""
    target = F.concat(F.lit(folder.rstrip("/") + "/"), F.format_string(f"{prefix}_%04d__%s", F.col("index").cast("int"), F.regexp_extract("path", "([^/]+)$", 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, content, to in zip(*(c.to_pylist() for c in batch.columns)):
                system, at = fs.FileSystem.from_uri(to if "://" in to else f"file://{to}")
                system.create_dir(at.rpartition("/")[0], recursive=True)
                with system.open_output_stream(at) as out:
                    out.write(content)
            yield batch.select([0, 2])

    return files.select("path", "content", target.alias("target")).mapInArrow(run, "path string, target string")
