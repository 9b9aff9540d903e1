"""Packages (zips of XML and media) as a Spark data source: ``spark.read.format("packages").load(folder)``.

A partition is a file, or several small ones. A task reads a package's central directory, then single members by their
ranges, one at a time: neither a package nor all of its media are held whole. Rows are members, not packages; a file that is no package has one
row with its reason, so that it fails alone.

Folders are any that pyarrow's file systems reach (local and shared mounts, object stores, HDFS). Names are listed on the driver,
contents are read by tasks.
"""

from __future__ import annotations

import fnmatch
import hashlib
import io
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import ArrowInvalid, NativeFile, fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from examlark.functions.scalars import IMAGE_SUFFIXES, suffix
from examlark.sources import images

SCHEMA = "path string, status string, reason string, member string, position int, bytes bigint, compressed bigint, offset bigint, hash string, content binary"
#: Bytes of packages that one task takes, if they are small.
TASK_BYTES = 64 << 20
#: What opening a file counts for at least, so that a task does not get tens of thousands of tiny ones.
OPEN_BYTES = 64 << 10


@dataclass
class Files(InputPartition):
    paths: list[str]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


class _File:
    """An open file whose bad seeks are errors of the system, as a zip's reader expects."""

    def __init__(self, raw: NativeFile) -> None:
        self.raw, self.read, self.tell, self.close = raw, raw.read, raw.tell, raw.close

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            return self.raw.seek(at, whence)
        except ArrowInvalid as e:
            raise OSError(str(e)) from e


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.pattern = options["path"].rstrip("/"), options.get("pattern", "*")
        self.members, self.content = options.get("members", "*"), options.get("content", "false").lower() == "true"
        self.suffixes = tuple(options.get("suffixes", ".docx").lower().split(","))

    def partitions(self) -> list[InputPartition]:
        """Files in order of their names, small ones together; a missing folder, or one that is a file, is an error."""
        system, at = _open(self.folder)
        info = system.get_file_info(at)
        if info.type != fs.FileType.Directory:
            raise FileNotFoundError(f"{self.folder} is no folder")
        found = sorted((f.path, f.size or 0) for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern))
        out: list[Files] = []
        size = TASK_BYTES
        for path, n in found:
            n = max(n, OPEN_BYTES)
            if size + n > TASK_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _open(self.folder)
        for path in partition.paths:
            if not path.lower().endswith(self.suffixes):
                yield (path, "skipped", "no package by its suffix", None, None, None, None, None, None, None)
                continue
            try:
                with system.open_input_file(path) as raw, zipfile.ZipFile(_File(raw)) as z:
                    yield from self._members(path, z)
            except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError) as e:
                yield (path, "failed", f"{type(e).__name__}: {e}", None, None, None, None, None, None, None)

    def _members(self, path: str, z: zipfile.ZipFile) -> Iterator[tuple]:
        for k, m in enumerate(sorted((m for m in z.infolist() if not m.is_dir()), key=lambda m: m.filename)):
            if not fnmatch.fnmatchcase(m.filename, self.members):
                continue
            digest, kept = hashlib.sha256(), io.BytesIO()
            with z.open(m) as stream:  # decompressed a block at a time
                while block := stream.read(1 << 20):
                    digest.update(block)
                    if self.content:
                        kept.write(block)
            yield (path, "success", None, m.filename, k, m.file_size, m.compress_size, m.header_offset, digest.hexdigest(), kept.getvalue() if self.content else None)


class Packages(DataSource):
    """Options: path, pattern (of files), suffixes, members (a glob of names), content (true: with bytes)."""

    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, folder: str, members: str = "*", content: bool = False, pattern: str = "*") -> DataFrame:
    spark.dataSource.register(Packages)
    return spark.read.format("packages").option("members", members).option("content", str(content).lower()).option("pattern", pattern).load(folder)


def normalized(content: bytes, ending: str) -> tuple[bytes, str]:
    """A picture as a grey PNG with its transparency flattened; what cannot be read stays as it is."""
    light = images.grey(content)
    return (images.png(light), ".png") if light is not None and light.size else (content, ending.lower() or ".bin")


def export_media(packages: DataFrame, folder: str, most: int = 80, prefix: str = "current") -> DataFrame:
    """Writes each package's pictures, normalised, to a folder of its own under numbered names, the first ``most`` by name; returns
    path, index, source_name, source_suffix, normalized_suffix, output_path, output_hash.

    packages: of ``read`` with content. Every picture is written by one task, which writes the same bytes if it runs again."""
    name = F.regexp_extract("member", "([^/]+)$", 1)
    media = packages.filter((F.col("status") == "success") & F.col("member").startswith("word/media/") & suffix("member").isin(*IMAGE_SUFFIXES))
    # numbered by names alone, whose rows are small
    place = F.row_number().over(Window.partitionBy("path").orderBy("member")).alias("index")
    numbers = media.select("path", "member", place).filter(F.col("index") <= most)
    kept = media.select("path", "member", "content").join(numbers, ["path", "member"])
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    out = kept.select("path", "index", "member", suffix("member", ".bin").alias("source_suffix"), "content", F.concat(F.lit(folder.rstrip("/") + "/"), stem, F.lit("/")).alias("at"))

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, index, member, ending, content, at in zip(*(c.to_pylist() for c in batch.columns)):
                blob, new = normalized(content, ending)
                target = f"{at}{prefix}_{index:04d}{new}"
                system, place = _open(target)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                with system.open_output_stream(place) as stream:
                    stream.write(blob)
                rows.append((path, index, member, ending, new, target, hashlib.sha256(blob).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int32(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "index", "source_name", "source_suffix", "normalized_suffix", "output_path", "output_hash"])

    return out.mapInArrow(write, "path string, index int, source_name string, source_suffix string, normalized_suffix string, output_path string, output_hash string")


def contents(paths: Iterable[str]) -> Iterator[tuple[str, bytes]]:
    """(path, content) of files whose names are known, one at a time; nothing is listed."""
    for path in paths:
        system, at = _open(path)
        with system.open_input_file(at) as f:
            yield path, f.read()


def write_packages(made: DataFrame, folder: str) -> int:
    """Writes rows of (name, content) as files of a folder, by tasks; how many there are."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        there = set()
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                system, at = _open(f"{folder.rstrip('/')}/{name}")
                if (parent := at.rpartition("/")[0]) not in there:
                    system.create_dir(parent, recursive=True)
                    there.add(parent)
                with system.open_output_stream(at) as stream:
                    stream.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return made.select("name", "content").mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

