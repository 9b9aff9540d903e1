"""File sources: folders of documents, packages (zip of XML), images. Files are read by Spark alone."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlark.functions.scalars import IMAGE_SUFFIXES, safe_stem, suffix

#: Suffixes of documents, and the body's elements that are counted.
DOCUMENT_SUFFIXES = [".doc", ".docx"]
ELEMENTS = ["object", "pict", "shape", "imagedata", "OLEObject", "oMath", "oMathPara"]
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def listing(files: DataFrame, pattern: str = "*", limit: int = 0, suffixes: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows with a path, by suffix (any case) and glob of the name, in order; limit 0 is none."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    got = files.filter(suffix("path").isin(*(suffixes or DOCUMENT_SUFFIXES)) & name.rlike(fnmatch.translate(pattern).replace("\\Z", "$").replace("\\z", "$")))
    return got.orderBy(*(order or ["path"])).limit(limit) if limit else got


def collect_documents(spark: SparkSession, folder: str, pattern: str = "*", limit: int = 0, suffixes: list[str] | None = None) -> DataFrame:
    """Files of a folder (not of its subfolders) by suffix and glob, in order of path; limit 0 is none. A missing folder raises."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    got = listing(files, limit=0, suffixes=suffixes)
    if not limit:
        return got
    first = listing(got.select("path"), "*", limit, suffixes)  # the contents are not sorted with their paths
    return got.join(F.broadcast(first) if limit <= 100_000 else first, "path", "left_semi")


PROFILE = "path string, status string, reason string, counts map<string,bigint>, media array<struct<name:string,bytes:bigint,hash:string>>, ole_count int, objects array<struct<index:int,prog_id:string,shape_id:string,image_rel_id:string>>"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def profile_package(content: bytes, samples: int = 12, visit: Callable[[ElementTree.Element, str], None] | None = None) -> dict[str, object]:
    """Element counts of the body, the first objects, and what a package embeds; visit, if given, sees every element and its name."""
    import hashlib

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted(z.namelist())
        media = [n for n in names if n.startswith("word/media/") and not n.endswith("/")]
        found = [{"name": n, "bytes": len(b := z.read(n)), "hash": hashlib.sha256(b).hexdigest()} for n in media]
        ole = sum(n.startswith("word/embeddings/") and not n.endswith("/") for n in names)
        counts, objects = dict.fromkeys(ELEMENTS, 0), []
        with z.open("word/document.xml") as body:
            for _, node in ElementTree.iterparse(body):
                name = _local(node.tag)
                if visit:
                    visit(node, name)
                if name in counts:
                    counts[name] += 1
                if name == "object" and len(objects) < samples:
                    parts = {_local(x.tag): x for x in node.iter()}
                    link, image = parts.get("OLEObject"), parts.get("imagedata")
                    objects.append({"index": len(objects) + 1, "prog_id": link.get("ProgID") if link is not None else None, "shape_id": link.get("ShapeID") if link is not None else None, "image_rel_id": image.get(_REL) if image is not None else None})
    return {"counts": list(counts.items()), "media": found, "ole_count": ole, "objects": objects}


#: Packages whose profiles a task holds at once; of the packages themselves it holds one.
SLICE = 256


def package_profiles(files: DataFrame, make: Callable[[pa.RecordBatch], Iterable[tuple[str, bytes]]] | None = None) -> DataFrame:
    """A row per package; one that cannot be read fails alone, with the reason, and others are skipped by suffix.

    make: (path, content) of some rows of files, for packages that are derived from a table: each is made and read in one task, one at a
    time, and its bytes go nowhere else. Without it, files has columns path and content."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(PROFILE))

    def profile(path: str, content: bytes) -> dict:
        row = {"path": path, "status": "success", "reason": None, "counts": None, "media": None, "ole_count": None, "objects": None}
        if not path.lower().endswith(".docx"):
            return row | {"status": "skipped", "reason": "not_docx"}
        try:
            return row | profile_package(content)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RuntimeError, NotImplementedError) as e:
            return row | {"status": "failed", "reason": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = make(part) if make else ((path.as_py(), content.as_py()) for path, content in zip(*part.columns))
                yield pa.RecordBatch.from_pylist([profile(path, content) for path, content in made], schema=schema)

    return (files if make else files.select("path", "content")).mapInArrow(run, PROFILE)


def media_entries(profiles: DataFrame, max_media: int = 80) -> DataFrame:
    """Images of each package, by name, the first max_media, numbered."""
    m = profiles.filter("status = 'success'").select("path", F.posexplode(F.filter("media", lambda x: suffix(x["name"]).isin(*IMAGE_SUFFIXES))).alias("pos", "m"))
    return m.filter(F.col("pos") < max_media).select("path", (F.col("pos") + 1).alias("index"), F.col("m.name").alias("file_name"), F.col("m.bytes").alias("bytes"), F.col("m.hash").alias("hash"))


def suffix_counts(df: DataFrame, name: str, empty: str = "<no_suffix>") -> DataFrame:
    return df.groupBy(suffix(name, empty).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


def document_summaries(profiles: DataFrame, output_root: str, number: Column | None = None) -> DataFrame:
    """The 14 fields of each document's run; profiles: document_index and the columns of ``package_profiles``.

    number: how a folder's name writes document_index; by default with four digits at least, and with all that it has."""
    done = F.col("status") == "success"
    number = F.format_string("%04d", F.col("document_index").cast("int")) if number is None else number
    folder = F.concat(F.lit(f"{output_root.rstrip('/')}/"), number, F.lit("_"), safe_stem(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)))
    images = F.filter("media", lambda x: suffix(x["name"]).isin(*IMAGE_SUFFIXES))
    count = lambda name: F.when(done, F.coalesce(F.col("counts")[name], F.lit(0))).otherwise(0).cast("int")
    return profiles.select(
        F.col("document_index").cast("int").alias("document_index"), F.col("path").alias("source_path"), suffix("path").alias("source_extension"), "status", "reason",
        F.when(done, F.col("path")).alias("normalized_docx_path"), folder.alias("document_output_dir"), F.when(done, F.concat(folder, F.lit("/assets"))).alias("asset_output_dir"), F.concat(folder, F.lit("/run.log")).alias("log_path"),
        count("shape").alias("block_count"), count("oMath").alias("omml_formula_count"), count("object").alias("legacy_object_encountered_count"),
        F.when(done, F.size(images)).otherwise(0).alias("exported_formula_object_image_count"), F.when(done, F.transform(images, lambda x: x["name"])).alias("exported_formula_object_images"),
    )


def ole_only(objects: DataFrame, prog_id: str = "prog_id", class_type: str = "class_type") -> DataFrame:
    """Objects that name a program or a class; an empty name is none."""
    return objects.filter(F.coalesce(F.nullif(F.col(prog_id), F.lit("")), F.nullif(F.col(class_type), F.lit(""))).isNotNull())
