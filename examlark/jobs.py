"""Runs from the command line: options with their defaults, a chain of jobs with exit codes, logs of runs and documents.

    python -m examlark.jobs batch --input-dir folder [--output-root folder] [--limit 0] [--pattern '*']
    python -m examlark.jobs pipeline --input-dir folder [--workspace-dir folder] [...]
    python -m examlark.jobs probe file.docx [--modes raw,clean] [...]
    python -m examlark.jobs export file.docx [...]

The pipeline is two steps that meet in a folder: ``preprocess`` writes a bundle of slices and options, ``analyse`` reads it alone.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlark.functions.scalars import coverage, suffix
from examlark.operators import assets
from examlark.operators.tables import modes_of, numbered, write_document, write_summary, write_text
from examlark.sources import files, images, packages
from examlark.sources.config import cut

log = logging.getLogger("examlark")
#: Options of the pipeline that may be left out, and the choices of two of them.
OPTIONAL = ["workspace-dir", "student-id", "exam-id", "paper-id", "subject", "grade", "class-id", "organization-id", "provider", "model", "api-key", "prompt-version", "classification-method", "a3-strategy", "answer-card-provider", "answer-card-model"]
CHOICES = {"classification-method": ["single_page", "long_image"], "a3-strategy": ["split", "whole", "both"]}
#: Strategies of the probe, and its and the exporter's numbers.
MODES = ["raw", "clean", "picture", "object", "hybrid"]
PROBE = {"max-media": 80, "max-items": 2000, "tiny-px": 10, "low-bytes": 120, "near-white-threshold": 250}
EXPORTER = {"dpi": 1200, "max-omaths": 12, "max-inline-ole": 12, "max-metafiles": 20}


def options(arguments: Sequence[str] | None = None) -> argparse.Namespace:
    """The options of a command; those that are empty count as left out."""
    top = argparse.ArgumentParser(prog="examlark")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("pipeline")
    p.add_argument("--input-dir", required=True)
    for name in OPTIONAL:
        p.add_argument(f"--{name}", choices=CHOICES.get(name))
    b = commands.add_parser("batch")
    b.add_argument("--input-dir", default="knowledge_base")
    b.add_argument("--output-root")
    b.add_argument("--limit", type=int, default=0)
    b.add_argument("--pattern", default="*")
    q = commands.add_parser("probe")
    q.add_argument("docx_path")
    q.add_argument("--output-dir", default="probe_output")
    q.add_argument("--modes", type=lambda text: modes_of(text, MODES), default=list(MODES))
    e = commands.add_parser("export")
    e.add_argument("docx_path")
    e.add_argument("--output-dir", default="export_output")
    e.add_argument("--include-floating-shapes", action="store_true")
    e.add_argument("--max-html-images", type=int)
    for parser, numbers in ((q, PROBE), (e, EXPORTER)):
        for name, value in numbers.items():
            parser.add_argument(f"--{name}", type=int, default=value)
    got = top.parse_args(arguments)
    for k, v in vars(got).items():
        if v == "":
            setattr(got, k, None)
    if got.command == "export" and got.max_html_images is not None:  # an older name of the same
        got.max_metafiles = got.max_html_images
    return got


def slices_of(strategy: str | None) -> list[str]:
    """What a strategy for large pages makes: both is the union of the two others."""
    return ["split", "whole"] if strategy == "both" else [strategy or "split"]


def chain(jobs: Sequence[tuple[str, Callable[[], int | None]]]) -> int:
    """Runs jobs one after the other; the first exit code that is not 0 ends the chain and is its own. An error is 1."""
    for name, job in jobs:
        log.info("start %s", name)
        try:
            code = job() or 0
        except Exception:
            log.exception("%s failed", name)
            return 1
        if code:
            log.error("%s ended with %d", name, code)
            return code
    return 0


def logged(path: Path, level: int = logging.INFO) -> logging.Handler:
    """A log file beside the console's; the caller takes it off again."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handler = logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.setLevel(level)
    log.addHandler(handler)
    return handler


def batch(spark: SparkSession, input_dir: str, output_root: str, limit: int = 0, pattern: str = "*") -> int:
    """Profiles the documents of a folder; writes every document's summary and log line, each in one table, and the run's counts as one document."""
    found = files.collect_documents(spark, input_dir, pattern, limit)
    profiles = numbered(files.package_profiles(found), ["path"], "document_index")
    done = files.document_summaries(profiles, output_root)
    write_summary(done, f"{output_root}/documents")
    kept = spark.read.schema(done.schema).json(f"{output_root}/documents")
    kept.select("document_index", F.format_string("%s %s %s", "source_path", "status", F.coalesce("reason", F.lit(""))).alias("line")).write.mode("overwrite").json(f"{output_root}/logs")
    counts = kept.agg(F.count(F.lit(1)).alias("document_count"), *[F.count_if(F.col("status") == s).alias(f"processed_{s}_count") for s in ("success", "skipped", "failed")], F.coalesce(F.sum("legacy_object_encountered_count"), F.lit(0)).alias("legacy_object_total"), F.coalesce(F.sum("exported_formula_object_image_count"), F.lit(0)).alias("exported_formula_object_image_total"))
    summary = cut(counts.withColumns({"input_dir": F.lit(input_dir), "output_root": F.lit(output_root)}))
    write_document(summary, f"{output_root}/run_summary.json")
    row = summary.first()
    log.info("%s", row.asDict())
    return 0 if row.document_count else 2


# the pipeline -------------------------------------------------------------------------------------

#: Options that name the learner, the paper and the class, and go with every row of a bundle.
CONTEXT = ["student-id", "exam-id", "paper-id", "subject", "grade", "class-id", "organization-id"]


def preprocess(spark: SparkSession, input_dir: str, bundle: str, given: Mapping[str, str | None] | None = None) -> int:
    """Writes a bundle: the slices of every picture of a folder, in order of path, and the options.

    A picture wider than high is a large page: ``a3-strategy`` split makes its two halves, whole itself, both all three. With the
    classification method long_image the slices of a folder's pictures are one group, else each is its own.
    A key is never written; empty options are left out. Without pictures the code is 2."""
    given = {k: v for k, v in (given or {}).items() if v and k != "api-key"}
    found = images.image_files(spark, input_dir)
    m = numbered(images.measure(found).select("path", "width", "height", "hash"), ["path"], "page")
    box = lambda a, b: F.struct(F.lit(a[0]).alias("name"), a[1].cast("int").alias("left"), b.cast("int").alias("right"))
    w = F.col("width")
    halves, whole = [box(("left", F.lit(0)), F.floor(w / 2)), box(("right", F.floor(w / 2)), w)], [box(("whole", F.lit(0)), w)]
    wanted = [x for kind in slices_of(given.get("a3-strategy")) for x in (halves if kind == "split" else whole)]
    cuts = F.when(w > F.col("height"), F.array(*wanted)).otherwise(F.array(*whole))
    group = F.lit(1).cast("bigint") if given.get("classification-method") == "long_image" else F.col("page")
    context = [F.lit(given.get(name)).cast("string").alias(name.replace("-", "_")) for name in CONTEXT]
    rows = m.withColumn("group", group).select("page", "group", "path", "hash", "height", F.posexplode(cuts).alias("slice", "cut"), *context)
    rows.select("page", "group", "slice", "path", "hash", F.col("cut.name").alias("name"), F.col("cut.left").alias("left"), F.col("cut.right").alias("right"), "height", *[name.replace("-", "_") for name in CONTEXT]).write.mode("overwrite").parquet(f"{bundle}/slices")
    n = spark.read.parquet(f"{bundle}/slices").count()
    write_text(json.dumps({"options": given, "slices": n}, ensure_ascii=False, indent=2), f"{bundle}/bundle.json")
    log.info("%d slices in %s", n, bundle)
    return 0 if n else 2


def analyse(spark: SparkSession, bundle: str, output: str) -> int:
    """Reads a bundle alone, and writes a report: pages, groups, slices by name, distinct pictures, and the options that led to it."""
    about = json.loads(spark.read.text(f"{bundle}/bundle.json", wholetext=True).first()["value"])
    rows = spark.read.parquet(f"{bundle}/slices")
    if rows.count() != about["slices"]:
        log.error("the bundle has %d slices, and should have %d", rows.count(), about["slices"])
        return 3
    one = rows.agg(F.count_distinct("page").alias("pages"), F.count_distinct("group").alias("groups"), F.count_distinct("hash").alias("pictures")).first()
    names = {r["name"]: r["n"] for r in rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}  # three names
    write_text(json.dumps({**one.asDict(), "slices": dict(sorted(names.items())), "options": about["options"]}, ensure_ascii=False, indent=2), f"{output}/report.json")
    log.info("%s", one.asDict())
    return 0


def pipeline(spark: SparkSession, input_dir: str, workspace: str, given: Mapping[str, str | None] | None = None) -> int:
    return chain([("preprocess", lambda: preprocess(spark, input_dir, f"{workspace}/preprocessor_output", given)), ("analyse", lambda: analyse(spark, f"{workspace}/preprocessor_output", f"{workspace}/analyzer_output"))])


# probe and export ---------------------------------------------------------------------------------


def probe(spark: SparkSession, docx: str, output: str, modes: Sequence[str], max_media: int = 80, max_items: int = 2000, tiny_px: int = 10, low_bytes: int = 120, near_white_threshold: int = 250) -> DataFrame:
    """A row for each strategy: what it keeps of a package's pictures, and how well.

    raw: all, by name, ``max_media`` at most. clean: those that no rule drops (missing, tiny, of few bytes, nearly white, a repeated
    hash). picture: those that are no metafile; object: metafiles, which old formula objects leave. hybrid: clean ones, then pictures not among them.
    Each keeps ``max_items`` at most. A strategy's pictures are written below its name."""
    folder, name = docx.rpartition("/")[0] or ".", docx.rpartition("/")[2]
    folder = folder if "://" in folder else str(Path(folder).resolve())
    read = packages.read(spark, folder, members="word/*", content=True, pattern=name)
    media = read.filter(F.col("member").startswith("word/media/") & suffix("member").isin(*files.IMAGE_SUFFIXES)).select(F.col("member").alias("path"), "content", "hash")
    measured = images.measure(media, near_white=near_white_threshold).drop("hash").join(media.select("path", "hash"), "path")
    raw = cut(numbered(measured, ["path"], "place").filter(F.col("place") <= max_media).withColumn("doc", F.lit(name)))
    reason = assets.drop_reason(F.lit(False), F.col("width"), F.col("height"), F.col("bytes"), F.col("near_white"), tiny_px, low_bytes)
    clean = assets.clean(raw, "doc", "place", "hash", reason, max_items).filter("reason IS NULL").select(raw.columns)
    metafile = suffix("path").isin(".wmf", ".emf")
    picture, object_ = raw.filter(~metafile), raw.filter(metafile)
    made = {"raw": raw, "clean": clean, "picture": picture, "object": object_, "hybrid": None}
    if "hybrid" in modes:
        keep = lambda df: df.select("place", "hash", "path")
        made["hybrid"] = assets.hybrid_union(keep(clean), keep(picture), "place", "hash", max_items, max_items).join(raw.drop("hash", "path"), "place")
    rows, wanted = [], raw.count()
    for mode in modes:
        began = time.time()
        got = made[mode].orderBy("place").limit(max_items)
        content = got.select("path", "place").join(media.select("path", "content"), "path")
        exported = packages.export_media(content.select(F.lit(docx).alias("path"), F.lit("success").alias("status"), F.col("path").alias("member"), "content"), f"{output}/{mode}", most=max_items, prefix=mode)
        n = exported.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("output_hash").alias("distinct_hashes")).first()
        rows.append((mode, n["n"], n["distinct_hashes"], round(time.time() - began, 2)))
    compared = spark.createDataFrame(rows, "mode string, n bigint, distinct_hashes bigint, elapsed_seconds double")
    return compared.withColumn("coverage_ratio", coverage(F.col("n"), F.lit(wanted)))


def export(spark: SparkSession, docx: str, output: str, max_omaths: int = 12, max_inline_ole: int = 12, max_metafiles: int = 20, include_floating_shapes: bool = False, dpi: int = 1200) -> DataFrame:
    """(kind, found, exported, exported_path): what a package has of each kind, and how many of it the limits let through.

    omath and inline_ole are counted in the body, floating shapes only if they are asked for; metafiles are written out as they are, as no
    renderer is at hand (dpi is kept for one)."""
    folder, name = docx.rpartition("/")[0] or ".", docx.rpartition("/")[2]
    body = files.package_profiles(files.collect_documents(spark, folder, name))
    counts = body.select(*[F.coalesce(F.col("counts")[k], F.lit(0)).alias(k) for k in ("oMath", "object", "pict")]).first()
    if counts is None:
        raise FileNotFoundError(docx)
    folder = folder if "://" in folder else str(Path(folder).resolve())
    media = packages.read(spark, folder, members="word/media/*", content=True, pattern=name).filter(suffix("member").isin(".wmf", ".emf"))
    written = packages.export_media(media, f"{output}/metafiles", most=max_metafiles, prefix="metafile").count()
    rows = [("omath", counts["oMath"], min(counts["oMath"], max_omaths), None), ("inline_ole", counts["object"], min(counts["object"], max_inline_ole), None), ("metafile", media.count(), written, f"{output}/metafiles")]
    if include_floating_shapes:
        rows.append(("floating_shape", counts["pict"], counts["pict"], None))
    return spark.createDataFrame([(*r, dpi) for r in rows], "kind string, found bigint, exported bigint, exported_path string, dpi int")


def main(arguments: Sequence[str] | None = None) -> int:
    """Runs a command; its log goes to the console and to run.log beside its output."""
    got = options(arguments)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO)
    spark = SparkSession.builder.appName("examlark").getOrCreate()
    if got.command == "pipeline":
        out = got.workspace_dir or f"temp_workspace/run_{time.strftime('%Y%m%d_%H%M%S')}"
    else:
        out = (got.output_root or "output") if got.command == "batch" else got.output_dir
    out = out if "://" in out else str(Path(out).resolve())
    handler = logged(Path(out.removeprefix("file://")) / "run.log") if "://" not in out or out.startswith("file://") else None
    try:
        if got.command == "batch":
            return chain([("profile", lambda: batch(spark, got.input_dir, out, got.limit, got.pattern))])
        if got.command == "pipeline":
            return pipeline(spark, got.input_dir, out, {name: getattr(got, name.replace("-", "_")) for name in OPTIONAL if name != "workspace-dir"})
        if got.command == "probe":
            numbers = {name.replace("-", "_"): getattr(got, name.replace("-", "_")) for name in PROBE}
            return chain([("probe", lambda: write_summary(probe(spark, got.docx_path, out, got.modes, **numbers), f"{out}/comparison"))])
        limits = {k: getattr(got, k) for k in ("max_omaths", "max_inline_ole", "max_metafiles", "include_floating_shapes", "dpi")}
        return chain([("export", lambda: write_summary(export(spark, got.docx_path, out, **limits), f"{out}/exports"))])
    finally:
        if handler:
            log.removeHandler(handler)
            handler.close()


if __name__ == "__main__":
    sys.exit(main())
