"""The command line, job chains, numbering in slices, and deep trees."""

from __future__ import annotations

import logging

import pytest

from examlark import jobs
from examlark.operators import analytics, tables
from examlark.plans.packages import _package


def test_options():
    got = jobs.options(["pipeline", "--input-dir", "in", "--exam-id", "", "--a3-strategy", "both"])
    assert got.input_dir == "in" and got.exam_id is None and jobs.slices_of(got.a3_strategy) == ["split", "whole"] and len(jobs.OPTIONAL) == 16
    got = jobs.options(["probe", "a.docx"])
    assert (got.modes, got.max_media, got.max_items, got.tiny_px, got.low_bytes, got.near_white_threshold) == (jobs.MODES, 80, 2000, 10, 120, 250)
    got = jobs.options(["export", "a.docx", "--max-html-images", "7"])
    assert (got.max_metafiles, got.dpi, got.max_omaths, got.include_floating_shapes) == (7, 1200, 12, False)
    for bad in (["pipeline"], ["pipeline", "--input-dir", "x", "--a3-strategy", "none"], ["probe", "a", "--modes", "raw,odd"]):
        with pytest.raises(SystemExit):
            jobs.options(bad)
    assert tables.modes_of(" , ", ["a", "b"]) == ["a", "b"]


def test_chain():
    ran = []
    ok = lambda name, code: (name, lambda: (ran.append(name), code)[1])
    assert jobs.chain([ok("a", 0), ok("b", None)]) == 0 and jobs.chain([ok("c", 3), ok("d", 0)]) == 3 and ran == ["a", "b", "c"]
    assert jobs.chain([("e", lambda: 1 / 0), ok("f", 0)]) == 1 and ran[-1] == "c"


def test_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"d{i}.docx").write_bytes(_package(i, "a\nb"))
    (tmp_path / "in" / "x.doc").write_bytes(b"old")
    (tmp_path / "in" / "y.txt").write_text("no")
    handler = jobs.logged(tmp_path / "out" / "run.log")
    try:
        assert jobs.batch(spark, str(tmp_path / "in"), str(tmp_path / "out")) == 0
    finally:
        logging.getLogger("examlark").removeHandler(handler)
    s = spark.read.json(str(tmp_path / "out" / "run_summary.json"), multiLine=True).first()
    assert (s.document_count, s.processed_success_count, s.processed_skipped_count, s.processed_failed_count, s.legacy_object_total) == (6, 5, 1, 0, 10)
    docs = spark.read.json(str(tmp_path / "out" / "documents")).orderBy("document_index").collect()
    assert [d.document_index for d in docs] == [1, 2, 3, 4, 5, 6] and docs[0].source_path.endswith("d0.docx") and docs[5].reason == "not_docx"
    assert "document_count" in (tmp_path / "out" / "run.log").read_text() and sorted(r.document_index for r in spark.read.json(str(tmp_path / "out" / "logs")).collect()) == [1, 2, 3, 4, 5, 6]


def test_numbers_over_slices(spark):
    df = spark.range(70_000).selectExpr("(id * 7919) % 70000 AS k", "cast(id % 10 AS string) AS s")
    got = tables.numbered(df, ["s", "k"], "n", slices=8)
    rows = sorted((r.s, r.k, r.n) for r in got.collect())
    assert [n for _, _, n in rows] == list(range(1, 70_001))


def test_deep_trees(spark):
    n = [(i, i - 1 if i else None, str(i)) for i in range(100)] + [(200, 201, "x"), (201, 200, "y")]
    chain = spark.createDataFrame(n[:100], "node int, parent int, label string")
    got = {r.node: (r.path, r.depth) for r in analytics.paths(chain, "node", "parent", "label").collect()}
    assert got[99] == ("/".join(map(str, range(100))), 99) and len(got) == 100
    with pytest.raises(ValueError):
        analytics.paths(spark.createDataFrame(n[100:], "node int, parent int, label string"), "node", "parent", "label", depth=8)


def _pictures(folder):
    import numpy as np

    from examlark.plans.packages import _png

    folder.mkdir()
    for name, w, h in (("b.png", 8, 4), ("a.png", 3, 9), ("c.png", 6, 5)):
        (folder / name).write_bytes(_png(np.full((h, w, 1), len(name) + w, np.uint8), 0, [0]))
    (folder / "n.txt").write_text("no")


@pytest.mark.parametrize("strategy,method,names,groups", [(None, None, {"left": 2, "right": 2, "whole": 1}, 3), ("whole", "long_image", {"whole": 3}, 1), ("both", "single_page", {"left": 2, "right": 2, "whole": 3}, 3)])
def test_pipeline_hands_over(spark, tmp_path, strategy, method, names, groups):
    _pictures(tmp_path / "in")
    call = ["pipeline", "--input-dir", str(tmp_path / "in"), "--workspace-dir", str(tmp_path / "w"), "--exam-id", "e1", "--api-key", "secret"]
    call += ["--a3-strategy", strategy] * bool(strategy) + ["--classification-method", method] * bool(method)
    assert jobs.main(call) == 0
    import json

    report = json.loads((tmp_path / "w/analyzer_output/report.json").read_text())
    assert report["slices"] == names and (report["pages"], report["groups"], report["pictures"]) == (3, groups, 3) and report["options"]["exam-id"] == "e1" and "api-key" not in report["options"]
    rows = spark.read.parquet(str(tmp_path / "w/preprocessor_output/slices")).orderBy("page", "slice").collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows if r.name in ("left", "whole")][0] == "a.png" and {r.exam_id for r in rows} == {"e1"} and {r.student_id for r in rows} == {None}
    assert all((r.left, r.right) in {(0, 4), (4, 8), (0, 3), (3, 6), (0, 8), (0, 6)} for r in rows)
    assert "secret" not in (tmp_path / "w/preprocessor_output/bundle.json").read_text() and "start analyse" in (tmp_path / "w/run.log").read_text()
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.png").write_bytes(b"no picture")
    assert jobs.analyse(spark, str(tmp_path / "w/preprocessor_output"), str(tmp_path / "again")) == 0
    spark.read.parquet(str(tmp_path / "w/preprocessor_output/slices")).limit(1).write.parquet(str(tmp_path / "bad/slices"))
    (tmp_path / "bad/bundle.json").write_text((tmp_path / "w/preprocessor_output/bundle.json").read_text())
    assert jobs.analyse(spark, str(tmp_path / "bad"), str(tmp_path / "again")) == 3


def _with_media(path):
    import io
    import zipfile

    import numpy as np

    from examlark.plans.packages import _bmp, _png

    rng = np.random.default_rng(1)
    big = rng.integers(0, 200, (40, 50)).astype(np.uint8)
    white = np.full((40, 50), 255, np.uint8)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<d><oMath/><oMath/><object/><pict/></d>")
        for name, content in (("a.png", _png(big[:, :, None], 0, [1])), ("b.bmp", _bmp(big)), ("c.png", _png(big[:, :, None], 0, [1])), ("d.png", _png(big[:5, :, None], 0, [0])), ("e.bmp", _bmp(white)), ("f.wmf", b"metafile" * 40), ("g.emf", b"x")):
            z.writestr(f"word/media/{name}", content)
    path.write_bytes(out.getvalue())


def test_probe_and_export(spark, tmp_path):
    _with_media(tmp_path / "t.docx")
    assert jobs.main(["probe", str(tmp_path / "t.docx"), "--output-dir", str(tmp_path / "p")]) == 0
    got = {r["mode"]: (r.n, r.distinct_hashes, r.coverage_ratio) for r in spark.read.json(str(tmp_path / "p/comparison")).collect()}
    # tiny: d; white: e; few bytes: g; repeated: c
    assert got["raw"][0] == 7 and got["clean"][0] == 3 and got["picture"][0] == 5 and got["object"][0] == 2 and got["hybrid"][0] == 5 and got["raw"][2] == 1.0
    assert sorted(f.name for f in (tmp_path / "p/clean/t").iterdir()) == ["clean_0001.png", "clean_0002.png", "clean_0003.wmf"]
    few = jobs.probe(spark, str(tmp_path / "t.docx"), str(tmp_path / "q"), ["raw", "clean"], max_media=3, max_items=1, tiny_px=0)
    assert {r["mode"]: r.n for r in few.collect()} == {"raw": 1, "clean": 1}
    assert jobs.main(["export", str(tmp_path / "t.docx"), "--output-dir", str(tmp_path / "x"), "--max-html-images", "1", "--max-omaths", "1", "--include-floating-shapes"]) == 0
    rows = {r.kind: (r.found, r.exported) for r in spark.read.json(str(tmp_path / "x/exports")).collect()}
    assert rows == {"omath": (2, 1), "inline_ole": (1, 1), "metafile": (2, 1), "floating_shape": (1, 1)} and [f.name for f in (tmp_path / "x/metafiles/t").iterdir()] == ["metafile_0001.wmf"]
