"""Many small files: tasks get a share of them, and files whose names are known are not listed."""

from __future__ import annotations

from examlark.plans import registry
from examlark.sources import packages as source


def test_tiny_files_are_dealt_to_several_tasks(tmp_path):
    for i in range(1500):
        (tmp_path / f"{i}.docx").write_bytes(b"x")
    parts = source._Reader({"path": str(tmp_path)}).partitions()
    assert len(parts) > 1 and sorted(p for x in parts for p in x.paths) == sorted(str(p) for p in tmp_path.iterdir())
    some = [str(tmp_path / "3.docx"), str(tmp_path / "7.docx")]
    assert list(source.contents(some)) == [(p, b"x") for p in some]


def test_export_lists_no_pictures(spark):
    plan = registry.QUERIES["package_export"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and "modificationTime" not in plan
