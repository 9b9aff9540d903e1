"""Packages as a source, extractors, relations, stages of a stream."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from examlark.operators import relations
from examlark.sources import extract, images
from examlark.sources import packages as source
from examlark.streaming import stages

# packages -------------------------------------------------------------------------------------------


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            z.writestr(name, content)
    return out.getvalue()


@pytest.fixture
def folder(spark, tmp_path):
    from examlark.plans.packages import _bmp, _png
    import numpy as np

    px = np.full((3, 4), 255, np.uint8)
    px[1, 1] = 0
    made = [
        ("a.docx", _zip([("word/document.xml", "<d/>"), ("word/media/b.PNG", _png(px[:, :, None], 0, [1])), ("word/media/a.bmp", _bmp(px)), ("word/media/c.wmf", b"meta"), ("word/media/n.txt", b"x"), ("word/media/sub/", b"")])),
        ("b.docx", b"broken"), ("c.doc", b"old"), ("e.docx", _zip([])), ("big.docx", _zip([("x.bin", bytes(5_000_000))])),
    ]
    assert source.write_packages(spark.createDataFrame(made, "name string, content binary"), str(tmp_path / "in")) == 5
    (tmp_path / "in" / "inner").mkdir()
    (tmp_path / "in" / "inner" / "f.docx").write_bytes(_zip([("y", b"1")]))
    return tmp_path


def test_packages_by_member(spark, folder):
    rows = source.read(spark, str(folder / "in")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert sorted(by) == ["a.docx", "b.docx", "big.docx", "c.doc"]  # an empty package has no member; inner folders are not read
    assert [r.member for r in sorted(by["a.docx"], key=lambda r: r.position)] == ["word/document.xml", "word/media/a.bmp", "word/media/b.PNG", "word/media/c.wmf", "word/media/n.txt"]
    assert by["b.docx"][0].status == "failed" and "BadZipFile" in by["b.docx"][0].reason and by["c.doc"][0].status == "skipped"
    assert by["big.docx"][0].bytes == 5_000_000 and by["big.docx"][0].compressed < 10_000 and all(r.content is None for r in rows)
    few = source.read(spark, str(folder / "in"), members="word/media/*", content=True, pattern="a*").collect()
    assert {r.member.rsplit("/", 1)[1]: bytes(r.content) for r in few}["n.txt"] == b"x" and len(few) == 4
    for bad in ("nowhere", "in/a.docx"):
        with pytest.raises(Exception, match="is no folder"):
            source.read(spark, str(folder / bad)).collect()


def test_media_are_normalised_and_numbered(spark, folder):
    out = source.export_media(source.read(spark, str(folder / "in"), members="word/media/*", content=True), str(folder / "out"), most=2).collect()
    got = {(r["index"], r.source_name, r.source_suffix, r.normalized_suffix, r.output_path.rsplit("/", 2)[1:] == ["a", f"current_000{r['index']}.png"]) for r in out}
    assert got == {(1, "word/media/a.bmp", ".bmp", ".png", True), (2, "word/media/b.PNG", ".png", ".png", True)}
    assert len({r.output_hash for r in out}) == 1  # one picture in two formats
    assert images.grey((folder / "out/a/current_0002.png").read_bytes()).tolist()[1] == [255, 0, 255, 255]
    every = source.export_media(source.read(spark, str(folder / "in"), members="word/media/*", content=True), str(folder / "all")).collect()
    assert {r.normalized_suffix for r in every} == {".png", ".wmf"} and (folder / "all/a/current_0003.wmf").read_bytes() == b"meta"


# extractors -----------------------------------------------------------------------------------------


def test_extractors_have_their_own_schemas(spark):
    df = spark.createDataFrame([(1, '<div><a href="/x">a</a><br><A HREF="http://y&amp;z">b</A><script>var a="<p>"</script></div>'), (2, None), (3, ""), (4, "one two\n\nthree")], "id int, html string")
    links = extract.extract(df, "links", "html")
    assert links.columns == ["id", "html", "position", "href", "is_absolute"]
    assert [(r.id, r.position, r.href, r.is_absolute) for r in links.orderBy("id", "position").collect()] == [(1, 1, "/x", False), (1, 2, "http://y&z", True)]
    assert {(r.element, r.n, r.deepest) for r in extract.extract(df.filter("id = 1"), "elements", "html").collect()} == {("div", 1, 1), ("a", 2, 2), ("br", 1, 2), ("script", 1, 2)}
    assert [(r.number, r.words) for r in extract.extract(df.filter("id = 4"), "paragraphs", "html").orderBy("number").collect()] == [(1, 2), (2, 1)]
    with pytest.raises(Exception, match="an extractor's name is one of"):
        extract.extract(df, "nothing", "html").schema


def test_extractors_in_sql_and_of_ones_own(spark):
    class Lengths(extract.Extractor):
        schema = "n int, error string"

        def rows(self, content):
            yield len(content) if content != "bad" else 1 // 0, None

        def on_error(self, error):
            yield None, type(error).__name__

    extract.register(spark, {"lengths": Lengths}, "extract_test")
    spark.createDataFrame([(1, "abc"), (2, "bad")], "id int, t string").createOrReplaceTempView("extract_docs")
    got = spark.sql("SELECT d.id, x.n, x.error FROM extract_docs d, LATERAL extract_test('lengths', d.t) x").collect()
    assert {tuple(r) for r in got} == {(1, 3, None), (2, None, "ZeroDivisionError")}


# relations ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed,nodes,edges", [(1, 12, 14), (2, 30, 25), (3, 8, 20), (4, 5, 0)])
def test_relations(spark, seed, nodes, edges):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(edges)] + ([(0, 0)] if seed == 3 else [])
    df = spark.createDataFrame([*pairs, *pairs[:3], (None, 1), (1, None)], "source int, target int")
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    want = {}
    for a in after:
        now, n = {a}, 0
        while now:
            n += 1
            now = {y for x in now for y in after.get(x, ()) if (a, y) not in want}
            want |= {(a, y): n for y in now}
    reach = relations.closure(df)
    assert {(r.source, r.target): r.distance for r in reach.collect()} == want and reach.count() == len(want)
    assert {(r.source, r.target) for r in relations.closure(df, most=2).collect()} == {k for k, n in want.items() if n <= 2}
    rings = {r.node: (r.length, r.cycle) for r in relations.cycles(reach).collect()}
    assert rings == {x: (want[x, x], min(y for (s, y) in want if s == x and (y, x) in want)) for x in after if (x, x) in want}
    bad = set(rings) | {t for s, t in want if s in rings}

    def level(x):
        return max((1 + level(a) for a, b in pairs if b == x), default=0)

    assert {r.node: r.level for r in relations.levels(df).collect()} == {x: None if x in bad else level(x) for p in pairs for x in p}


# stages ---------------------------------------------------------------------------------------------


def test_stages_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rnd = random.Random(5)
    base = 1_700_000_000
    rows = []
    for i in range(60):
        start = base + rnd.randrange(0, 3000)
        if i % 7:
            rows.append((f"j{i % 20}", f"s{i}", "start", start))
        if i % 5:
            rows.append((f"j{i % 20}", f"s{i}", "finish", start + rnd.choice([1, 30, 599, 600, 601, 900])))
        if i % 11 == 0:  # again, later
            rows.append((f"j{i % 20}", f"s{i}", "start", start + 40))
    rnd.shuffle(rows)
    as_df = lambda part: spark.createDataFrame(part, "job string, stage string, kind string, at long").select("job", "stage", "kind", F.timestamp_seconds("at").alias("ts"))
    want = {tuple(r) for r in stages.stages(as_df(rows), 600).collect()}
    assert {r[2] for r in want} == {"done", "timeout", "orphan"}
    flush = [[("end", "end", "start", base + 20_000)], [("end", "end2", "other", base), ("end", "end3", "start", base + 30_000)]]
    for i, part in enumerate([rows[: len(rows) // 2], rows[len(rows) // 2 :], *flush]):
        as_df(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(as_df(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stages.stage_stream(stream, 600, "2 hours").writeStream.format("memory").queryName("stage_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [tuple(r) for r in spark.sql("select * from stage_rows where job <> 'end'").collect()]
    assert len(got) == len(set(got)) and set(got) == want


# relational -----------------------------------------------------------------------------------------


def test_tables_of_a_database(spark, tmp_path):
    from examlark.sources import relational

    rows = [(i, f"name {i % 7}", i * 0.5 if i % 3 else None) for i in range(1, 501)]
    df = spark.createDataFrame(rows, "id int, name string, points double")
    df.write.parquet(str(tmp_path / "w/answers.parquet"))
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    relational.write_jdbc(df.repartition(2), url, "answers", options={"createTableColumnTypes": "name VARCHAR(64)"})
    env = {"DATABASE_URL": f" {url} "}
    got = relational.table(spark, "answers", env, by="id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, relational.table(spark, "answers", {"DATABASE_URL": str(tmp_path / "w")}).collect())) == rows
    cut = relational.read_jdbc(spark, url, "answers", by="id", rows=100)
    assert cut.rdd.getNumPartitions() == 5 and sorted(map(tuple, cut.collect())) == rows
    some = cut.filter("id > 490 AND name = 'name 1'").select("id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(" in plan and "EqualTo(" in plan and "ReadSchema: struct<id" in plan.replace("ID", "id").replace("Id", "id") and "POINTS" not in plan.upper().split("READSCHEMA")[1]
    assert sorted(r[0] for r in some.collect()) == [i for i in range(491, 501) if i % 7 == 1]
    relational.write_jdbc(df.filter("false"), url, "nothing")
    assert relational.read_jdbc(spark, url, "nothing", by="id").count() == 0
