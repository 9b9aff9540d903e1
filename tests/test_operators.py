"""Unit tests of operators: golden scenarios and edge cases."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from examlark.functions import contracts as C
from examlark.functions import scalars as S
from examlark.operators import analytics, assets, bindings, tables, versions
from examlark.sources import config, files
from examlark.streaming import events


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def stored(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, version int, status string, text string")


@pytest.mark.parametrize(
    "have,asked,best,source",
    [((8,), 8, 8, "requested"), ((1, 2), 8, 2, "highest_published"), ((7, 10), 8, 10, "highest_published"), ((9, 8), 9, 9, "requested"), ((8, 9), 10, 9, "highest_published")],
)
def test_resolve(spark, have, asked, best, source):
    v = stored(spark, *[("p", n, "published", f"t{n}") for n in have])
    r = versions.resolve(v, "key", "version", F.col("status"), F.lit(asked), ["text"]).first()
    assert (r.version, r.version_source, r.text) == (best, source, f"t{best}")


def test_resolve_status(spark):
    v = stored(spark, ("p", 1, None, "a"), ("p", 2, "draft", "b"), ("q", 3, "draft", "c"), ("q", 4, "draft", "d"), ("r", 1, "", "e"))
    got = {r.key: (r.version, r.version_source) for r in versions.resolve(v, "key", "version", F.col("status"), F.lit(9), []).collect()}
    assert got == {"p": (1, "highest_published"), "q": (4, "highest_version"), "r": (1, "highest_published")}


def test_requests_without_versions(spark):
    req = spark.createDataFrame([("p", 1), ("x", 1)], "key string, requested int")
    got = {r.key: r.version_source for r in versions.resolve_requests(req, stored(spark, ("p", 1, "published", "t")), "key", "version", "status", "text").collect()}
    assert got == {"p": "requested", "x": "version_not_found"}


@pytest.mark.parametrize("have,asked,best", [((8, 2), 10, 8), ((4,), 10, None), ((7, 10), 8, 7), ((1,), 3, 1)])
def test_bounded(spark, have, asked, best):
    r = versions.bounded_fallback(stored(spark, *[("p", n, None, "t") for n in have]), "key", "version", F.lit(asked)).first()
    assert (r.resolved if r else None) == best


@pytest.mark.parametrize("raw,n", [("v8", 8), ("V10", 10), (" V8 ", 8), ("latest", None), ("", None), (None, None), ("vv8", None), ("-1", None), ("0", None), ("3.7", None), ("99999999999", None)])
def test_parse_version(spark, raw, n):
    assert one(spark, S.parse_version(F.lit(raw))) == n


def test_render(spark):
    v = F.create_map(F.lit("a"), F.lit("{{b}}"), F.lit("b"), F.lit("X"))
    assert one(spark, S.render(F.lit("1 {{ a }} 2 {{b}} 3 {{ c }}"), v)) == "1 {{b}} 2 X 3 "
    assert one(spark, S.render(F.lit("{{ a }}"), F.expr("map()").cast("map<string,string>"))) == "{{ a }}"


@pytest.mark.parametrize("raw,out", [("a b/c.docx", "a_b_c.docx"), ("..__", "document"), ("数学 卷", "数学_卷"), ("x" * 100, "x" * 80)])
def test_safe_stem(spark, raw, out):
    assert one(spark, S.safe_stem(F.lit(raw))) == out


def test_scalars(spark):
    assert one(spark, S.safe_int(F.lit("3.7"))) is None and one(spark, S.safe_int(F.lit(" 12 "))) == 12
    assert one(spark, S.preview_text(F.lit("a　 b\n c"))) == "a b c"
    assert one(spark, S.supports_vision(F.lit(" GPT-4o "))) is True and one(spark, S.supports_vision(F.lit(None).cast("string"))) is False
    assert one(spark, S.coverage(F.lit(1), F.lit(3))) == 0.3333 and one(spark, S.coverage(F.lit(1), F.lit(0))) is None
    assert one(spark, S.sql_literal(F.lit("a'b"))) == "'a''b'"
    assert one(spark, S.expand_range(F.lit("3-5"))) == [3, 4, 5] and one(spark, S.expand_range(F.lit("x"))) == []
    assert one(spark, S.hamming(F.lit(5), F.lit(6))) == 2
    assert one(spark, S.env_flag(F.lit(" YES "))) is True
    assert one(spark, S.suffix(F.lit("a/b.PNG?x=1"))) == ".png" and one(spark, S.suffix(F.lit("a/b"))) == "<no_suffix>"


def _loop(entries, tiny, low, most):
    kept, seen, why = [], set(), []
    for i, w, h, b, hash_, gone, white in entries:
        if len(kept) >= most:
            break
        r = "missing" if gone else "tiny" if w and h and (w <= tiny or h <= tiny) else "low_bytes" if 0 < (b or 0) <= low else "near_white" if white else "duplicate_hash" if hash_ and hash_ in seen else None
        why.append((i, r))
        if r is None:
            kept.append(i)
            seen.add(hash_)
    return why


@pytest.mark.parametrize("seed,most", [(1, 3), (2, 20), (3, 200)])
def test_clean_is_the_loop(spark, seed, most):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([0, 5, 50, None]), rnd.choice([0, 50]), rnd.choice([0, 60, 500, None]), rnd.choice([None, "", "a", "b", "c", "d"]), rnd.random() < 0.1, rnd.random() < 0.1) for i in range(60)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, i int, w int, h int, b int, hash string, gone boolean, white boolean")
    got = assets.clean(df, "g", "i", "hash", assets.drop_reason(F.col("gone"), F.col("w"), F.col("h"), F.col("b"), F.col("white")), most)
    assert sorted((r.i, r.reason) for r in got.collect()) == sorted(_loop(rows, 10, 120, most))


def test_upsert_and_insert(spark):
    cur, new = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int"), spark.createDataFrame([("a", 1), ("b", 2), ("d", 4)], "k string, v int")
    got = {r.k: (r.v, r.action) for r in tables.upsert(cur, new, "k", ["v"]).collect()}
    assert got == {"a": (1, "unchanged"), "b": (2, "updated"), "c": (3, "kept"), "d": (4, "inserted")}
    ids = tables.insert(spark.createDataFrame([(7,)], "id long"), new, "id", ["k"]).orderBy("k").collect()
    assert [(r.k, r.id) for r in ids] == [("a", 8), ("b", 9), ("d", 10)]


def test_named(spark):
    p = spark.createDataFrame([(1, "One"), (2, "Two")], "provider_id long, provider_name string")
    m = spark.createDataFrame([(5, 1, "x"), (6, 2, "X"), (7, 2, "y")], "model_id long, provider_id long, model_name string")
    ask = spark.createDataFrame([(1, " one ", "X"), (2, None, "X"), (3, "two", None), (4, "two", "zz"), (5, "nobody", "x"), (6, None, None)], "request_id int, want_provider string, want_model string")
    got = {r.request_id: (r.provider_id, r.model_id) for r in bindings.resolve_named(ask, p, m).collect()}
    assert got == {1: (1, 5), 2: (1, 5), 3: (2, 6), 4: (2, None), 5: (None, None), 6: (None, None)}


def test_contracts(spark):
    corner = '{"corners":{"top_left":[0,0],"top_right":[900,10],"bottom_right":[%s],"bottom_left":[0,900]}}'
    ok = lambda js: one(spark, C.corners_ok(C.parse(F.lit(js), "page_corners")["corners"]))
    assert ok(corner % "950,980") and not ok(corner % "1950,980") and not ok("{bad") and not ok(corner % "10,20")
    assert one(spark, C.answer_card_ok(C.parse(F.lit('{"1":"A","2":"EMPTY"}'), "answer_card"))) and not one(spark, C.answer_card_ok(C.parse(F.lit('{"1":"A","3":"B"}'), "answer_card")))
    assert one(spark, C.keywords_ok(C.parse(F.lit('{"keywords":["a","b","c"]}'), "keywords"))) and not one(spark, C.keywords_ok(C.parse(F.lit("{}"), "keywords")))


def test_paths_and_sections(spark):
    n = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C")], "node string, parent string, label string")
    assert {r.node: r.path for r in analytics.paths(n, "node", "parent", "label").collect()} == {"a": "A", "b": "A/B", "c": "A/B/C"}


def _docx():
    body = '<w:document xmlns:w="w" xmlns:o="o" xmlns:v="v" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:object><v:shape><v:imagedata r:id="rId4"/></v:shape><o:OLEObject ProgID="Equation.3" ShapeID="s1"/></w:object><w:pict/></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/media/b.png", b"2")
        z.writestr("word/media/a.wmf", b"11")
        z.writestr("word/media/x.txt", b"1")
        z.writestr("word/embeddings/o.bin", b"1")
    return out.getvalue()


def test_packages(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_docx())
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.doc").write_bytes(b"old")
    (tmp_path / "d.txt").write_bytes(b"no")
    docs = files.collect_documents(spark, str(tmp_path))
    p = files.package_profiles(docs)
    got = {r.path.rsplit("/", 1)[1]: r for r in p.collect()}
    assert {k: r.status for k, r in got.items()} == {"a.docx": "success", "b.docx": "failed", "c.doc": "skipped"}
    a = got["a.docx"]
    assert a.counts["object"] == 1 and a.counts["pict"] == 1 and a.ole_count == 1 and a.objects[0].prog_id == "Equation.3" and a.objects[0].image_rel_id == "rId4"
    assert [(r["index"], r["file_name"]) for r in files.media_entries(p).orderBy("index").collect()] == [(1, "word/media/a.wmf"), (2, "word/media/b.png")]


def test_config():
    assert config.resolve_warehouse({"DATABASE_URL": " x "}) == "x" and config.resolve_warehouse({}) == "warehouse"
    with pytest.raises(RuntimeError):
        config.resolve_warehouse({"APP_ENV": "Production"})
    for env, allow, ok in [("staging", None, False), (" PROD ", None, False), ("dev", None, True), ("", None, True), ("prod", "yes", True), ("dev", "0", True), ("staging", "off", False), ("production", "1", True)]:
        given = {"APP_ENV": env} | ({} if allow is None else {"ALLOW_SQLITE_FALLBACK": allow})
        if ok:
            assert config.resolve_warehouse(given) == "warehouse"
        else:
            with pytest.raises(RuntimeError):
                config.resolve_warehouse(given)


def test_executables(tmp_path):
    (tmp_path / "tool").write_text("x")
    assert config.first_executable(None, "", "no-such-tool-here", str(tmp_path / "none"), str(tmp_path / "tool"), "sh") == str(tmp_path / "tool")
    assert config.first_executable("no-such-tool-here", "sh").endswith("/sh") and config.first_executable(None, "no-such-tool-here") is None


def test_stream(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 3.0), (3, "2024-01-01 01:10:00", "b", 5.0)], "user_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    q = events.windowed_counts(events.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.event_type, r.n) for r in spark.sql("select * from w").collect()) == [("a", 2), ("b", 1)]


def _png(rows, kind=0):
    import struct
    import zlib

    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    raw = b"".join(bytes([kind]) + bytes(r) for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    from examlark.sources import images

    (tmp_path / "in").mkdir()
    (tmp_path / "in/white.png").write_bytes(_png([[250, 255], [245, 255]]))
    (tmp_path / "in/ink.png").write_bytes(_png([[255, 255, 255], [255, 7, 255], [255, 255, 255]]))
    (tmp_path / "in/bad.png").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: r for r in images.measure(images.image_files(spark, str(tmp_path / "in"))).collect()}
    assert got["white.png"].near_white and not got["ink.png"].near_white and not got["bad.png"].near_white
    assert (got["ink.png"].width, got["ink.png"].height) == (3, 3) and got["bad.png"].width is None
    assert tuple(got["ink.png"].box) == (1, 1, 2, 2)
    for kind in (1, 2, 3, 4):  # every filter undoes itself on a decodable image
        assert images.grey(_png([[1, 2, 3], [4, 5, 6]], kind)).shape == (2, 3)
    assert images.grey(_png([[1, 2, 3]], 1)).tolist() == [[1, 3, 6]]
    files_ = images.image_files(spark, str(tmp_path / "in")).withColumn("index", F.lit(3))
    images.copy_files(files_, str(tmp_path / "out")).collect()
    assert (tmp_path / "out/object_0003__bad.png").read_bytes() == b"nothing"


def test_retry():
    from examlark.sources import images

    tries = []
    assert images.retried(lambda: tries.append(1) or 1 / 0, default=5, times=3, wait=0) == 5 and len(tries) == 3
    with pytest.raises(ZeroDivisionError):
        images.retried(lambda: 1 / 0, times=2, wait=0, reraise=True)


def test_ddl(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType(), False, {"comment": "it's"}), T.StructField("b", T.StringType())])
    spark.sql(tables.drop_ddl("ddl_t"))
    spark.sql(tables.create_ddl("ddl_t", schema))
    for q in tables.comment_ddl("ddl_t", "o'clock", {"b": "b's"}):
        spark.sql(q)
    assert {r.col_name: r.comment for r in spark.sql("DESCRIBE ddl_t").collect()} == {"a": "it's", "b": "b's"}
    spark.sql(tables.drop_ddl("ddl_t"))
    assert tables.create_order({"c": ["b"], "b": ["a"], "a": [], "x": ["y"], "y": ["x"]}) == ["a", "b", "c", "x", "y"]


def test_inactive_step_has_no_fallback(spark):
    from examlark.operators import prompts

    steps = spark.createDataFrame([("s1", "p", "v1", True), ("s2", "p", None, False), ("s3", "none", None, True)], "step_key string, prompt_key string, selected_version string, is_active boolean")
    v = spark.createDataFrame([("p", 1, "published", "one {{x}}"), ("p", 2, "draft", "two")], "prompt_key string, version int, status string, prompt_text string")
    r = prompts.resolve_steps(steps, v, F.create_map(F.lit("x"), F.lit("!"))).collect()
    assert [(x.step_key, x.resolved_version, x.version_source, x.config_source, x.prompt_text) for x in r] == [("s1", 1, "requested", "step_config", "one !")]
    r = prompts.resolve_steps(steps, v, F.create_map(F.lit("x"), F.lit("!")), F.lit("7")).first()
    assert (r.requested_version, r.resolved_version, r.version_source) == (7, 1, "highest_published")
