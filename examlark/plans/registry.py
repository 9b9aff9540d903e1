"""Named queries over the driver's tables, each with the same query in DuckDB SQL where SQL can express it.

The tables stand in for the engine's own: conversations for template versions, supplier and nation for providers and
models, documents for entries, stems and retrieval documents, events for attempts, benchmark for exam questions,
orders and lineitem for sessions and questions, region > nation > customer for the taxonomy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlark.functions import contracts as C
from examlark.functions import scalars as S
from examlark.operators import analytics as A
from examlark.operators import assets, bindings, matching, prompts, retrieval, tables, trees, versions
from examlark.plans import packages  # noqa: F401  its queries register themselves
from examlark.plans.base import ORACLE_SQL, QUERIES, query
from examlark.sources import extract, files
from examlark.sources.config import scan
from examlark.streaming import events as stream

def _versions(s: SparkSession, d: str) -> DataFrame:
    c = scan(s, d, "conversations", ["conv_id", "turn", "role", "text"])
    return c.select("conv_id", (F.col("turn") + 1).alias("version"), F.when(F.col("role") == "assistant", "published").otherwise("draft").alias("status"), "text")


V = "(SELECT conv_id, turn + 1 AS version, CASE WHEN role = 'assistant' THEN 'published' ELSE 'draft' END AS status, text FROM conversations)"


# versions -----------------------------------------------------------------------------------------


@query(f"""SELECT conv_id, version, CASE WHEN version = 3 THEN 'requested' WHEN status = 'published' THEN 'highest_published' ELSE 'highest_version' END AS version_source, text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY version = 3 DESC, status = 'published' DESC, version DESC, text DESC) AS rn FROM {V}) WHERE rn = 1""")
def version_resolve(s: SparkSession, d: str) -> DataFrame:
    return versions.resolve(_versions(s, d), "conv_id", "version", F.col("status"), F.lit(3), ["text"])


@query(f"""SELECT r.conv_id, r.requested, v.version AS resolved, CASE WHEN v.version IS NULL THEN 'version_not_found' WHEN v.version = r.requested THEN 'requested' WHEN v.status = 'published' THEN 'highest_published' ELSE 'highest_version' END AS version_source, v.text AS text
FROM (SELECT DISTINCT o_custkey AS conv_id, CAST(o_orderkey % 6 AS BIGINT) AS requested FROM orders) r
LEFT JOIN {V} v ON v.conv_id = r.conv_id
QUALIFY row_number() OVER (PARTITION BY r.conv_id, r.requested ORDER BY v.version = r.requested DESC, v.status = 'published' DESC, v.version DESC, v.text DESC) = 1""")
def version_requests(s: SparkSession, d: str) -> DataFrame:
    r = scan(s, d, "orders").select(F.col("o_custkey").alias("conv_id"), (F.col("o_orderkey") % 6).alias("requested")).distinct()
    return versions.resolve_requests(r, _versions(s, d), "conv_id", "version", "status", "text")


@query(f"SELECT conv_id, max(version) AS resolved FROM {V} WHERE version BETWEEN greatest(4 - 5, 1) AND 4 GROUP BY conv_id")
def version_bounded_fallback(s: SparkSession, d: str) -> DataFrame:
    return versions.bounded_fallback(_versions(s, d), "conv_id", "version", F.lit(4))


@query(f"SELECT conv_id, coalesce(max(CASE WHEN version = 8 THEN version END), max(version)) AS resolved FROM {V} GROUP BY conv_id")
def version_or_latest(s: SparkSession, d: str) -> DataFrame:
    return versions.exact_or_latest(_versions(s, d), "conv_id", "version", F.lit(8))


@query(f"SELECT version, count(*) AS templates, 'v' || version || ' (' || count(*) || ')' AS label FROM {V} GROUP BY version")
def version_histogram(s: SparkSession, d: str) -> DataFrame:
    return versions.histogram(_versions(s, d), "version").orderBy(F.desc("version"))


@query(f"SELECT conv_id, CAST(count(DISTINCT version) AS INTEGER) AS n_versions, array_to_string(list_transform(list_reverse_sort(list(DISTINCT version)), lambda x: x::VARCHAR), ',') AS versions, max(version) AS max_version FROM {V} GROUP BY conv_id")
def version_list(s: SparkSession, d: str) -> DataFrame:
    return versions.available(_versions(s, d), "conv_id", "version")


@query(r"""SELECT raw, CASE WHEN regexp_matches(lower(trim(raw)), '^v?[0-9]+$') THEN nullif(CAST(regexp_extract(lower(trim(raw)), '([0-9]+)$', 1) AS INTEGER), 0) END AS version
FROM (SELECT p_partkey, [p_size::VARCHAR, 'v' || p_size, ' V' || p_size || ' ', 'vv' || p_size, '-' || p_size, 'latest', '', p_brand][1 + p_partkey % 8] AS raw FROM part)""")
def version_parse(s: SparkSession, d: str) -> DataFrame:
    p = F.col("p_size").cast("string")
    forms = F.array(p, F.concat(F.lit("v"), p), F.concat(F.lit(" V"), p, F.lit(" ")), F.concat(F.lit("vv"), p), F.concat(F.lit("-"), p), F.lit("latest"), F.lit(""), F.col("p_brand"))
    return scan(s, d, "part").select(F.element_at(forms, (F.col("p_partkey") % 8 + 1).cast("int")).alias("raw")).select("raw", S.parse_version("raw").alias("version"))


@query("""SELECT n_nationkey, 'Dear ' || n_name || ', region ' || n_regionkey || '; .' AS text FROM nation""")
def template_render(s: SparkSession, d: str) -> DataFrame:
    v = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("none"), F.lit(None).cast("string"))
    return scan(s, d, "nation").select("n_nationkey", S.render(F.lit("Dear {{ name }}, region {{region}}; {{ none }}{{missing}}."), v).alias("text"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND trim(o_orderstatus) <> ''")
def missing_versions(s: SparkSession, d: str) -> DataFrame:
    have = scan(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return versions.missing(scan(s, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"]), have, ["o_orderkey"], "o_orderstatus").select("o_orderkey", "o_custkey")


@query("""SELECT p_brand, p_size, sel, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY sel, p_partkey) AS rn FROM (
SELECT p_brand, p_size, 0 AS sel, p_partkey FROM part WHERE p_type = 'ECONOMY' UNION ALL SELECT p_brand, p_size, 1, p_partkey FROM part WHERE p_name LIKE '%ring%' UNION ALL SELECT p_brand, p_size, 2, p_partkey FROM part WHERE p_retailprice > 1000)) WHERE rn = 1""")
def first_wins_merge(s: SparkSession, d: str) -> DataFrame:
    p = scan(s, d, "part")
    picks = [p.filter(S.all_of(F.col("p_type") == "ECONOMY", None)), p.filter(F.col("p_name").like("%ring%")), p.filter("p_retailprice > 1000")]
    rows = [x.select("p_brand", "p_size", F.lit(i).alias("sel"), "p_partkey") for i, x in enumerate(picks)]
    return versions.first_wins(rows[0].unionByName(rows[1]).unionByName(rows[2]), ["p_brand", "p_size"], ["sel", "p_partkey"], [])


@query(f"""SELECT n.conv_id, n.version, CASE WHEN length(trim(n.text)) < 10 THEN 'text_too_short' WHEN n.version <= 0 THEN 'bad_version' WHEN s.version IS NOT NULL THEN 'exists' END AS reject_reason
FROM (SELECT conv_id, version - 2 AS version, text FROM {V}) n LEFT JOIN (SELECT DISTINCT conv_id, version FROM {V} WHERE version > 2) s ON s.conv_id = n.conv_id AND s.version = n.version""")
def version_create_check(s: SparkSession, d: str) -> DataFrame:
    v = _versions(s, d)
    return versions.check_new(v.select("conv_id", (F.col("version") - 2).alias("version"), "text"), v.filter("version > 2"), "conv_id", "version", "text").select("conv_id", "version", "reject_reason")


PRIORITIES = ["1-URGENT", "3-MEDIUM", "2-HIGH"]


@query("""SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9999 END AS position FROM orders ORDER BY position, o_orderkey LIMIT 100""")
def catalog_sort_topn(s: SparkSession, d: str) -> DataFrame:
    return versions.catalog_position(scan(s, d, "orders", ["o_orderkey", "o_orderpriority"]), "o_orderpriority", PRIORITIES).orderBy("position", "o_orderkey").limit(100)


# bindings -----------------------------------------------------------------------------------------


def _providers(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("provider_id"), F.col("n_name").alias("provider_name"))


def _models(s: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("Vision-"), F.col("s_name"))).otherwise(F.col("s_name"))
    return scan(s, d, "supplier").select(F.col("s_suppkey").alias("model_id"), F.col("s_nationkey").cast("bigint").alias("provider_id"), name.alias("model_name"))


PROV = "(SELECT n_nationkey::BIGINT AS provider_id, n_name AS provider_name FROM nation)"
MODEL = "(SELECT s_suppkey AS model_id, s_nationkey::BIGINT AS provider_id, CASE WHEN s_suppkey % 7 = 0 THEN 'Vision-' || s_name ELSE s_name END AS model_name FROM supplier)"


@query(f"""SELECT c.c_custkey AS step, p.provider_name, m.model_name, coalesce(c.c_acctbal > 0 AND p.provider_name IS NOT NULL AND m.model_name IS NOT NULL AND m.provider_id = c.pid, false) AS is_complete
FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey::BIGINT END AS pid, c_custkey % 40 AS mid FROM customer) c LEFT JOIN {PROV} p ON p.provider_id = c.pid LEFT JOIN {MODEL} m ON m.model_id = c.mid""")
def step_join_outer(s: SparkSession, d: str) -> DataFrame:
    steps = scan(s, d, "customer").select(F.col("c_custkey").alias("step"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey").cast("bigint")).alias("provider_id"), (F.col("c_custkey") % 40).alias("model_id"), (F.col("c_acctbal") > 0).alias("is_active"))
    return bindings.bound_steps(steps, _providers(s, d), _models(s, d)).select("step", "provider_name", "model_name", "is_complete")


@query("""SELECT n_nationkey, n_name, k.children FROM nation LEFT JOIN (SELECT s_nationkey, string_agg(s_suppkey || ':' || s_name, ',' ORDER BY s_suppkey) AS children FROM supplier GROUP BY s_nationkey) k ON k.s_nationkey = n_nationkey""")
def children_collected(s: SparkSession, d: str) -> DataFrame:
    kids = scan(s, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    j = versions.children(scan(s, d, "nation"), kids, "n_nationkey", ["s_suppkey", "s_name"])
    text = F.array_join(F.transform("children", lambda c: F.concat(c["s_suppkey"].cast("string"), F.lit(":"), c["s_name"])), ",")
    return j.select("n_nationkey", "n_name", text.alias("children"))


@query(f"""SELECT m.provider_id, p.provider_name, m.model_id, m.model_name, v AS vision FROM (SELECT *, regexp_matches(lower(trim(model_name)), 'vision|vl|4v|4o|gemini|doubao|glm-4v') AS v FROM {MODEL}) m JOIN {PROV} p USING (provider_id)
QUALIFY row_number() OVER (PARTITION BY m.provider_id ORDER BY v DESC, m.model_id) = 1""")
def first_vision(s: SparkSession, d: str) -> DataFrame:
    return bindings.first_available(_providers(s, d), _models(s, d), by_provider=True)


@query(f"""SELECT m.provider_id, p.provider_name, m.model_id, m.model_name, v AS vision FROM (SELECT *, regexp_matches(lower(trim(model_name)), 'vision|vl|4v|4o|gemini|doubao|glm-4v') AS v FROM {MODEL}) m JOIN {PROV} p USING (provider_id) ORDER BY v DESC, m.provider_id, m.model_id LIMIT 1""")
def first_available(s: SparkSession, d: str) -> DataFrame:
    return bindings.first_available(_providers(s, d), _models(s, d))


@query(f"""WITH r AS (SELECT c_custkey AS request_id, nullif(lower(trim(CASE c_custkey % 4 WHEN 0 THEN ' nation_' || c_nationkey || ' ' WHEN 1 THEN 'NATION_' || c_nationkey WHEN 2 THEN '' END)), '') AS p,
 nullif(lower(trim(CASE c_custkey % 4 WHEN 0 THEN 'Supplier#' || lpad((c_custkey % 30)::VARCHAR, 9, '0') WHEN 2 THEN 'SUPPLIER#' || lpad((c_custkey % 30)::VARCHAR, 9, '0') END)), '') AS m FROM customer),
pr AS (SELECT lower(provider_name) AS p, min(provider_id) AS provider_id FROM {PROV} GROUP BY 1),
both_ AS (SELECT provider_id, lower(model_name) AS m, min(model_id) AS id FROM {MODEL} GROUP BY 1, 2),
by_name AS (SELECT lower(model_name) AS m, min(model_id) AS id, arg_min(provider_id, model_id) AS provider_id FROM {MODEL} WHERE provider_id IN (SELECT provider_id FROM {PROV}) GROUP BY 1),
least_ AS (SELECT provider_id, min(model_id) AS id FROM {MODEL} GROUP BY 1),
j AS (SELECT request_id, r.p, r.m, CASE WHEN r.p IS NOT NULL THEN pr.provider_id WHEN r.m IS NOT NULL THEN n.provider_id END AS provider_id,
 CASE WHEN r.p IS NOT NULL AND r.m IS NOT NULL THEN b.id WHEN r.m IS NOT NULL THEN n.id WHEN r.p IS NOT NULL THEN l.id END AS mid
 FROM r LEFT JOIN pr USING (p) LEFT JOIN both_ b ON b.provider_id = pr.provider_id AND b.m = r.m LEFT JOIN by_name n ON n.m = r.m LEFT JOIN least_ l ON l.provider_id = pr.provider_id)
SELECT request_id, provider_id, CASE WHEN provider_id IS NOT NULL THEN mid END AS model_id FROM j""")
def named_resolution(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    number = F.lpad((F.col("c_custkey") % 30).cast("string"), 9, "0")
    nation = F.col("c_nationkey").cast("string")
    want_p = F.when(k == 0, F.concat(F.lit(" nation_"), nation, F.lit(" "))).when(k == 1, F.concat(F.lit("NATION_"), nation)).when(k == 2, "")
    want_m = F.when(k == 0, F.concat(F.lit("Supplier#"), number)).when(k == 2, F.concat(F.lit("SUPPLIER#"), number))
    r = scan(s, d, "customer").select(F.col("c_custkey").alias("request_id"), want_p.alias("want_provider"), want_m.alias("want_model"))
    return bindings.resolve_named(r, _providers(s, d), _models(s, d))


@query("""SELECT c_custkey, coalesce(a, b, g) AS resolved, CASE WHEN a IS NOT NULL THEN 'llm_step_config' WHEN b IS NOT NULL THEN 'legacy_override' ELSE 'generic_fallback' END AS config_source
FROM (SELECT c_custkey, c_acctbal > 0 AS act, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS a, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS b, c_nationkey::BIGINT AS g FROM customer) WHERE act""")
def fallback_chain(s: SparkSession, d: str) -> DataFrame:
    o = scan(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("a"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("b"))
    c = scan(s, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("is_active"), F.col("c_nationkey").cast("bigint").alias("g")).join(o, "c_custkey", "left")
    return bindings.fallback_chain(c, "is_active", [("a", "llm_step_config"), ("b", "legacy_override"), ("g", "generic_fallback")]).select("c_custkey", "resolved", "config_source")


@query(f"""SELECT c_custkey AS step, CASE WHEN t THEN sp ELSE pid END AS provider_id, CASE WHEN t THEN sm ELSE mid END AS model_id, t AS seeded
FROM (SELECT *, (pid IS NULL OR mid IS NULL) AND sp IS NOT NULL AND sm IS NOT NULL AS t FROM (
 SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey::BIGINT END AS pid, CASE WHEN c_custkey % 4 > 0 THEN c_custkey END AS mid, f.provider_id AS sp, f.mid AS sm
 FROM customer LEFT JOIN (SELECT provider_id, min(model_id) AS mid FROM {MODEL} GROUP BY 1) f ON f.provider_id = c_nationkey))""")
def binding_fill(s: SparkSession, d: str) -> DataFrame:
    c = scan(s, d, "customer").withColumn("n", F.col("c_nationkey").cast("bigint"))
    steps = c.select(F.col("c_custkey").alias("step"), F.when(F.col("c_custkey") % 3 > 0, F.col("n")).alias("provider_id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey")).alias("model_id"))
    least = _models(s, d).groupBy(F.col("provider_id").alias("n")).agg(F.min("model_id").alias("model_id"))
    seeds = c.select(F.col("c_custkey").alias("step"), "n").join(F.broadcast(least), "n").select("step", F.col("n").alias("provider_id"), "model_id")
    return bindings.fill_binding(steps, seeds, "step")


@query("""SELECT coalesce(a, b) AS key, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'both' WHEN a IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side
FROM (SELECT DISTINCT c_nationkey AS a FROM customer WHERE c_nationkey < 18) FULL OUTER JOIN (SELECT DISTINCT s_nationkey AS b FROM supplier WHERE s_nationkey > 4) ON a = b""")
def step_key_alignment(s: SparkSession, d: str) -> DataFrame:
    return A.align(scan(s, d, "customer").filter("c_nationkey < 18").select(F.col("c_nationkey").alias("key")), scan(s, d, "supplier").filter("s_nationkey > 4").select(F.col("s_nationkey").alias("key")), "key")


# tables -------------------------------------------------------------------------------------------


@query("""SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN a.p_name ELSE b.p_name END AS p_name, CASE WHEN b.p_partkey IS NULL THEN a.p_size ELSE b.p_size END AS p_size,
CASE WHEN a.p_partkey IS NULL THEN 'inserted' WHEN b.p_partkey IS NULL THEN 'kept' WHEN a.p_name IS DISTINCT FROM b.p_name OR a.p_size IS DISTINCT FROM b.p_size THEN 'updated' ELSE 'unchanged' END AS action
FROM (SELECT * FROM part WHERE p_partkey % 3 < 2) a FULL OUTER JOIN (SELECT p_partkey, p_name, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 3 > 0) b ON a.p_partkey = b.p_partkey""")
def catalog_upsert(s: SparkSession, d: str) -> DataFrame:
    p = scan(s, d, "part", ["p_partkey", "p_name", "p_size"])
    new = p.filter("p_partkey % 3 > 0").withColumn("p_size", F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return tables.upsert(p.filter("p_partkey % 3 < 2"), new, "p_partkey", ["p_name", "p_size"])


@query("""SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_name) AS id, c_name FROM customer WHERE c_acctbal < 0""")
def dense_insert(s: SparkSession, d: str) -> DataFrame:
    return tables.insert(scan(s, d, "supplier").select(F.col("s_suppkey").alias("id")), scan(s, d, "customer").filter("c_acctbal < 0").select("c_name"), "id", ["c_name"]).select("id", "c_name")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 AND c_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'RETRAINED' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def validated_update(s: SparkSession, d: str) -> DataFrame:
    have = scan(s, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.lit(True).alias("ok")).distinct()
    c = scan(s, d, "customer").join(F.broadcast(have), "c_nationkey", "left")  # one row per nation
    return tables.update(c, F.col("c_custkey") % 10 == 3, {"c_mktsegment": F.lit("RETRAINED")}, F.coalesce("ok", F.lit(False))).select("c_custkey", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_check(s: SparkSession, d: str) -> DataFrame:
    return tables.unique_violations(scan(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS orphans FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'fr')")
def orphan_check(s: SparkSession, d: str) -> DataFrame:
    return tables.orphans(scan(s, d, "labels"), scan(s, d, "documents", ["doc_id", "lang"]).filter("lang <> 'fr'"), "doc_id", "doc_id").agg(F.count(F.lit(1)).alias("orphans"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_rebuild(s: SparkSession, d: str) -> DataFrame:
    return tables.cascade_delete(scan(s, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"]), scan(s, d, "orders", ["o_orderkey", "o_orderstatus"]).filter("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey")


@query("""SELECT l.doc_id, l.kind, CASE WHEN l.kind = 'document' THEN d.source ELSE b.text END AS target_label FROM (SELECT doc_id, doc_id % 50 AS ref, 'benchmark' AS kind FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, doc_id, 'document' FROM labels WHERE toxic = 0) l
LEFT JOIN documents d ON l.kind = 'document' AND d.doc_id = l.ref LEFT JOIN benchmark b ON l.kind = 'benchmark' AND b.item_id = l.ref WHERE d.doc_id IS NOT NULL OR b.item_id IS NOT NULL""")
def polymorphic_join(s: SparkSession, d: str) -> DataFrame:
    lab = scan(s, d, "labels").filter("toxic IN (0, 1)")
    links = lab.select("doc_id", F.when(F.col("toxic") == 1, F.col("doc_id") % 50).otherwise(F.col("doc_id")).alias("ref"), F.when(F.col("toxic") == 1, "benchmark").otherwise("document").alias("kind"))
    kinds = {"document": (scan(s, d, "documents"), "doc_id", "source"), "benchmark": (scan(s, d, "benchmark"), "item_id", "text")}
    return tables.polymorphic(links, kinds, "kind", "ref").select("doc_id", "kind", "target_label")


M_SQL = "SELECT c_custkey AS id, list_filter([CASE WHEN c_custkey % 2 = 1 THEN 'raw' END, CASE WHEN c_custkey // 2 % 2 = 1 THEN 'clean' END, CASE WHEN c_custkey // 4 % 2 = 1 THEN 'picture' END, CASE WHEN c_custkey // 8 % 2 = 1 THEN 'object' END, CASE WHEN c_custkey // 16 % 2 = 1 THEN 'hybrid' END], lambda x: x IS NOT NULL) AS w FROM customer"
MODES = ["raw", "clean", "picture", "object", "hybrid"]


def _wanted(s: SparkSession, d: str) -> DataFrame:
    bits = F.array(*[F.when(F.shiftright("c_custkey", i).bitwiseAND(1) == 1, m) for i, m in enumerate(MODES)])
    return scan(s, d, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("id"), F.filter(bits, lambda x: x.isNotNull()).alias("wanted"))


@query(f"""SELECT id, array_to_string(list_sort(list_distinct(CASE WHEN len(w) = 0 THEN ['raw', 'clean', 'picture', 'object', 'hybrid']
 ELSE w || CASE WHEN list_has_any(w, ['clean', 'hybrid']) THEN ['raw'] ELSE [] END || CASE WHEN list_contains(w, 'hybrid') THEN ['clean', 'picture'] ELSE [] END END)), ',') AS modes FROM ({M_SQL})""")
def mode_closure(s: SparkSession, d: str) -> DataFrame:
    return _wanted(s, d).select("id", F.concat_ws(",", tables.modes(F.col("wanted"), MODES)).alias("modes"))


@query(f"SELECT id, array_to_string(list_filter(w || CASE WHEN id % 3 = 0 THEN ['odd'] ELSE [] END, lambda x: x IN ('odd', 'object')), ',') AS unknown FROM ({M_SQL})")
def mode_errors(s: SparkSession, d: str) -> DataFrame:
    w = _wanted(s, d).withColumn("wanted", F.concat("wanted", F.when(F.col("id") % 3 == 0, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>"))))
    return w.select("id", F.concat_ws(",", tables.array_difference(F.col("wanted"), F.array(*map(F.lit, ["raw", "clean", "picture", "hybrid"])))).alias("unknown"))


# assets -------------------------------------------------------------------------------------------


def _entries(s: SparkSession, d: str) -> DataFrame:
    e = scan(s, d, "documents", ["doc_id", "text", "source", "n_chars"])
    return e.select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 97).alias("width"), (F.col("doc_id") % 89).alias("height"), (F.col("doc_id") % 31 == 0).alias("gone"), (F.col("doc_id") % 23 == 0).alias("white"))


E_SQL = "(SELECT doc_id, source, n_chars, sha256(text) AS hash, doc_id % 97 AS width, doc_id % 89 AS height, doc_id % 31 = 0 AS gone, doc_id % 23 = 0 AS white FROM documents)"
CLEAN = f"""r AS (SELECT *, CASE WHEN gone THEN 'missing' WHEN width > 0 AND height > 0 AND (width <= 10 OR height <= 10) THEN 'tiny' WHEN n_chars > 0 AND n_chars <= 120 THEN 'low_bytes' WHEN white THEN 'near_white' END AS why FROM {E_SQL}),
f AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY source, hash, why IS NULL ORDER BY doc_id) > 1 THEN 'duplicate_hash' ELSE why END AS reason FROM r),
k AS (SELECT *, coalesce(sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)"""


def _cleaned(s: SparkSession, d: str) -> DataFrame:
    reason = assets.drop_reason(F.col("gone"), F.col("width"), F.col("height"), F.col("n_chars"), F.col("white"))
    return assets.clean(_entries(s, d), "source", "doc_id", "hash", reason, 20)


@query(f"WITH {CLEAN} SELECT source, doc_id, CAST(before + 1 AS INTEGER) AS clean_index FROM k WHERE before < 20 AND reason IS NULL")
def asset_clean(s: SparkSession, d: str) -> DataFrame:
    return _cleaned(s, d).filter("reason IS NULL").select("source", "doc_id", "clean_index")


@query(f"WITH {CLEAN} SELECT source, reason, count(*) AS dropped FROM k WHERE before < 20 AND reason IS NOT NULL GROUP BY 1, 2")
def asset_drop_reasons(s: SparkSession, d: str) -> DataFrame:
    return assets.drop_counts(_cleaned(s, d), "source")


@query(f"SELECT doc_id, hash FROM {E_SQL} QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1")
def hash_distinct_first(s: SparkSession, d: str) -> DataFrame:
    return assets.distinct_by_hash(_entries(s, d).select("doc_id", "hash"), "doc_id", "hash")


@query(f"SELECT count(*) AS duplicate_hash_count FROM (SELECT hash FROM {E_SQL} GROUP BY hash HAVING count(*) > 1)")
def duplicate_hash_groups(s: SparkSession, d: str) -> DataFrame:
    return assets.duplicate_groups(_entries(s, d), "hash")


@query(f"""SELECT doc_id, hash, source, CAST(row_number() OVER (ORDER BY o, doc_id) AS INTEGER) AS hybrid_index FROM (SELECT doc_id, hash, CASE o WHEN 0 THEN 'primary' ELSE 'fallback' END AS source, o FROM (
SELECT doc_id, hash, CASE WHEN source = 'src1' THEN 0 ELSE 1 END AS o FROM {E_SQL}) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY o, doc_id) = 1 ORDER BY o, doc_id LIMIT 60)""")
def hybrid_union(s: SparkSession, d: str) -> DataFrame:
    e = _entries(s, d).select("doc_id", "hash", F.col("source").alias("src"))
    return assets.hybrid_union(e.filter("src = 'src1'").drop("src"), e.filter("src IS DISTINCT FROM 'src1'").drop("src"), "doc_id", "hash", 60, 2000).select("doc_id", "hash", "source", "hybrid_index")


@query(f"""SELECT source, count(*) AS n, count(*) FILTER (width > 0 AND height > 0 AND (width <= 12 OR height <= 12)) AS tiny_image_count, count(*) FILTER (white AND NOT gone) AS near_white_count, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes, round_even(CAST(count(*) AS DOUBLE) / 64, 4) AS coverage_ratio FROM {E_SQL} GROUP BY source""")
def coverage_ratio(s: SparkSession, d: str) -> DataFrame:
    return assets.metrics(_entries(s, d), "source", "width", "height", "n_chars", F.lit(64), F.col("white") & ~F.col("gone"))


@query("""SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS succeeded, count(*) FILTER (event_type NOT IN ('click', 'error')) AS skipped, count(*) FILTER (event_type = 'error') AS failed, CAST(sum(user_id) AS BIGINT) AS amount FROM events""")
def run_summary(s: SparkSession, d: str) -> DataFrame:
    st = F.when(F.col("event_type") == "click", "success").when(F.col("event_type") == "error", "failed").otherwise("skipped")
    return assets.run_summary(scan(s, d, "events"), st, F.col("user_id"))


@query(r"""SELECT coalesce(nullif(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/.](\.[^./]+)$', 1)), ''), '<no_suffix>') AS suffix, count(*) AS n FROM pages GROUP BY 1""")
def suffix_counts(s: SparkSession, d: str) -> DataFrame:
    return files.suffix_counts(scan(s, d, "pages", ["url"]), "url")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '/[0-9]+') ORDER BY url, page_id LIMIT 50")
def doc_scan_limit(s: SparkSession, d: str) -> DataFrame:
    p = scan(s, d, "pages", ["page_id", "url"]).withColumn("path", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/page.HTML")))
    return files.listing(p.filter(F.lower("url").rlike("/[0-9]+")), "*.HTML", 50, [".html"], ["url", "page_id"]).select("page_id", "url")


# scalars and contracts ----------------------------------------------------------------------------


@query(r"""SELECT doc_id, CASE WHEN x = '' THEN 'document' ELSE x END AS stem FROM (SELECT doc_id, substr(regexp_replace(regexp_replace(text, '[^0-9A-Za-z一-鿿._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 1, 80) AS x FROM documents)""")
def safe_stem(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d, "documents", ["doc_id", "text"]).select("doc_id", S.safe_stem("text").alias("stem"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 80) AS preview FROM documents")
def preview_text(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d, "documents", ["doc_id", "text"]).select("doc_id", S.preview_text("text").alias("preview"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN regexp_matches(event_type, '^[0-9]+$') THEN 1 END AS bad FROM events")
def safe_int(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d, "events", ["event_id", "props", "event_type"]).select("event_id", S.safe_int(F.get_json_object("props", "$.k")).alias("k"), S.safe_int("event_type").alias("bad"))


@query("SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS tag, count(*) AS n FROM events GROUP BY 1, 2")
def json_extract(s: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return scan(s, d, "events", ["user_id", "props"]).groupBy("user_id", (k % 10).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, CAST(n AS INTEGER) AS sheets, n = 2 AND reasons_ok AS valid FROM (SELECT conv_id, count(*) AS n, bool_and(length(text) <= 40) AS reasons_ok FROM conversations GROUP BY conv_id)""")
def contract_validate(s: SparkSession, d: str) -> DataFrame:
    c = scan(s, d, "conversations", ["conv_id", "turn", "role", "text"])
    item = F.struct(F.col("role").alias("type"), F.col("turn").cast("int").alias("order"), F.col("turn").cast("int").alias("physical_index"), F.col("text").alias("reason"))
    said = c.groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("js"))
    parsed = said.withColumn("r", C.parse("js", "sheet_types"))
    return parsed.select("conv_id", F.size("r").alias("sheets"), C.sheet_types_ok(F.col("r"), F.lit(2)).alias("valid"))


@query("""SELECT user_id, CAST(count(*) AS INTEGER) AS answers, bool_and(a IN ('A', 'B', 'C', 'D', 'EMPTY')) AS valid FROM (SELECT user_id, ['A', 'B', 'C', 'D', 'EMPTY', 'X'][1 + CAST(event_id % 6 AS INTEGER)] AS a FROM events) GROUP BY user_id""")
def answer_card(s: SparkSession, d: str) -> DataFrame:
    e = scan(s, d, "events", ["event_id", "user_id"])
    a = F.element_at(F.array(*map(F.lit, ["A", "B", "C", "D", "EMPTY", "X"])), (F.col("event_id") % 6 + 1).cast("int"))
    n = versions.renumber(e.select("user_id", "event_id", a.alias("a")), ["user_id"], ["event_id"])
    card = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("index").cast("string"), "a"))).alias("m"))
    card = card.withColumn("m", C.parse(F.to_json("m"), "answer_card"))
    return card.select("user_id", F.size("m").alias("answers"), C.answer_card_ok(F.col("m")).alias("valid"))


@query("SELECT r_regionkey AS doc, r_name AS source, n_name AS target, 'contains' AS type FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def entity_edges(s: SparkSession, d: str) -> DataFrame:
    n = scan(s, d, "nation").join(scan(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    said = n.groupBy("r_regionkey", "r_name").agg(
        F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, F.struct(F.col("n_name").alias("name"), F.lit("").alias("context")))).alias("kids"),
        F.collect_list(F.struct(F.col("r_name").alias("source"), F.col("n_name").alias("target"), F.lit("contains").alias("type"))).alias("relationships"),
    )
    root = F.array(F.struct(F.col("r_name").alias("name"), F.lit("").alias("context")))
    js = said.select(F.col("r_regionkey").alias("doc"), F.to_json(F.struct(F.concat(root, "kids").alias("entities"), "relationships")).alias("js")).withColumn("k", C.parse("js", "knowledge"))
    return C.knowledge_edges(js, "k", "doc")[1]


# matching -----------------------------------------------------------------------------------------


@query(r"""SELECT sha256(trim(regexp_replace(lower(text), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+', ' ', 'g'))) AS canonical_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def canonical_dedup(s: SparkSession, d: str) -> DataFrame:
    return matching.canonical(scan(s, d, "documents", ["doc_id", "text"]), "doc_id", "text")


BM25_SQL = r"""WITH qt AS (SELECT item_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+', ' ', 'g')), ' '), lambda w: w <> '')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS qtf FROM qt GROUP BY 1, 2),
w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM documents),
l AS (SELECT doc_id, len(ws) AS dl FROM w), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
x AS (SELECT term, doc_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS w FROM t JOIN df USING (term) JOIN l USING (doc_id), st),
sc AS (SELECT item_id, doc_id, round(sum(w * qtf), 6) AS score FROM q JOIN x USING (term) GROUP BY 1, 2)"""


def _bm25(s: SparkSession, d: str) -> DataFrame:
    scored = matching.bm25(scan(s, d, "benchmark"), scan(s, d, "documents", ["doc_id", "text"]), "item_id", "doc_id", "text")
    return scored.withColumn("score", F.round("score", 6))


@query(BM25_SQL + " SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 5")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_top_k(scan(s, d, "benchmark"), scan(s, d, "documents", ["doc_id", "text"]), "item_id", "doc_id", "text", 5)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM v),
sc AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 5""")
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    e = scan(s, d, "embeddings", ["vec_id", "embedding"])
    return matching.vector_top_k(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)


@query(BM25_SQL + ", top AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS m FROM sc) SELECT item_id, doc_id, CAST(round(CAST(coalesce(round(score / m, 6), 0) AS DECIMAL(12,8)) * CAST(0.5 AS DECIMAL(2,1)) + CAST((doc_id % 100) / 100.0::DOUBLE AS DECIMAL(12,8)) * CAST(0.3 AS DECIMAL(2,1)), 4) AS DECIMAL(5,4))::DOUBLE AS final_score FROM top")
def hybrid_match(s: SparkSession, d: str) -> DataFrame:
    sc = _bm25(s, d)
    top = sc.join(sc.groupBy("item_id").agg(F.max("score").alias("m")), "item_id")
    return top.select("item_id", "doc_id", matching.fuse(F.round(F.col("score") / F.col("m"), 6), (F.col("doc_id") % 100) / F.lit(100.0), F.lit(0.0)).cast("double").alias("final_score"))


@query(BM25_SQL + " SELECT item_id, doc_id, score, score >= 40 AS accepted FROM sc QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) = 1")
def match_accept(s: SparkSession, d: str) -> DataFrame:
    best = retrieval.bm25_top_k(scan(s, d, "benchmark"), scan(s, d, "documents", ["doc_id", "text"]), "item_id", "doc_id", "text", 1)
    return best.select("item_id", "doc_id", "score", (F.col("score") >= 40.0).alias("accepted"))


@query("""SELECT a.p_partkey AS source_id, b.p_partkey AS target_id, 1 - abs(a.p_size - b.p_size) / 50.0::DOUBLE AS pair_score FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey WHERE 1 - abs(a.p_size - b.p_size) / 50.0::DOUBLE >= 0.9""")
def similar_pairs(s: SparkSession, d: str) -> DataFrame:
    score = F.lit(1) - F.abs(F.col("a.p_size") - F.col("b.p_size")) / F.lit(50.0)
    return matching.blocked_pairs(scan(s, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type"], score, 0.9, ["p_size"], near=("p_size", 5))


# analytics ----------------------------------------------------------------------------------------


@query("""SELECT c_mktsegment AS family, n_name AS region, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS frequency, CAST(GROUPING(c_mktsegment, n_name, year(o_orderdate)) AS BIGINT) AS level
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY GROUPING SETS ((c_mktsegment), (c_mktsegment, n_name), (c_mktsegment, year(o_orderdate)))""")
def family_stats(s: SparkSession, d: str) -> DataFrame:
    c = scan(s, d, "customer").join(scan(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("family"), F.col("n_name").alias("region"))
    o = scan(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return A.family_stats(o, "family", "region", F.year("o_orderdate"))


@query("""SELECT user_id, event_type, count(*) AS attempts, count(CASE WHEN event_type <> 'error' THEN 1 END) AS judged, round(avg(CASE WHEN event_type <> 'error' THEN CAST(value > 10 AS INTEGER) END), 6) AS correct_rate, CAST(round(sum(CAST(value AS DECIMAL(18,6))), 2) AS DOUBLE) AS score, CAST(sum(event_id % 60) AS BIGINT) AS seconds FROM events GROUP BY 1, 2""")
def student_profile(s: SparkSession, d: str) -> DataFrame:
    return A.attempt_metrics(scan(s, d, "events"), ["user_id", "event_type"], F.when(F.col("event_type") != "error", F.col("value") > 10), F.col("value"), F.col("event_id") % 60)


@query("SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_job(s: SparkSession, d: str) -> DataFrame:
    return A.latest_by(scan(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS jobs, CAST(sum(date_diff('second', o_orderdate, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24))) AS BIGINT) AS seconds FROM orders GROUP BY 1, 2")
def job_metrics(s: SparkSession, d: str) -> DataFrame:
    o = scan(s, d, "orders").withColumn("end", F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"), F.lit(0), F.lit(0)))
    return A.job_metrics(o, "o_orderstatus", "o_orderpriority", "o_orderdate", "end")


@query("""SELECT l_orderkey, l_linenumber, section FROM lineitem JOIN (SELECT o_orderkey, s.section, s.lo, s.hi FROM orders, (VALUES ('A', 1, 2), ('B', 3, 5), ('C', 6, 7)) s(section, lo, hi)) ON o_orderkey = l_orderkey AND l_linenumber BETWEEN lo AND hi""")
def section_range_join(s: SparkSession, d: str) -> DataFrame:
    parts = s.createDataFrame([("A", 1, 2), ("B", 3, 5), ("C", 6, 7)], "section string, lo int, hi int")
    sections = scan(s, d, "orders", ["o_orderkey"]).withColumnRenamed("o_orderkey", "l_orderkey").crossJoin(F.broadcast(parts))  # three sections each
    return A.in_section(scan(s, d, "lineitem", ["l_orderkey", "l_linenumber"]), sections, "l_orderkey", S.natural_key("l_linenumber"), "lo", "hi").select("l_orderkey", "l_linenumber", "section")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND (CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END IS NULL OR o_orderdate > TIMESTAMP '1998-01-01')")
def license_filter(s: SparkSession, d: str) -> DataFrame:
    o = scan(s, d, "orders").withColumn("expires", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")))
    return o.filter(A.licensed(F.col("o_orderstatus") != "F", "expires", F.lit("1998-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE CASE WHEN s_suppkey % 4 > 0 THEN s_nationkey END IS NULL OR s_nationkey = 7")
def tenant_visible(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d, "supplier").withColumn("tenant", F.when(F.col("s_suppkey") % 4 > 0, F.col("s_nationkey"))).filter(A.visible("tenant", 7)).select("s_suppkey", "s_name")


@query("""WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
t AS (SELECT node, label AS path, 0 AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT n.node, t.path || '/' || n.label, t.depth + 1 FROM nodes n JOIN t ON n.parent = t.node) SELECT node, path, depth FROM t""")
def taxonomy_path(s: SparkSession, d: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = scan(s, d, "region").select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    n = n.unionByName(scan(s, d, "nation").select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("label")))
    n = n.unionByName(scan(s, d, "customer").select(key("c", "c_custkey").alias("node"), key("n", "c_nationkey").alias("parent"), F.col("c_name").alias("label")))
    return A.paths(n, "node", "parent", "label")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def windowed_attempts(s: SparkSession, d: str) -> DataFrame:
    w = stream.windowed_counts(scan(s, d, "events"))
    return w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS links FROM pages")
def element_profile(s: SparkSession, d: str) -> DataFrame:
    pages = scan(s, d, "pages", ["page_id", "html"])
    n = extract.extract(pages, "elements", "html").groupBy("page_id").agg(*[F.coalesce(F.sum(F.when(F.col("element") == e, F.col("n"))), F.lit(0)).alias(name) for e, name in (("p", "paragraphs"), ("a", "links"))])
    return pages.select("page_id").join(n, "page_id", "left").select("page_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("paragraphs", "links")])


@query("SELECT user_id, count(*) FILTER (event_id % 2 = 0) * 3 AS formulas FROM events GROUP BY user_id")
def formula_node_count(s: SparkSession, d: str) -> DataFrame:
    block = F.when(F.col("event_id") % 2 == 0, F.lit('{"type": "p", "items": [{"type": "formula", "x": {"type":"formula"}}, {"type" : "formula"}]}')).otherwise(F.lit('{"type": "text"}'))
    e = scan(s, d, "events", ["event_id", "user_id"]).select("event_id", "user_id", block.alias("js"))
    n = trees.count_kind(e.select(F.struct("event_id", "user_id").alias("event"), "js"), "event", "js", "formula")
    return n.groupBy("event.user_id").agg(F.sum("n").alias("formulas"))


# steps, end to end --------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT c_custkey AS step_key, c_custkey % 60 AS prompt_key, CASE c_custkey % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'latest' ELSE '9' END AS sel FROM customer WHERE c_acctbal > 0),
q AS (SELECT step_key, prompt_key, CASE sel WHEN 'v2' THEN 2 WHEN '9' THEN 9 END AS req FROM s)
SELECT q.step_key, q.prompt_key, q.req AS requested_version, v.version AS resolved_version, CASE WHEN v.version = q.req THEN 'requested' WHEN v.status = 'published' THEN 'highest_published' ELSE 'highest_version' END AS version_source,
CASE WHEN q.req IS NULL THEN 'latest' ELSE 'step_config' END AS config_source, 'step ' || q.step_key || ': ' || v.text AS prompt_text
FROM q JOIN {V} v ON v.conv_id = q.prompt_key
QUALIFY row_number() OVER (PARTITION BY q.step_key ORDER BY coalesce(v.version = q.req, false) DESC, v.status = 'published' DESC, v.version DESC) = 1""")
def step_prompt_resolve(s: SparkSession, d: str) -> DataFrame:
    c = scan(s, d, "customer")
    sel = F.when(F.col("c_custkey") % 3 == 0, "v2").when(F.col("c_custkey") % 3 == 1, "latest").otherwise("9")
    steps = c.select(F.col("c_custkey").alias("step_key"), (F.col("c_custkey") % 60).alias("prompt_key"), sel.alias("selected_version"), (F.col("c_acctbal") > 0).alias("is_active"))
    v = _versions(s, d).select(F.col("conv_id").alias("prompt_key"), "version", "status", F.concat(F.lit("step {{ key }}: "), F.col("text")).alias("prompt_text"))
    return prompts.resolve_steps(steps, v, F.create_map(F.lit("key"), F.col("step_key").cast("string")))


@query(f"""SELECT prompt_key, string_agg(step_key || '=' || version, ',' ORDER BY step_key) AS summary FROM (SELECT c_custkey AS step_key, c_custkey % 60 AS prompt_key, v.version FROM customer JOIN {V} v ON v.conv_id = c_custkey % 60 WHERE c_acctbal > 0
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY v.status = 'published' DESC, v.version DESC) = 1) GROUP BY prompt_key""")
def prompt_summary(s: SparkSession, d: str) -> DataFrame:
    """Of each template, the steps that resolve and their versions; steps that do not resolve are left out."""
    c = scan(s, d, "customer").select(F.col("c_custkey").alias("step_key"), (F.col("c_custkey") % 60).alias("prompt_key"), F.lit(None).cast("string").alias("selected_version"), (F.col("c_acctbal") > 0).alias("is_active"))
    v = _versions(s, d).select(F.col("conv_id").alias("prompt_key"), "version", "status", F.col("text").alias("prompt_text"))
    m = versions.summary_map(prompts.resolve_steps(c, v, F.create_map().cast("map<string,string>")), "step_key", ["resolved_version"], ("prompt_key",))
    return m.select("prompt_key", F.array_join(F.transform(F.map_entries("summary"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"]["resolved_version"].cast("string"))), ",").alias("summary"))


@query("SELECT c_nationkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_name, c_custkey) AS step_keys FROM customer GROUP BY c_nationkey")
def steps_of_template(s: SparkSession, d: str) -> DataFrame:
    return prompts.bound_to(scan(s, d, "customer"), "c_nationkey", "c_custkey", "c_name").select("c_nationkey", F.concat_ws(",", F.col("step_keys").cast("array<string>")).alias("step_keys"))


@query("""SELECT p_brand, p_size AS version, 'Seed ' || p_name AS text FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size = 20 DESC, p_size DESC, p_name DESC) AS rn FROM part) WHERE rn = 1""")
def seed_text(s: SparkSession, d: str) -> DataFrame:
    seeds = scan(s, d, "part").select("p_brand", F.col("p_size").alias("version"), F.concat(F.lit("{{ word }} "), F.col("p_name")).alias("text"))
    return prompts.seed_text(seeds, "p_brand", "version", "text", F.lit(20), F.create_map(F.lit("word"), F.lit("Seed")))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'extract.exam' WHEN 1 THEN 'extract.answer' WHEN 2 THEN 'extract.mixed' ELSE 'classify' END AS template FROM pages""")
def page_routing(s: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["exam_paper", "answer_sheet", "mixed", "other"])), (F.col("page_id") % 4 + 1).cast("int"))
    return scan(s, d, "pages", ["page_id"]).select("page_id", prompts.route_page(kind, "extract.exam", "extract.answer", "extract.mixed", "classify").alias("template"))


@query("""SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY f, l_returnflag) AS INTEGER) AS set_no, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS INTEGER) AS sheet_no
FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag) AS f FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2))""")
def set_numbering(s: SparkSession, d: str) -> DataFrame:
    one = scan(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    return prompts.number_sets(one, "l_orderkey", "l_returnflag", "l_linenumber").select("l_orderkey", "l_linenumber", "set_no", "sheet_no")


@query(f"""SELECT source, count(*) AS n, round_even(CAST(count(*) AS DOUBLE) / 50, 4) AS coverage_ratio, count(DISTINCT hash) AS distinct_hashes, CAST(round(sum(CAST(n_chars AS DECIMAL(15,0)) * CAST(0.001 AS DECIMAL(3,3))), 2) AS DOUBLE) AS elapsed_seconds FROM {E_SQL} GROUP BY source""")
def strategy_compare(s: SparkSession, d: str) -> DataFrame:
    return prompts.compare_strategies(_entries(s, d).withColumn("seconds", F.col("n_chars") / F.lit(1000.0)), "source", "seconds", "hash", 50)


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 > 0) AS exported, count(*) FILTER (event_id % 7 = 0) AS failed FROM events GROUP BY event_type""")
def export_counts(s: SparkSession, d: str) -> DataFrame:
    e = scan(s, d, "events").withColumn("path", F.when(F.col("event_id") % 3 > 0, "p")).withColumn("error", F.when(F.col("event_id") % 7 == 0, "e"))
    return prompts.export_counts(e, "event_type", "path", "error")


@query(f"""SELECT p.provider_id, CASE p.provider_id % 3 WHEN 0 THEN n.id WHEN 1 THEN coalesce(v.id, a.id) ELSE a.id END AS seed FROM {PROV} p LEFT JOIN (SELECT provider_id, max(model_id) AS id FROM {MODEL} GROUP BY 1) n USING (provider_id)
LEFT JOIN (SELECT provider_id, min(model_id) AS id FROM {MODEL} WHERE model_name LIKE 'Vision%' GROUP BY 1) v USING (provider_id) LEFT JOIN (SELECT provider_id, min(model_id) AS id FROM {MODEL} GROUP BY 1) a USING (provider_id)""")
def seed_strategy(s: SparkSession, d: str) -> DataFrame:
    m = _models(s, d).groupBy("provider_id").agg(F.max("model_id").alias("named"), F.min(F.when(S.supports_vision("model_name"), F.col("model_id"))).alias("vision"), F.min("model_id").alias("avail"))
    p = _providers(s, d).join(m, "provider_id", "left").withColumn("strategy", F.element_at(F.array(*map(F.lit, ["named", "first_vision", "first_available"])), (F.col("provider_id") % 3 + 1).cast("int")))
    return bindings.seed_by_strategy(p, "strategy", "named", "vision", "avail").select("provider_id", "seed")


@query("SELECT o_custkey, count(*) AS questions, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS points FROM orders GROUP BY o_custkey")
def paper_totals(s: SparkSession, d: str) -> DataFrame:
    return scan(s, d, "orders", ["o_custkey", "o_totalprice"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("questions"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("points"))


@query("""SELECT o_orderkey, prev_key, next_key FROM (SELECT o_orderkey, lag(o_orderkey) OVER w AS prev_key, lead(o_orderkey) OVER w AS next_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""")
def block_neighbours(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return scan(s, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]).select("o_orderkey", F.lag("o_orderkey").over(w).alias("prev_key"), F.lead("o_orderkey").over(w).alias("next_key"))


@query("""SELECT event_id, CASE WHEN microsecond(ts) % 1000000 > 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS run_id, '''' || replace(event_type || '''s', '''', '''''') || '''' AS lit, 'object_' || lpad((event_id % 10000)::VARCHAR, 4, '0') || '__' || event_type AS name FROM events""")
def record_fields(s: SparkSession, d: str) -> DataFrame:
    e = scan(s, d, "events", ["event_id", "ts", "event_type"])
    return e.select("event_id", S.iso_time("ts").alias("iso"), S.run_id("ts").alias("run_id"), S.sql_literal(F.concat("event_type", F.lit("'s"))).alias("lit"), S.numbered_name("object", F.col("event_id") % 10000, "event_type").alias("name"))
