"""Operator 4 [native]: mixing sources to target weights by hierarchical budgets.

The tree is domain > language > source. The root's budget is dealt to its children in proportion to their
weights, a child's down to its own, to the leaves. No node gets more than its subtree can give (its tokens
times ``max_epochs``): what it cannot take goes to its siblings, again by weight, and only what all siblings
together cannot take was never given to their parent, so that shortages are settled among siblings before
they reach ancestors. A leaf takes whole epochs while its budget lasts, and of the next one the documents
that come first in that epoch's seeded order, as long as their tokens fit.

Everything is DataFrame functions. Documents are read once for their token counts and once for the choice;
budgets are windows over one row per leaf. A leaf's order is the MD5 of seed, epoch and doc_id. The place
where its prefix ends is found by first summing tokens in slices of that order, about ``SLICE`` documents
each, and then within the one slice where the budget ends, so that no leaf's documents meet in one task.

Cases: null or empty texts have no tokens and are never chosen; null languages or sources are a value of
their own ('' in the tree); weights that are missing are 1, weights <= 0 give nothing; equal places in the
order (repeated doc_ids) are taken or left together; an empty table gives an empty result; a budget beyond
all capacity takes everything max_epochs times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SLICE = 512
WORDS = r"[^\x20\x09-\x0D]+"
#: Leaves that are broadcast, at most; beyond, the join shuffles.
MAX_LEAVES = 100_000


def domain_of(source: str = "source") -> Column:
    """The production tree's domain of a source: its number modulo 3."""
    number = F.coalesce(F.expr(f"try_cast(nullif(regexp_extract({source}, '([0-9]+)$', 1), '') AS bigint)"), F.lit(0))
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), (F.pmod(number, F.lit(3)) + 1).cast("int"))


def _weights(w: dict[str, int], key: str) -> Column:
    if not w:
        return F.lit(1).cast("bigint")
    table = F.create_map(*[x for k, v in w.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    return F.coalesce(F.try_element_at(table, F.col(key)), F.lit(1).cast("bigint"))


def _share(df: DataFrame, parent: list[str], budget: str, weight: str, cap: str, out: str) -> DataFrame:
    """Water-filling of a parent's budget over its children: whole tokens, no child beyond its cap."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    fill = F.when(F.col(weight) > 0, F.col(cap).cast("double") / F.col(weight)).otherwise(F.lit(float("inf")))
    key = [c for c in df.columns if c in ("domain", "lang", "source")]
    up = by.orderBy("_fill", *key).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_fill", fill)
    df = df.withColumn("_before", F.coalesce(F.sum(F.when(F.col(weight) > 0, F.col(cap)).otherwise(0)).over(up), F.lit(0)))
    df = df.withColumn("_left", F.sum(F.greatest(weight, F.lit(0))).over(by) - F.coalesce(F.sum(F.greatest(F.col(weight), F.lit(0))).over(up), F.lit(0)))
    level = F.when(F.col("_left") > 0, (F.col(budget) - F.col("_before")).cast("double") / F.col("_left")).otherwise(F.lit(0.0))
    df = df.withColumn("_level", level)
    open_ = F.max(F.when((F.col(weight) > 0) & (F.col("_fill") > F.col("_level")), F.col("_level"))).over(by)
    df = df.withColumn("_water", open_)
    got = F.when(F.col(weight) <= 0, F.lit(0)).when(F.col("_water").isNull() | (F.col("_fill") <= F.col("_water")), F.col(cap)).otherwise(F.least(F.col(cap), F.floor(F.greatest(F.col("_water"), F.lit(0.0)) * F.col(weight))))
    return df.withColumn(out, got.cast("bigint")).drop("_fill", "_before", "_left", "_level", "_water")


def budgets(leaves: DataFrame, budget: Column, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves: domain, lang, source, docs, tokens. Adds each leaf's budget."""
    df = leaves.withColumn("cap", F.col("tokens") * max_epochs).withColumn("w", _weights(weights.get("source", {}), "source"))
    df = df.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0)))
    langs = df.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("w", _weights(weights.get("lang", {}), "lang"))
    langs = langs.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0)))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", _weights(weights.get("domain", {}), "domain"))
    domains = domains.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0))).crossJoin(F.broadcast(leaves.agg(budget.cast("bigint").alias("root"))))  # one row
    domains = _share(domains, [], "root", "w", "cap", "b1").select("domain", "b1")
    langs = _share(langs.join(domains, "domain"), ["domain"], "b1", "w", "cap", "b2").select("domain", "lang", "b2")
    return _share(df.join(langs, ["domain", "lang"]), ["domain", "lang"], "b2", "w", "cap", "budget").drop("cap", "w", "b2")


def mix(
    df: DataFrame, weights: dict[str, dict[str, int]], share: float = 0.5, max_epochs: int = 2, seed: int = 11, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain: Column | None = None
) -> DataFrame:
    """The input's columns, domain, n_tokens and copies (epochs that take the document) of what is chosen.

    The budget is ``share`` of all tokens. Columns of the input with these three names are replaced."""
    new = ("domain", "n_tokens", "copies")
    cols = [c for c in df.columns if c not in new]
    base = df.filter(F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(  # has a token
        F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.coalesce(domain if domain is not None else domain_of(source), F.lit("")).alias("domain"),
        F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"),
    )
    n_tokens = F.regexp_count(F.col(f"_row.`{text}`"), F.lit(WORDS)).cast("bigint")
    light = common.materialize(base.withColumn("n_tokens", n_tokens).drop("_row"), "token-counts")  # a few bytes for a document, without its text
    leaves = light.groupBy("domain", "lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    leaves = common.materialize(leaves, "leaves")
    given = budgets(leaves, F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)), max_epochs, weights)
    given = given.select("domain", "lang", "source", "docs", F.floor(F.col("budget") / F.col("tokens")).cast("bigint").alias("whole"), F.pmod("budget", "tokens").alias("rest"))
    given = common.materialize(given, "budgets")
    small = given.limit(MAX_LEAVES + 1).count() <= MAX_LEAVES
    key = ["domain", "lang", "source"]

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(given) if small else given, key)
        rows = rows.withColumn("_at", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("_id")).cast("binary")))
        unit = F.conv(F.substring("_at", 1, 8), 16, 10).cast("bigint")
        return rows.withColumn("_slice", F.shiftright(unit * F.ceil(F.col("docs") / SLICE), 32).cast("bigint"))

    # where each leaf's prefix ends: the slice, then the place in it
    slim = placed(light).filter("rest > 0").select(*key, "rest", "_slice", "_at", "n_tokens")
    slices = slim.groupBy(*key, "_slice").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    before = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("b", F.coalesce(F.sum("t").over(before), F.lit(0)))
    cut = common.materialize(slices.filter("b <= rest AND b + t > rest").select(*key, F.col("_slice").alias("_cut"), (F.col("rest") - F.col("b")).alias("room")), "cuts")
    hint = F.broadcast if small else (lambda x: x)  # one row for a leaf, at most
    edge = slim.join(hint(cut), [*[slim[k] == cut[k] for k in key], F.col("_slice") == F.col("_cut")]).select(*[slim[k] for k in key], "_slice", "_at", "n_tokens", "room")
    inside = Window.partitionBy(*key, "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("run", F.sum("n_tokens").over(inside)).filter("run <= room").groupBy(*key).agg(F.max("_at").alias("_last"))
    ends = common.materialize(cut.select(*key, "_cut").join(edge, key, "left"), "ends")
    chosen = placed(base).join(hint(ends), key, "left")
    part = (F.col("rest") > 0) & (F.col("_cut").isNull() | (F.col("_slice") < F.col("_cut")) | ((F.col("_slice") == F.col("_cut")) & F.coalesce(F.col("_at") <= F.col("_last"), F.lit(False))))
    chosen = chosen.withColumn("copies", F.col("whole") + F.when(part, 1).otherwise(0)).filter("copies > 0")
    return chosen.withColumn("n_tokens", n_tokens).select(*[F.col(f"_row.`{c}`").alias(c) for c in cols], *[F.col(c) for c in new])  # counted again for what is chosen alone


#: Production weights.
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 1, "src1": 3, "src2": 3}}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), WEIGHTS).drop("text")


def _case(w: dict[str, int], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items()) + " ELSE 1 END"


def _sql_share(src: str, parent: str, budget: str, out: str, keep: str) -> str:
    by = f"PARTITION BY {parent} " if parent else ""
    up = f"OVER ({by}ORDER BY fill, {keep} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
    SELECT {keep}, CAST(CASE WHEN water IS NULL OR fill <= water THEN cap ELSE least(cap, floor(greatest(water, 0.0) * w)) END AS BIGINT) AS {out}
    FROM (SELECT *, max(CASE WHEN fill > level THEN level END) OVER ({by}) AS water
      FROM (SELECT *, CAST({budget} - coalesce(sum(cap) {up}, 0) AS DOUBLE) / (sum(w) OVER ({by}) - coalesce(sum(w) {up}, 0)) AS level
        FROM (SELECT *, CAST(cap AS DOUBLE) / w AS fill FROM ({src}))))"""


SQL = f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
         ['web', 'books', 'code'][coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT), 0) % 3 + 1] AS domain
  FROM documents WHERE text IS NOT NULL
), base AS (SELECT * FROM d WHERE n_tokens > 0),
leaf AS (SELECT domain, l, s, count(*) AS docs, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * 2 AS cap, {_case(WEIGHTS['source'], 's')} AS w FROM base GROUP BY ALL),
lan AS (SELECT domain, l, CAST(sum(cap) AS BIGINT) AS cap, {_case(WEIGHTS['lang'], 'l')} AS w FROM leaf GROUP BY ALL),
dom AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {_case(WEIGHTS['domain'], 'domain')} AS w, (SELECT CAST(floor(sum(tokens) * 0.5) AS BIGINT) FROM leaf) AS root FROM lan GROUP BY ALL),
b1 AS ({_sql_share('SELECT * FROM dom', '', 'root', 'b1', 'domain')}),
b2 AS ({_sql_share('SELECT lan.*, b1 FROM lan JOIN b1 USING (domain)', 'domain', 'b1', 'b2', 'domain, l')}),
b3 AS ({_sql_share('SELECT leaf.*, b2 FROM leaf JOIN b2 USING (domain, l)', 'domain, l', 'b2', 'budget', 'domain, l, s')}),
p AS (
  SELECT base.*, budget // tokens AS whole, budget % tokens AS rest, md5('11:' || CAST(budget // tokens AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS place
  FROM base JOIN leaf USING (domain, l, s) JOIN b3 USING (domain, l, s)
), r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM p)
SELECT doc_id, lang, source, domain, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(whole + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r WHERE whole + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END > 0
"""
