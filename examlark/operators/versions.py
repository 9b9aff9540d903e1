"""Versioned templates: choosing a version, falling back, merging, registering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def published(status: Column) -> Column:
    """No status counts as published."""
    return F.coalesce(F.nullif(status, F.lit("")), F.lit("published")) == "published"


def resolve(versions: DataFrame, key: str, version: str, status: Column, requested: Column, keep: list[str]) -> DataFrame:
    """One row per key: the requested version, else the highest published, else the highest; and which it was.

    An aggregate with a struct order, so that map-side partial results keep one row per key."""
    hit = F.coalesce(F.col(version) == requested, F.lit(False))
    order = F.struct(hit.alias("hit"), published(status).alias("pub"), F.col(version).alias("v"), *[F.col(c) for c in keep])
    best = versions.groupBy(key).agg(F.max(order).alias("b"))
    source = F.when(F.col("b.hit"), "requested").when(F.col("b.pub"), "highest_published").otherwise("highest_version")
    return best.select(key, F.col("b.v").alias(version), source.alias("version_source"), *[F.col(f"b.{c}").alias(c) for c in keep])


def chosen(requests: DataFrame, versions: DataFrame, key: str, version: str, status: str, text: str) -> DataFrame:
    """requests (key, requested, ...) with b: hit, pub, v and t of the version that is asked for, else of the best; null without any.

    Two joins that multiply nothing: one with each (key, version), one with each key's best."""
    pub = published(F.col(status)).alias("pub")
    exact = versions.filter(F.col(version).isNotNull()).groupBy(F.col(key), F.col(version).alias("requested")).agg(F.max(F.struct(pub, F.col(version).alias("v"), F.col(text).alias("t"))).alias("_exact"))
    best = versions.filter(F.col(version).isNotNull()).groupBy(key).agg(F.max(F.struct(pub, F.col(version).alias("v"), F.col(text).alias("t"))).alias("_best"))
    told = lambda c, hit: F.struct(F.lit(hit).alias("hit"), F.col(f"{c}.pub"), F.col(f"{c}.v"), F.col(f"{c}.t"))
    j = requests.join(exact, [key, "requested"], "left").join(best, key, "left")
    return j.withColumn("b", F.when(F.col("_exact").isNotNull(), told("_exact", True)).when(F.col("_best").isNotNull(), told("_best", False))).drop("_exact", "_best")


def source_of(b: str = "b") -> Column:
    """How the version was found."""
    return F.when(F.col(b).isNull(), "version_not_found").when(F.col(f"{b}.hit"), "requested").when(F.col(f"{b}.pub"), "highest_published").otherwise("highest_version")


def resolve_requests(requests: DataFrame, versions: DataFrame, key: str, version: str, status: str, text: str) -> DataFrame:
    """requests (key, requested): as resolve for each distinct one, and version_not_found where nothing fits."""
    best = chosen(requests.select(key, "requested").distinct(), versions, key, version, status, text)
    return best.select(key, "requested", F.col("b.v").alias("resolved"), source_of().alias("version_source"), F.col("b.t").alias("text"))


def bounded_fallback(versions: DataFrame, key: str, version: str, requested: Column, depth: int = 5) -> DataFrame:
    """The highest version in [requested - depth, requested], never below 1."""
    inside = F.col(version).between(F.greatest(requested - depth, F.lit(1)), requested)
    return versions.filter(inside).groupBy(key).agg(F.max(version).alias("resolved"))


def exact_or_latest(versions: DataFrame, key: str, version: str, requested: Column) -> DataFrame:
    return versions.groupBy(key).agg(F.coalesce(F.max(F.when(F.col(version) == requested, F.col(version))), F.max(version)).alias("resolved"))


def histogram(versions: DataFrame, version: str) -> DataFrame:
    """Templates that have a version, by version, with a label."""
    return versions.groupBy(version).agg(F.count(F.lit(1)).alias("templates")).withColumn("label", F.format_string("v%d (%d)", F.col(version), F.col("templates")))


def missing(wanted: DataFrame, stored: DataFrame, key: list[str], text: str) -> DataFrame:
    """What has a text and is not stored yet."""
    return wanted.filter(F.coalesce(F.trim(text), F.lit("")) != "").join(stored.select(*key), key, "left_anti")


def first_wins(candidates: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Of each key the first row by selector and ids."""
    best = candidates.groupBy(*key).agg(F.min(F.struct(*order, *keep)).alias("b"))
    return best.select(*key, *[F.col(f"b.{c}") for c in dict.fromkeys([*order, *keep])])


def check_new(rows: DataFrame, stored: DataFrame, key: str, version: str, text: str) -> DataFrame:
    """Every proposed version with the reason that speaks against it, or null."""
    seen = stored.select(F.col(key), F.col(version), F.lit(True).alias("_seen")).distinct()
    reason = F.when(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < 10, "text_too_short").when(F.coalesce(F.col(version) <= 0, F.lit(True)), "bad_version").when(F.col("_seen"), "exists")
    return rows.join(seen, [key, version], "left").withColumn("reject_reason", reason).drop("_seen")


def available(versions: DataFrame, key: str, version: str) -> DataFrame:
    """Number and descending list of a template's versions, as text."""
    a = F.sort_array(F.collect_set(version), asc=False)
    return versions.groupBy(key).agg(a.alias("_a")).select(key, F.size("_a").alias("n_versions"), F.concat_ws(",", F.col("_a").cast("array<string>")).alias("versions"), F.element_at("_a", 1).alias("max_version"))


def children(parents: DataFrame, kids: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Left outer one-to-many, the children as an ordered list of structs."""
    lists = kids.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("children"))
    return parents.join(lists, key, "left")


def summary_map(resolved: DataFrame, step: str, fields: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each group (one without): step -> struct, for the steps that resolved. A group's map is as large as it has steps."""
    return resolved.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(step), F.struct(*fields))))).alias("summary"))


def catalog_position(df: DataFrame, key: str, keys: list[str], unknown: int = 9999) -> DataFrame:
    """The place of a key in a fixed list; unknown keys come last."""
    table = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.lit(i) for i in range(len(keys))]))
    return df.withColumn("position", F.coalesce(F.try_element_at(table, F.col(key)), F.lit(unknown)))


def renumber(df: DataFrame, by: list[str], order: list[str], name: str = "index") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
