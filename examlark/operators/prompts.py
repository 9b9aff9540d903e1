"""Steps and their templates, end to end: gate, version choice, rendering, tags. All steps in one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlark.functions.scalars import coverage, parse_version, render
from examlark.operators.analytics import exact_sum
from examlark.operators.versions import chosen, source_of


def resolve_steps(steps: DataFrame, versions: DataFrame, variables: Column, override: Column | None = None) -> DataFrame:
    """steps (step_key, prompt_key, selected_version, is_active), versions (prompt_key, version, status, prompt_text).

    An inactive step resolves to nothing, with no fallback. The override counts before the step's own version;
    config_source only tells whether the step has a version of its own. A template without versions resolves to nothing."""
    own = parse_version("selected_version")
    asked = own if override is None else F.coalesce(parse_version(override), own)
    s = steps.filter("is_active").withColumn("requested_version", asked).withColumn("config_source", F.when(own.isNull(), "latest").otherwise("step_config")).withColumn("_vars", variables)
    s = s.withColumn("requested", F.col("requested_version").cast(versions.schema["version"].dataType))
    best = chosen(s.select("step_key", "prompt_key", "requested_version", "requested", "config_source", "_vars"), versions, "prompt_key", "version", "status", "prompt_text").filter("b IS NOT NULL")
    return best.select("step_key", "prompt_key", "requested_version", F.col("b.v").alias("resolved_version"), source_of().alias("version_source"), "config_source", render("b.t", "_vars").alias("prompt_text"))


def bound_to(steps: DataFrame, parent: str, key: str, order: str) -> DataFrame:
    """Reverse lookup: the steps of each template, in order."""
    lists = F.sort_array(F.collect_list(F.struct(order, key)))
    return steps.groupBy(parent).agg(F.transform(lists, lambda x: x[key]).alias("step_keys"))


def seed_text(seeds: DataFrame, key: str, version: str, text: str, wanted: Column, variables: Column) -> DataFrame:
    """The wanted seed, else the highest; rendered."""
    order = F.struct(F.coalesce(F.col(version) == wanted, F.lit(False)).alias("hit"), F.col(version).alias("v"), F.col(text).alias("t"))
    best = seeds.groupBy(key).agg(F.max(order).alias("b"))
    return best.select(key, F.col("b.v").alias(version), render("b.t", variables).alias(text))


def route_page(page_type: Column, exam: str, answer: str, mixed: str, default: str) -> Column:
    """The template of a page's type."""
    return F.when(page_type == "exam_paper", exam).when(page_type == "answer_sheet", answer).when(page_type == "mixed", mixed).otherwise(default)


def number_sets(df: DataFrame, doc: str, set_: str, order: str) -> DataFrame:
    """Number of the set in its document and of the sheet in its set, in order of appearance."""
    first = df.groupBy(doc, set_).agg(F.min(order).alias("_first"))
    first = first.withColumn("set_no", F.row_number().over(Window.partitionBy(doc).orderBy("_first", set_))).drop("_first")
    return df.join(first, [doc, set_]).withColumn("sheet_no", F.row_number().over(Window.partitionBy(doc, set_).orderBy(order)))


def compare_strategies(results: DataFrame, mode: str, seconds: str, hash_: str, expected: int) -> DataFrame:
    """Per strategy: how many, coverage, distinct hashes, time."""
    n = F.count(F.lit(1))
    return results.groupBy(mode).agg(n.alias("n"), coverage(n, F.lit(expected)).alias("coverage_ratio"), F.count_distinct(hash_).alias("distinct_hashes"), F.round(exact_sum(F.col(seconds)), 2).cast("double").alias("elapsed_seconds"))


def export_counts(df: DataFrame, kind: str, path: str, error: str) -> DataFrame:
    """Exported, failed and pathless records of each kind that was emitted."""
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(path).isNotNull()).alias("exported"), F.count_if(F.col(error).isNotNull()).alias("failed"))
