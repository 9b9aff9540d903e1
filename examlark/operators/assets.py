"""Cleaning and merging of extracted image entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlark.functions.scalars import coverage, first_number


def drop_reason(missing: Column, width: Column, height: Column, size: Column, near_white: Column, tiny_px: int = 10, low_bytes: int = 120) -> Column:
    """Why an entry is dropped, in fixed precedence; null if it passes."""
    w, h, b = first_number(width), first_number(height), first_number(size)
    return (
        F.when(missing, "missing")
        .when((w > 0) & (h > 0) & ((w <= tiny_px) | (h <= tiny_px)), "tiny")
        .when((b > 0) & (b <= low_bytes), "low_bytes")
        .when(near_white, "near_white")
    )


def clean(entries: DataFrame, group: str, index: str, hash_: str, reason: Column, max_items: int) -> DataFrame:
    """Adds `reason` (with duplicate_hash) and `clean_index` (null if dropped); entries after the scan's stop are left out.

    A duplicate is an entry that passes but is not the first of its hash among those that do; an empty hash never
    repeats. The scan stops when max_items are kept: that place comes from a rank that Spark limits before it
    shuffles, so that a group's entries are not brought together for it."""
    e = entries.withColumn("reason", reason)
    passing = e.filter(F.col("reason").isNull() & (F.coalesce(F.col(hash_), F.lit("")) != ""))
    first = passing.groupBy(group, hash_).agg(F.min(index).alias("_first"))
    e = e.join(first, [group, hash_], "left")
    e = e.withColumn("reason", F.when(F.col("reason").isNull() & (F.col(index) > F.col("_first")), "duplicate_hash").otherwise(F.col("reason"))).drop("_first")
    w = Window.partitionBy(group).orderBy(index)
    kept = e.filter("reason IS NULL").select(group, index).withColumn("clean_index", F.row_number().over(w)).filter(F.col("clean_index") <= max_items)
    stop = kept.filter(F.col("clean_index") == max_items).select(group, F.col(index).alias("_stop"))
    e = e.join(stop, group, "left").filter(F.col("_stop").isNull() | (F.col(index) <= F.col("_stop"))).drop("_stop")
    return e.join(kept, [group, index], "left")


def drop_counts(cleaned: DataFrame, group: str) -> DataFrame:
    return cleaned.filter("reason IS NOT NULL").groupBy(group, "reason").agg(F.count(F.lit(1)).alias("dropped"))


def distinct_by_hash(entries: DataFrame, index: str, hash_: str) -> DataFrame:
    """First of each hash; entries without one all stay."""
    none = F.coalesce(F.col(hash_), F.lit("")) == ""
    first = entries.filter(~none).groupBy(hash_).agg(F.min(index).alias(index))
    return entries.filter(none).unionByName(entries.join(first, [hash_, index], "left_semi").select(*entries.columns))


def duplicate_groups(entries: DataFrame, hash_: str) -> DataFrame:
    """How many hashes occur more than once."""
    n = entries.filter(F.coalesce(F.col(hash_), F.lit("")) != "").groupBy(hash_).count().filter("count > 1")
    return n.agg(F.count(F.lit(1)).alias("duplicate_hash_count"))


def hybrid_union(primary: DataFrame, fallback: DataFrame, index: str, hash_: str, expected: int, max_items: int) -> DataFrame:
    """Primary entries, then fallback ones, distinct by hash, at most expected (or max_items), tagged and renumbered."""
    both = primary.withColumn("source", F.lit("primary")).withColumn("_o", F.lit(0)).unionByName(fallback.withColumn("source", F.lit("fallback")).withColumn("_o", F.lit(1)))
    none = F.coalesce(F.col(hash_), F.lit("")) == ""
    first = both.filter(~none).groupBy(hash_).agg(F.min(F.struct("_o", index)).alias("_f"))
    j = both.join(first, hash_, "left").filter(F.col("_f").isNull() | ((F.col("_f._o") == F.col("_o")) & (F.col(f"_f.{index}") == F.col(index))))
    limit = min(expected if expected > 0 else max_items, max_items)
    top = j.orderBy("_o", index).limit(limit)  # top-n: a partial one in every task, at most `limit` rows meet
    return top.withColumn("hybrid_index", F.row_number().over(Window.orderBy("_o", index))).drop("_o", "_f")


def metrics(entries: DataFrame, group: str, width: str, height: str, size: str, expected: Column, near_white: Column | None = None, tiny_px: int = 12) -> DataFrame:
    """Per group: entries, tiny and nearly white ones, bytes and coverage."""
    w, h = first_number(width), first_number(height)
    return entries.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((w > 0) & (h > 0) & ((w <= tiny_px) | (h <= tiny_px))).alias("tiny_image_count"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(F.lit(False) if near_white is None else near_white).alias("near_white_count"),
        coverage(F.count(F.lit(1)), expected).alias("coverage_ratio"),
    )


def run_summary(df: DataFrame, status: Column, amount: Column) -> DataFrame:
    """Counts by status, and a sum that is 0 over nothing."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status == "success").alias("succeeded"), F.count_if(status == "skipped").alias("skipped"), F.count_if(status == "failed").alias("failed"),
        F.coalesce(F.sum(amount), F.lit(0)).alias("amount"),
    )
