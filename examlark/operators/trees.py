"""Walks over JSON trees of any shape and depth, as Spark's VARIANT.

A document is parsed once. Each step takes the children of all containers of a level with ``variant_explode_outer``, and
is cut off by a checkpoint; it ends at the level without containers, so that the number of steps is the depth
of the deepest document and no schema has to be known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlark.sources.config import cut


def container(v: Column | str) -> Column:
    """Whether a variant is an object or array."""
    kind = F.schema_of_variant(v)
    return F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))


def walk(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each node of each document: key, depth (0: the root), path, pos, name, v, empty.

    pos is the place in its parent, name the field's name (null in arrays). An empty object or array has, besides its own row, an outer row
    one level deeper whose v is null and empty is true. Text that is no JSON, and null, is one root with a null v."""
    root = df.select(F.col(key).alias("key"), F.lit(0).alias("depth"), F.lit("$").alias("path"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("name"), F.try_parse_json(F.col(text)).alias("v"), F.lit(False).alias("empty"))
    levels = [cut(root)]
    while True:
        up = levels[-1].filter(F.col("v").isNotNull() & container("v")).select("key", "depth", "path", F.col("v").alias("up"))
        if up.isEmpty():
            return reduce(DataFrame.unionByName, levels).withColumnRenamed("key", key)
        kids = up.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("up").outer()).toDF("pos", "name", "v"))
        step = F.coalesce(F.concat(F.lit("."), F.col("name")), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")), F.lit("[]"))
        levels.append(cut(kids.select("key", (F.col("depth") + 1).alias("depth"), F.concat("path", step).alias("path"), "pos", "name", "v", F.col("pos").isNull().alias("empty"))))


def field(name: str, kind: str = "string") -> Column:
    """A field of each node that is an object; null for others."""
    return F.try_variant_get("v", f"$.{name}", kind)


def kind_counts(nodes: DataFrame, key: str) -> DataFrame:
    """(key, depth, type, n): nodes that name their type."""
    return nodes.select(key, "depth", field("type").alias("type")).filter("type IS NOT NULL").groupBy(key, "depth", "type").agg(F.count(F.lit(1)).alias("n"))


def count_kind(df: DataFrame, key: str, text: str, kind: str, name: str = "n") -> DataFrame:
    """(key, n): nodes of a type, at any depth; documents without one have 0."""
    return walk(df, key, text).groupBy(key).agg(F.count(F.when(field("type") == kind, 1)).alias(name))
