"""The corpus pipeline: language ID, line dedup, near-duplicate join, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on what its predecessor kept, and is written and read again.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlark.llm import bpe, common, langid, lines, mixing, ngram_join


def _renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


#: Least cosine with a language's prototype: about the standard deviation of the cosine of unrelated vectors, 1 / sqrt(512).
MIN_COSINE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that resemble no language that can be learnt; of the others, lang becomes
    the predicted language, which mixing then weighs.

    Null and empty texts have no letter; a null or wrong lang is replaced; if no row has a language, nothing can be
    learnt and every document goes; repeated rows are judged alike; clashing column names pass through."""
    pred, score = ("_" * (1 + max(map(len, docs.columns))) + x for x in ("pred", "score"))  # longer than any other name
    found = langid.identify(docs, langid.learn(docs), docs.columns, names=(pred, score))
    found = found.filter((F.col(pred) != langid.UND) & (F.col(score) >= MIN_COSINE))
    return _renamed(found.withColumn("lang", F.col(pred).cast(docs.schema["lang"].dataType)), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go, and documents of which nothing but white space is left; n_chars follows the text.

    Null, empty and blank texts stay as they are; equal rows are one document, and lose the same lines."""
    done = lines.dedup_lines(docs, min_tokens=lines.ALL)
    gone = (F.col("lines_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    done = done.filter(~F.coalesce(gone, F.lit(False)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _renamed(done, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id stays (a null one is the smallest).

    Rows are told apart by doc_id and text, so that texts of one doc_id, or of null ones, are judged one by one; of rows
    that are equal in both, one stays, the first by its other columns. Texts without a word are near nothing and stay.
    An empty table stays empty."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(1)).alias("_key"), row.alias("_row"))
    found = ngram_join.near_duplicates(keyed.select("_key", F.col("_row.text").alias("text")), doc_id="_key", words=5, num=80)
    found = common.materialize(found, "near-duplicates")
    groups = common.materialize(found.filter("component_id <> _key").select("component_id").distinct(), "groups")
    members = common.keep_ids(found.select("_key", "component_id"), groups, "component_id").distinct()
    members = members.join(docs.select(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(1)).alias("_key"), "doc_id"), "_key")
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("first"))
    drop = common.materialize(members.join(first, "component_id").filter("_key <> first._key").select("_key").distinct(), "dropped")
    rest = common.keep_ids(keyed, drop, "_key", "left_anti")
    equal = common.materialize(found.filter("n_shingles > 0").groupBy("_key").count().filter("count > 1").select("_key"), "equal-rows")
    if not equal.isEmpty():
        others = F.to_json(F.struct(*[F.col(f"_row.`{c}`") for c in docs.columns if c != "text"]))
        one = common.keep_ids(rest, equal, "_key").groupBy("_key").agg(F.min_by("_row", others).alias("_row"))
        rest = common.keep_ids(rest, equal, "_key", "left_anti").unionByName(one)
    return rest.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the budgets choose; a document of two epochs appears twice.

    Texts without a word are never chosen; null languages and sources are leaves of their own; equal doc_ids go together."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")  # its columns may have the names of new ones
    chosen = mixing.mix(docs.select("doc_id", "text", "lang", "source", whole), mixing.WEIGHTS, share=0.5)
    copies = chosen.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, checked by decoding them; a null or empty text has none."""
    both = bpe.encode(docs.select("doc_id", "text", "lang", "source"), ["doc_id", "text", "lang", "source"], decoded=True)
    return both.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing_to_weights),
    ("bpe", tokens),
]
#: SQL can express neither the hyperdimensional profiles nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
