"""Steps bound to providers and models: joins, named resolution, fallback chains, seeding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlark.functions.scalars import supports_vision


def bound_steps(steps: DataFrame, providers: DataFrame, models: DataFrame) -> DataFrame:
    """steps (step, provider_id, model_id, is_active) left joined with both, and whether the binding is complete."""
    j = steps.join(providers, "provider_id", "left").join(models.withColumnRenamed("provider_id", "model_provider_id"), "model_id", "left")
    whole = F.col("is_active") & F.col("provider_name").isNotNull() & F.col("model_name").isNotNull() & (F.col("model_provider_id") == F.col("provider_id"))
    return j.withColumn("is_complete", F.coalesce(whole, F.lit(False)))


def first_available(providers: DataFrame, models: DataFrame, by_provider: bool = False) -> DataFrame:
    """The first model that takes images, else the first, by provider and model; overall or of each provider."""
    j = models.join(providers, "provider_id")
    order = F.struct((~supports_vision("model_name")).alias("plain"), F.col("provider_id"), F.col("model_id"), F.col("provider_name"), F.col("model_name"))
    best = j.groupBy(*(["provider_id"] if by_provider else [])).agg(F.min(order).alias("b")).filter("b IS NOT NULL")
    return best.select(F.col("b.provider_id"), F.col("b.provider_name"), F.col("b.model_id"), F.col("b.model_name"), (~F.col("b.plain")).alias("vision"))


def resolve_named(requests: DataFrame, providers: DataFrame, models: DataFrame) -> DataFrame:
    """requests (request_id, want_provider, want_model): names are trimmed and compared without case.

    Both: the model of that provider, or the provider alone. A model alone: the smallest id of that name with its
    provider. A provider alone: it with its smallest model. An unknown provider, or nothing asked: nothing."""
    norm = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    r = requests.withColumn("_p", norm("want_provider")).withColumn("_m", norm("want_model"))
    p = providers.groupBy(F.lower("provider_name").alias("_p")).agg(F.min(F.struct("provider_id", "provider_name")).alias("p"))
    by_both = models.groupBy("provider_id", F.lower("model_name").alias("_m")).agg(F.min("model_id").alias("both_id"))
    by_name = models.join(providers, "provider_id").groupBy(F.lower("model_name").alias("_m")).agg(F.min(F.struct("model_id", "provider_id")).alias("n"))
    smallest = models.groupBy("provider_id").agg(F.min("model_id").alias("least_id"))
    j = r.join(p, "_p", "left").withColumn("provider_id", F.col("p.provider_id"))
    j = j.join(by_both, ["provider_id", "_m"], "left").join(by_name, "_m", "left").join(smallest, "provider_id", "left")
    both, only_m, only_p = (F.col("_p").isNotNull() & F.col("_m").isNotNull()), (F.col("_p").isNull() & F.col("_m").isNotNull()), (F.col("_p").isNotNull() & F.col("_m").isNull())
    provider = F.when(both | only_p, F.col("provider_id")).when(only_m, F.col("n.provider_id"))
    model = F.when(both, F.col("both_id")).when(only_m, F.col("n.model_id")).when(only_p, F.col("least_id"))
    return j.select("request_id", provider.alias("provider_id"), F.when(provider.isNotNull(), model).alias("model_id"))


def fallback_chain(df: DataFrame, active: str, choices: list[tuple[str, str]]) -> DataFrame:
    """The first choice (column, tag) that is not null, of active rows only; an existing inactive row resolves to nothing."""
    value, tag = F.coalesce(*[F.col(c) for c, _ in choices]), F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(t)) for c, t in choices])
    return df.filter(F.col(active)).withColumn("resolved", value).withColumn("config_source", tag).filter(F.col("resolved").isNotNull())


def fill_binding(steps: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """Where provider or model is null and the seed has both, both come from the seed."""
    s = seeds.select(F.col(key), F.col("provider_id").alias("_sp"), F.col("model_id").alias("_sm"))
    take = (F.col("provider_id").isNull() | F.col("model_id").isNull()) & F.col("_sp").isNotNull() & F.col("_sm").isNotNull()
    j = steps.join(s, key, "left").withColumn("_take", F.coalesce(take, F.lit(False)))
    return j.withColumns({"provider_id": F.when(F.col("_take"), F.col("_sp")).otherwise(F.col("provider_id")), "model_id": F.when(F.col("_take"), F.col("_sm")).otherwise(F.col("model_id"))}).withColumnRenamed("_take", "seeded").drop("_sp", "_sm")


def seed_by_strategy(df: DataFrame, strategy: str, named: str, vision: str, available: str) -> DataFrame:
    """named -> first_vision -> first_available, as the strategy says."""
    s = F.col(strategy)
    return df.withColumn("seed", F.when(s == "named", F.col(named)).when(s == "first_vision", F.coalesce(F.col(vision), F.col(available))).when(s == "first_available", F.col(available)))
