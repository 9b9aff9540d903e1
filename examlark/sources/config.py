"""Where tables are: resolving the warehouse from the environment."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that mean yes.
YES = ["1", "true", "yes", "on"]
#: Environments without a fallback.
PRODUCTION = ["prod", "production", "staging"]


def env_flag(env: Mapping[str, str], name: str, default: bool = False) -> bool:
    value = env.get(name)
    return default if value is None else value.strip().lower() in YES


def resolve_warehouse(env: Mapping[str, str] | None = None, default: str = "warehouse") -> str:
    """The configured place, else the default; in production and staging that is an error, unless ALLOW_SQLITE_FALLBACK permits it."""
    env = os.environ if env is None else env
    if url := (env.get("DATABASE_URL") or "").strip():
        return url
    if (env.get("APP_ENV") or "").strip().lower() in PRODUCTION and not env_flag(env, "ALLOW_SQLITE_FALLBACK"):
        raise RuntimeError("DATABASE_URL must be set in production")
    return default


def scan(spark: SparkSession, sf_dir: str, table: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def catalog(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A list in the program as a table, which is broadcast if it is small."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= 10_000 else table


def first_executable(*candidates: str | None) -> str | None:
    """The first candidate that is a command on the PATH, or a path that exists; as the path that was found."""
    for c in candidates:
        if c and (found := shutil.which(c) or (c if Path(c).exists() else None)):
            return found
    return None


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's place below the shared one that spark.checkpoint.dir names; a temporary one only on a local master."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_examlark_work", None)
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = sc._examlark_work = "file://" + tempfile.mkdtemp(prefix="examlark-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: computed once, read by columns, without lineage."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, from the folder that spark.checkpoint.dir names; a temporary one only on a local master."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="examlark-"))
    return df.checkpoint()
