"""Tables of a relational database as a source, by JDBC, or of a warehouse of Parquet, as DATABASE_URL says.

A scan is cut into ranges of a numeric column whose bounds the database itself is asked for; filters and columns are the
database's work, aggregates and limits where its dialect in Spark has them. Drivers are those on Spark's class path.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlark.sources.config import resolve_warehouse

#: Rows that one connection reads, about, and connections at once, at most.
ROWS, CONNECTIONS = 1_000_000, 64


def read_jdbc(spark: SparkSession, url: str, table: str, by: str | None = None, rows: int = ROWS, options: Mapping[str, str] | None = None) -> DataFrame:
    """A table; with ``by`` (a column of whole numbers without many gaps) in ranges, each read by a task of its own.

    Rows whose ``by`` is null are in the first range. An empty table, or one small enough, is one range."""
    reader = lambda: spark.read.format("jdbc").option("url", url).option("dbtable", table).option("pushDownAggregate", "true").option("pushDownLimit", "true").options(**dict(options or {}))
    one = reader().load()
    if by is None:
        return one
    low, high, n = one.agg(F.min(by), F.max(by), F.count(F.lit(1))).first()  # the database counts
    parts = min(CONNECTIONS, -(-n // rows))
    if low is None or parts < 2:
        return one
    return reader().option("partitionColumn", by).option("lowerBound", int(low)).option("upperBound", int(high) + 1).option("numPartitions", parts).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "error", options: Mapping[str, str] | None = None) -> None:
    """Writes a table by at most CONNECTIONS tasks; each commits its own rows."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("numPartitions", CONNECTIONS).options(**dict(options or {})).mode(mode).save()


def table(spark: SparkSession, name: str, env: Mapping[str, str] | None = None, by: str | None = None) -> DataFrame:
    """A table of the configured warehouse: by JDBC if DATABASE_URL is of that form, else Parquet below that folder."""
    place = resolve_warehouse(env)
    return read_jdbc(spark, place, name, by) if place.startswith("jdbc:") else spark.read.parquet(f"{place.rstrip('/')}/{name}.parquet")
