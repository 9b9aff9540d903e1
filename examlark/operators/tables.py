"""Writes to relational tables, expressed as DataFrames: upsert, insert, update, constraints, cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlark.sources.config import cut


def upsert(current: DataFrame, catalog: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """All rows after the merge and what happened: inserted, updated, unchanged, kept (not in the catalogue)."""
    a = current.select(F.col(key), *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(True).alias("_a"))
    b = catalog.select(F.col(key), *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(True).alias("_b"))
    differs = reduce(lambda x, y: x | y, [~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")) for f in fields])
    action = F.when(F.col("_a").isNull(), "inserted").when(F.col("_b").isNull(), "kept").when(differs, "updated").otherwise("unchanged")
    j = a.join(b, key, "full_outer").withColumn("action", action)
    return j.select(key, *[F.when(F.col("_b").isNull(), F.col(f"_a_{f}")).otherwise(F.col(f"_b_{f}")).alias(f) for f in fields], "action")


def numbered(rows: DataFrame, order: list[str], name: str, slices: int | None = None) -> DataFrame:
    """Dense numbers from 1 in an order, without bringing the rows together: rows are dealt by ranges of the order into as many
    slices as shuffles have partitions (or ``slices``), so that a slice holds no more than any other shuffle's.

    A row's number is its place in its slice after the rows of the slices before. Slices are written once, so that nothing
    changes if a task runs again. Rows that the order does not tell apart have numbers in any order."""
    parts = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_r", F.monotonically_increasing_id()))  # slice << 33 | place
    slice_ = F.shiftright("_r", 33)
    sizes = sorted((r["s"], r["n"]) for r in placed.groupBy(slice_.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each slice
    before, at = [], 0
    for s, n in sizes:
        before.append((s, at))
        at += n
    table = rows.sparkSession.createDataFrame(before, "_s bigint, _before bigint")
    return placed.join(F.broadcast(table), slice_ == F.col("_s")).withColumn(name, F.col("_before") + F.col("_r").bitwiseAND((1 << 33) - 1) + 1).drop("_s", "_r", "_before")


def insert(current: DataFrame, rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The new rows with dense ids after the largest so far."""
    top = current.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    return numbered(rows, order, id_col).crossJoin(F.broadcast(top)).withColumn(id_col, (F.col("_top") + F.col(id_col)).cast("bigint")).drop("_top")  # one row


def update(df: DataFrame, where: Column, values: dict[str, Column], check: Column | None = None) -> DataFrame:
    """Point update of the rows that meet both conditions."""
    hit = where if check is None else where & check
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Children whose parent is missing; a null reference is none."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def cascade_delete(child: DataFrame, deleted: DataFrame, fk: str, pk: str) -> DataFrame:
    return child.join(deleted.select(F.col(pk).alias(fk)), fk, "left_anti")


def polymorphic(links: DataFrame, kinds: dict[str, tuple[DataFrame, str, str]], kind: str, ref: str) -> DataFrame:
    """links joined with the table that their kind names: kinds maps it to (table, id, label)."""
    parts = []
    for name, (table, key, label) in kinds.items():
        t = table.select(F.col(key).alias(ref), F.col(label).cast("string").alias("target_label"))
        parts.append(links.filter(F.col(kind) == name).join(t, ref))
    return reduce(DataFrame.unionByName, parts)


def array_difference(wanted: Column, known: Column) -> Column:
    """Items that are not known."""
    return F.array_except(wanted, known)


def modes(wanted: Column, known: list[str]) -> Column:
    """The wanted modes, all if none are named, with those that they need: clean and hybrid need raw, hybrid also clean and picture."""
    w = F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, F.array(*map(F.lit, known))).otherwise(wanted)
    need = lambda when, then: F.when(F.arrays_overlap(w, F.array(*map(F.lit, when))), F.array(*map(F.lit, then))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(w, need(["clean", "hybrid"], ["raw"]), need(["hybrid"], ["clean", "picture"]))))


def modes_of(text: str, known: list[str]) -> list[str]:
    """The modes that a comma-separated option names, all if none; an unknown one is an error."""
    asked = [m.strip() for m in text.split(",") if m.strip()]
    if unknown := [m for m in asked if m not in known]:
        raise ValueError(f"unknown modes {unknown}, known are {known}")
    return asked or list(known)


def comment_ddl(table: str, comment: str, columns: dict[str, str]) -> list[str]:
    """COMMENT statements, quotes doubled as Spark SQL escapes them."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return [f"COMMENT ON TABLE `{table}` IS {q(comment)}", *[f"ALTER TABLE `{table}` ALTER COLUMN `{c}` COMMENT {q(t)}" for c, t in columns.items()]]


def quoted(text: Column) -> Column:
    """A string literal of Spark SQL."""
    return F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def comment_statement(table: Column, comment: Column) -> Column:
    """The COMMENT statement of each row's table."""
    return F.concat(F.lit("COMMENT ON TABLE `"), table, F.lit("` IS "), quoted(comment))


def drop_statement(table: Column) -> Column:
    return F.concat(F.lit("DROP TABLE IF EXISTS `"), table, F.lit("`"))


def write_document(df: DataFrame, path: str) -> None:
    """The first row (a run's summary) as one JSON document in UTF-8, not escaped; df has one row."""
    write_text(df.limit(1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("js")).first()["js"], path)


def write_text(text: str, path: str) -> None:
    """A small file in UTF-8."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as out:
        out.write(text.encode())


def write_summary(df: DataFrame, path: str) -> None:
    """JSON lines; the summary of a run is small."""
    df.write.mode("overwrite").json(path)


def create_ddl(table: str, schema, if_absent: bool = True) -> str:  # noqa: ANN001
    """CREATE TABLE from a StructType; a field's metadata may hold its comment."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}{' COMMENT ' + q(f.metadata['comment']) if f.metadata.get('comment') else ''}" for f in schema.fields)
    return f"CREATE TABLE {'IF NOT EXISTS ' if if_absent else ''}`{table}` ({cols}) USING parquet"


def drop_ddl(table: str) -> str:
    return f"DROP TABLE IF EXISTS `{table}`"


def drop_all_ddl(references: dict[str, list[str]]) -> list[str]:
    """Drops of all tables, those that reference others first."""
    return [drop_ddl(t) for t in reversed(create_order(references))]


def clear_comments_ddl(table: str, columns: list[str]) -> list[str]:
    """Takes the comments of a table and its columns away."""
    return [f"COMMENT ON TABLE `{table}` IS NULL", *[f"ALTER TABLE `{table}` ALTER COLUMN `{c}` COMMENT ''" for c in columns]]


def cluster_ddl(table: str, columns: list[str]) -> str:
    """What Spark has in place of an index: the rows of each key together in files, for pruning."""
    return f"ALTER TABLE `{table}` CLUSTER BY ({', '.join(f'`{c}`' for c in columns)})"


def create_order(references: dict[str, list[str]]) -> list[str]:
    """Tables in an order in which those that they reference come first, as far as there are no cycles."""
    done: list[str] = []
    rest = dict(references)
    while rest:
        ready = sorted(t for t, r in rest.items() if all(x in done or x == t or x not in references for x in r)) or [min(rest)]
        done += ready
        rest = {t: r for t, r in rest.items() if t not in done}
    return done
