"""Assessment analytics: families, attempts, profiles, jobs, sections, visibility, trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlark.sources.config import cut


def exact_sum(c: Column) -> Column:
    """A sum of measures as decimals of six places, which no order of rows changes."""
    return F.sum(c.cast("decimal(18,6)"))


def family_stats(df: DataFrame, family: str, region: str, year: Column) -> DataFrame:
    """Frequency of a family in total and by region and year, in one pass (grouping sets)."""
    d = df.select(family, region, year.alias("year"))
    return d.groupingSets([(family,), (family, region), (family, "year")], family, region, "year").agg(F.count(F.lit(1)).alias("frequency"), F.grouping_id().alias("level"))


def attempt_metrics(df: DataFrame, by: list[str], correct: Column, score: Column, seconds: Column) -> DataFrame:
    """Rates leave out what is not judged (null)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("attempts"), F.count(correct).alias("judged"), F.round(F.avg(correct.cast("int")), 6).alias("correct_rate"), F.round(exact_sum(score), 2).cast("double").alias("score"), F.sum(seconds).alias("seconds"))


def session_profiles(df: DataFrame, student: str, ts: str, tag: str, correct: Column, score: Column, gap: str = "30 minutes") -> DataFrame:
    """(student, session_start, session_end, attempts, profile): of each session of a student a map from tag to its metrics.

    A session ends after ``gap`` without an attempt. Metrics are aggregated before they meet: a map is as large as there are tags."""
    e = df.withColumn("_session", F.col(ts).cast("timestamp"))
    one = e.groupBy(F.col(student), F.session_window("_session", gap).alias("_w")).agg(F.count(F.lit(1)).alias("attempts"))
    # each tag's metrics inside the sessions found: a join by range, inside a student
    spans = one.select(F.col(student), F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "attempts")
    e = e.select(F.col(student), "_session", F.col(tag).alias("_tag"), correct.alias("_correct"), score.alias("_score"))
    day = lambda c: F.to_date(c)
    spans_by_day = spans.withColumn("_day", F.explode(F.sequence(day("session_start"), day("session_end"))))
    inside = e.withColumn("_day", day("_session")).join(spans_by_day, [student, "_day"]).filter((F.col("_session") >= F.col("session_start")) & (F.col("_session") < F.col("session_end")))
    tags = inside.groupBy(student, "session_start", "session_end", "attempts", "_tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("_correct").cast("int")), 6).alias("rate"), F.round(exact_sum(F.col("_score")), 2).cast("double").alias("score"))
    entry = F.struct(F.col("_tag"), F.struct("n", "rate", "score"))
    return tags.groupBy(student, "session_start", "session_end", "attempts").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("profile"))


def latest_by(df: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The last row of each key, as an aggregate."""
    return df.groupBy(*by).agg(F.max(F.struct(*order, *keep)).alias("b")).select(*by, *[F.col(f"b.{c}") for c in [*order, *keep]])


def job_metrics(df: DataFrame, stage: str, status: str, start: str, end: str) -> DataFrame:
    return df.groupBy(stage, status).agg(F.count(F.lit(1)).alias("jobs"), F.sum(F.timestamp_diff("SECOND", F.col(start), F.col(end))).alias("seconds"))


#: Sections of a paper that each of its questions is compared with.
FEW_SECTIONS = 16


def in_section(questions: DataFrame, sections: DataFrame, paper: str, number: Column, lo: str, hi: str) -> DataFrame:
    """Range join inside a paper: a row for each question and section of its paper with lo <= number <= hi.

    An interval index: a section is the union of at most two aligned ranges of 2^l numbers for each l, and a question lies in one
    such range for each l. Both meet on paper, l and range, an equi-join that compares nothing it does not return: sections may
    overlap, have any length, and a single paper may hold all rows. Questions have rows for those l alone that
    sections use (32 at most). Where no paper has more than ``FEW_SECTIONS``, counted first, both meet on the paper alone. Null and negative numbers lie in no section; a section that ends before it starts is empty."""
    per_paper = sections.groupBy(paper).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if per_paper <= FEW_SECTIONS:  # a question meets a few sections at most
        inside = (F.col("_n") >= F.greatest(F.col(lo), F.lit(0))) & (F.col("_n") <= F.col(hi)) & F.col(lo).isNotNull()
        return questions.withColumn("_n", number.cast("bigint")).filter("_n >= 0").join(sections, paper).filter(inside).drop("_n")
    pieces = _pieces(sections, lo, hi)
    at = _placed(questions.withColumn("_n", number.cast("bigint")).filter("_n >= 0"), pieces)
    return at.join(pieces, [paper, "_level", "_place"]).drop("_n", "_level", "_place")


def _pieces(sections: DataFrame, lo: str, hi: str) -> DataFrame:
    """A row for each aligned range of a section."""
    return sections.withColumn("_r", F.explode(aligned(F.col(lo), F.col(hi)))).select(*sections.columns, F.col("_r.level").alias("_level"), F.col("_r.place").alias("_place"))


def _placed(at: DataFrame, pieces: DataFrame) -> DataFrame:
    """A row for each number _n and each level that ranges have, with its place there."""
    used = sorted(r["_level"] for r in pieces.select("_level").distinct().collect())  # 32 at most
    return at.withColumn("_level", F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumn("_place", F.expr("shiftright(_n, _level)"))


def aligned(lo: Column, hi: Column) -> Column:
    """The ranges of 2^level numbers, (level, place) from place * 2^level on, whose union is lo..hi: at each level the odd ends.

    At a level what is left of the range goes from ceil(lo / 2^level) to floor((hi + 1) / 2^level); no level beyond the range's own length has any."""
    start, end = F.greatest(lo, F.lit(0)).cast("bigint"), hi.cast("bigint") + 1
    piece = lambda level, place: F.struct(level.cast("int").alias("level"), place.cast("bigint").alias("place"))

    def step(level: Column) -> Column:
        a, b = F.negative(F.call_function("shiftright", F.negative(start), level)), F.call_function("shiftright", end, level)
        left, right = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        return F.array(F.when(left, piece(level, a)), F.when(right & ((b - 1 > a) | ~left), piece(level, b - 1)))

    found = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.log2(end - start)).cast("int")), step)), lambda x: x.isNotNull())
    return F.when(lo.isNotNull() & hi.isNotNull() & (start < end), found).otherwise(F.array().cast("array<struct<level:int,place:bigint>>"))


def section_sums(questions: DataFrame, sections: DataFrame, paper: str, number: Column, lo: str, hi: str, by: list[str]) -> DataFrame:
    """(by, questions, numbers): how many questions of its paper a section holds, and the sum of their numbers; none, no row.

    The index of ``in_section`` with each range's own count and sum: questions are counted by paper and range before they meet
    sections, so that rows are those of both sides, and never the pairs."""
    pieces = _pieces(sections, lo, hi)
    one = questions.select(F.col(paper), number.cast("bigint").alias("_n")).filter("_n >= 0").groupBy(paper, "_n").agg(F.count(F.lit(1)).alias("_count"))
    sums = _placed(one, pieces).groupBy(paper, "_level", "_place").agg(F.sum("_count").alias("_count"), F.sum(F.col("_count") * F.col("_n")).alias("_sum"))
    return sums.join(pieces, [paper, "_level", "_place"]).groupBy(*by).agg(F.sum("_count").alias("questions"), F.sum("_sum").alias("numbers"))


def visible(tenant: str, own: object) -> Column:
    """A tenant's rows and those of the platform."""
    return F.col(tenant).isNull() | (F.col(tenant) == own)


def licensed(flag: Column, expires: str, as_of: Column, *more: Column) -> Column:
    """Whether all flags of a use (commercial, AI, training) are set and the licence has not expired."""
    return reduce(lambda a, b: a & b, more, flag) & (F.col(expires).isNull() | (F.col(expires) > as_of))


def paths(nodes: DataFrame, node: str, parent: str, label: str, depth: int = 1 << 20, sep: str = "/") -> DataFrame:
    """Every node's path from its root, and its depth: each step doubles the number of ancestors that a path holds, so that
    a tree of depth d takes log2 d joins. A node whose parent is missing, and those below it, have a null path and depth; a
    tree deeper than ``depth``, or a cycle, is an error."""
    c = F.col
    now = nodes.select(c(node).alias("_id"), c(parent).alias("_up"), c(label).cast("string").alias("path"), F.lit(0).alias("depth"))
    for _ in range(max(1, depth).bit_length() + 1):
        now = cut(now)
        if now.filter("_up IS NOT NULL").isEmpty():
            return now.select(c("_id").alias(node), "path", "depth")
        up = now.select(c("_id").alias("_up"), c("_up").alias("_next"), c("path").alias("_p"), c("depth").alias("_d"))
        far = now.filter("_up IS NOT NULL").join(up.withColumn("_there", F.lit(True)), "_up", "left")
        there = c("_there") & c("_d").isNotNull()  # else its parent, or one further up, is missing
        step = far.select("_id", F.when(there, c("_next")).alias("_up"), F.when(there, F.concat_ws(sep, "_p", "path")).alias("path"), F.when(there, c("depth") + c("_d") + 1).alias("depth"))
        now = now.filter("_up IS NULL").unionByName(step)
    raise ValueError(f"the tree is deeper than {depth}, or has a cycle")


def family_maps(df: DataFrame, family: str, region: str, year: Column) -> DataFrame:
    """A family's frequency, and its maps by region and by year; maps are as large as there are regions and years."""
    s = family_stats(df, family, region, year)
    key = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(k).isNotNull() & (F.col("level") != 3), F.struct(F.col(k).cast("string"), "frequency")))))
    return s.groupBy(family).agg(F.max(F.when(F.col("level") == 3, F.col("frequency"))).alias("frequency"), key(region).alias("by_region"), key("year").alias("by_year"))


def align(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of both sides and where they are."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(True)), right.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "left_only").otherwise("right_only")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))
