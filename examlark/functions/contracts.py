"""Contracts of structured model output: schemas for from_json and the constraints they state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "array<int>"
CORNERS = f"struct<top_left:{POINT},top_right:{POINT},bottom_right:{POINT},bottom_left:{POINT}>"
#: The fields that model output has.
CONTRACTS: dict[str, str] = {
    "page_corners": f"corners {CORNERS}, has_perspective_distortion boolean",
    "page_type": "is_exam_paper boolean, page_type string, confidence string, reason string",
    "sheet_types": "array<struct<type:string,order:int,physical_index:int,reason:string>>",
    "regions": f"questions array<struct<number:string,type:string,description:string,points:{CORNERS}>>",
    "answer_card": "map<string,string>",
    "whole_page": "questions array<struct<number:string,question_bbox:array<int>,answer_bbox:array<int>>>",
    "single_question": "question_number string, question_content string, question_type string, options map<string,string>, has_diagram boolean, has_formula boolean, recognition_confidence double",
    "keywords": "keywords array<string>",
    "observation": "question_summary string, answer_observation string, answer_status_assessment string, correctness string, knowledge_points array<string>, suspected_error_causes array<string>, reasoning_basis array<string>, recommended_next_action string, confidence double",
    "conclusion": "summary string, answer_status string, correctness string, mastery_level string, knowledge_points array<string>, error_causes array<string>, study_advice array<string>, supporting_evidence array<string>, explanation string, recommended_next_action string, confidence double",
    "knowledge": "entities array<struct<name:string,context:string>>, relationships array<struct<source:string,target:string,type:string>>",
}


def parse(text: Column | str, contract: str) -> Column:
    """The parsed output; text that is no JSON, or of another shape, gives null fields."""
    return F.from_json(F.col(text) if isinstance(text, str) else text, CONTRACTS[contract])


def _point_ok(p: Column) -> Column:
    return p.isNotNull() & (F.size(p) == 2) & F.forall(p, lambda x: x.between(0, 1000))


def corners_ok(c: Column) -> Column:
    """Four points in 0..1000 that form a convex shape, in order."""
    names = ["top_left", "top_right", "bottom_right", "bottom_left"]
    pts = [c[n] for n in names]
    turns = []
    for i in range(4):
        a, b, d = pts[i], pts[(i + 1) % 4], pts[(i + 2) % 4]
        turns.append((b[0] - a[0]) * (d[1] - b[1]) - (b[1] - a[1]) * (d[0] - b[0]))
    ok = _point_ok(pts[0]) & _point_ok(pts[1]) & _point_ok(pts[2]) & _point_ok(pts[3])
    return F.coalesce(ok & (F.greatest(*[t * -1 for t in turns]) <= 0), F.lit(False))


def page_type_ok(r: Column, types: list[str]) -> Column:
    return F.coalesce(r["is_exam_paper"].isNotNull() & r["page_type"].isin(*types), F.lit(False))


def sheet_types_ok(a: Column, n: Column, longest: int = 40) -> Column:
    """As many items as sheets, distinct places, short reasons."""
    places = F.transform(a, lambda x: x["physical_index"])
    return F.coalesce(
        (F.size(a) == n) & (F.size(F.array_distinct(places)) == n) & ~F.exists(places, lambda x: x.isNull()) & F.forall(a, lambda x: F.coalesce(F.length(x["reason"]), F.lit(0)) <= longest), F.lit(False)
    )


def answer_card_ok(m: Column) -> Column:
    """Numbers from 1 without gaps; answers A to D or EMPTY."""
    keys = F.transform(F.map_keys(m), lambda k: k.try_cast("int"))
    return F.coalesce((F.size(m) > 0) & (F.array_max(keys) == F.size(m)) & (F.array_min(keys) == 1) & (F.size(F.array_distinct(keys)) == F.size(m)) & F.forall(F.map_values(m), lambda v: v.isin("A", "B", "C", "D", "EMPTY")), F.lit(False))


def keywords_ok(k: Column) -> Column:
    return F.coalesce(F.size(k["keywords"]).between(3, 6), F.lit(False))


def knowledge_edges(df: DataFrame, parsed: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of extracted knowledge; an edge needs both its ends."""
    v = df.select(key, F.explode(f"{parsed}.entities").alias("e")).select(key, "e.name", "e.context").filter("name IS NOT NULL").dropDuplicates([key, "name"])
    e = df.select(key, F.explode(f"{parsed}.relationships").alias("r")).select(key, "r.source", "r.target", "r.type")
    for end in ("source", "target"):
        e = e.join(v.select(key, F.col("name").alias(end)), [key, end], "left_semi")
    return v, e.select(key, "source", "target", "type")


#: States of an answer, of its correctness, and of a learner's mastery.
ANSWER_STATES, CORRECTNESS, MASTERY = ["answered", "uncertain", "unanswered"], ["correct", "incorrect", "uncertain", "unknown"], ["mastered", "partial", "weak", "unknown"]


def _given(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def regions_ok(r: Column, types: list[str]) -> Column:
    """At least one question; each with a number, a known type, and four corners in 0..1000 that form a convex shape."""
    good = lambda q: F.coalesce(_given(q["number"]) & q["type"].isin(*types) & corners_ok(q["points"]), F.lit(False))
    return F.coalesce((F.size(r["questions"]) > 0) & F.forall(r["questions"], good), F.lit(False))


def _box_ok(b: Column) -> Column:
    return (F.size(b) == 4) & (b[0] < b[2]) & (b[1] < b[3]) & (F.array_min(b) >= 0)


def whole_page_ok(r: Column) -> Column:
    """Boxes in pixels, left < right and top < bottom; an answer's box may be missing."""
    good = lambda q: F.coalesce(_given(q["number"]) & _box_ok(q["question_bbox"]) & (q["answer_bbox"].isNull() | _box_ok(q["answer_bbox"])), F.lit(False))
    return F.coalesce((F.size(r["questions"]) > 0) & F.forall(r["questions"], good), F.lit(False))


def single_question_ok(r: Column) -> Column:
    return F.coalesce(_given(r["question_number"]) & _given(r["question_content"]) & r["recognition_confidence"].between(0, 1), F.lit(False))


def observation_ok(r: Column) -> Column:
    return F.coalesce(r["answer_status_assessment"].isin(*ANSWER_STATES) & r["correctness"].isin(*CORRECTNESS) & r["confidence"].between(0, 1), F.lit(False))


def conclusion_ok(r: Column) -> Column:
    return F.coalesce(r["answer_status"].isin(*ANSWER_STATES) & r["correctness"].isin(*CORRECTNESS) & r["mastery_level"].isin(*MASTERY) & r["confidence"].between(0, 1), F.lit(False))
