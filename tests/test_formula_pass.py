"""Formulas of a query go through Python once, and commonly met ones take few steps."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from examlark.functions import formulas
from examlark.plans import registry


def test_both_notations_share_one_pass_of_python(spark):
    plan = registry.QUERIES["formula_signatures"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_nulls_and_malformed_formulas_stay_apart_in_a_batch(spark):
    rows = [("x^{2}", "<mi>x</mi>"), (None, None), ("{", "<mi>"), (r"\frac 12", "<mn>1</mn><mn>2</mn>")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = df.select(formulas.linear("a", "latex").alias("a"), formulas.linear(F.col("b"), "mathml").alias("b")).collect()
    assert [tuple(r) for r in got] == [("x^(2)", "x"), (None, None), (None, None), ("(1)/(2)", "12")]


def test_calls_for_a_formula_are_few():
    """Tokens of one character and elements of one text are taken without calls of their own."""
    text = "<math>" + "<mfrac><mrow>" * 4 + "<mi>x</mi>" + "<mo>&#xD7;</mo><mi>y</mi></mrow><mn>12</mn></mfrac>" * 4 + "</math>"
    formulas.to_line(text, "mathml")
    for formula, kind in ((text, "mathml"), (r"\frac{ " * 4 + "x" + r" + y}{12}" * 4, "latex")):
        calls = [0]
        sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event == "call")))
        formulas.to_line(formula, kind)
        sys.setprofile(None)
        assert calls[0] < 110, (kind, calls)
