"""Template rendering against Python's str.format (C20)."""

from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import templates as TPL


def test_render_matches_format(spark):
    rows = [("qe", "medium", "sum {x}", "['a']"), ("prod", "high", "", "[]")]
    df = spark.createDataFrame(rows, "stage string, risk string, summary string, checklist string")
    text = TPL.render(TPL.literal("approval_suggestion"), {"stage": F.col("stage"), "risk_level": F.col("risk"),
                                                          "summary": F.col("summary"), "checklist": F.col("checklist")},
                      F.lit("fallback"))
    got = [r.t for r in df.select(text.alias("t")).collect()]
    exp = [K.TEMPLATES["approval_suggestion"].format(stage=s, risk_level=r, summary=m, checklist=c) for s, r, m, c in rows]
    assert got == exp


def test_missing_key_or_template_falls_back(spark):
    df = spark.createDataFrame([(1,)], "x int")
    t1 = TPL.render(F.lit("Hello {name} {other}"), {"name": F.lit("n")}, F.lit("fb"))
    t2 = TPL.render(F.lit(""), {}, F.lit("fb2"))
    t3 = TPL.render(F.lit("{a}{a}-{b}"), {"a": F.lit("1"), "b": F.lit("{a}")}, F.lit("fb"))
    r = df.select(t1.alias("a"), t2.alias("b"), t3.alias("c")).first()
    assert (r.a, r.b, r.c) == ("fb", "fb2", "11-{a}")


def test_render_by_name(spark):
    df = spark.createDataFrame([("hil_chat_response",), ("nope",)], "tname string")
    out = TPL.render_by_name(df, TPL.template_table(spark), "tname", {
        "message": F.lit("m"), "context": F.lit("{}"), "pending_approvals": F.lit("1"),
        "pending_clarifications": F.lit("2"), "active_items": F.lit("3")}, F.lit("fb"), "text")
    got = {r.tname: r.text for r in out.collect()}
    assert got["nope"] == "fb"
    assert got["hil_chat_response"] == K.TEMPLATES["hil_chat_response"].format(
        message="m", context="{}", pending_approvals=1, pending_clarifications=2, active_items=3)


def test_values_are_put_into_a_map_once(spark):
    df = spark.createDataFrame([("a", "x")], "tname string, v string")
    t = spark.createDataFrame([("a", "{v}-{v}-{v}")], "name string, template string")
    out = TPL.render_by_name(df, t, "tname", {"v": F.col("v")}, F.lit("fb"), "text")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("map(v") == 1
    assert out.first().text == "x-x-x"
