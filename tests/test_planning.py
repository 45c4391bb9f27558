"""Planning: plan extraction, questions, answers, history ranking."""

from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.operators import clarify, intake, learning, planning


def plan(spark, rows):
    schema = "id long, title string, description string, acceptance_criteria string, tags array<string>, repo_name string"
    df = intake.normalize_tickets(spark.createDataFrame(rows, schema))
    return {r.id: r for r in planning.with_plan(df).collect()}


def test_explicit_plan(spark):
    p = plan(spark, [(25, "Create main.bronze.customer_dim from JDBC and flat file with overwrite", "", "DQ checks", [], "repo-x")])[25]
    assert (p.target_catalog, p.target_schema, p.target_table) == ("main", "bronze", "customer_dim")
    assert p.ingestion_mode == "overwrite" and p.source_types == ["jdbc", "flat_file"]
    assert p.clarification_questions == [] and p.needs_clarification is False
    assert p.risk_notes == [K.RISK_JDBC, K.RISK_OVERWRITE]
    assert p.notebook_tasks == K.NOTEBOOK_TASKS and p.target_layer == "bronze"


def test_vague_ticket_asks_everything(spark):
    p = plan(spark, [(99, "Create customer data pipeline", "", "", [], None)])[99]
    assert p.clarification_questions == [K.Q_TABLE, K.Q_SOURCE, K.Q_MODE, K.Q_REPO, K.Q_CRITERIA]
    assert p.target_table == "wi_99_table" and p.source_types == ["unknown"] and p.ingestion_mode == "append"
    assert p.target_repo == K.DEFAULT_REPO


def test_sample_tickets(spark):
    rows = plan(spark, [
        (101, "Create bronze.main.customer_profile from JDBC EDW source with append", "Build ingestion from external EDW.",
         "Data ingests daily; append mode.", ["bronze", "repo:data-engineering-repo"], None),
        (102, "Bug: flat file volume ingestion overwrite for main.bronze.order_events", "Fix malformed records.",
         "No duplicate rows after overwrite.", ["repo:data-engineering-repo"], None),
        (103, "!!!", "", "", [], None),
    ])
    assert (rows[101].target_catalog, rows[101].target_schema, rows[101].target_table) == ("bronze", "main", "customer_profile")
    assert rows[102].branch_name == "feature/pbi-102-bug-flat-file-volume-ingestion-over"
    assert rows[102].source_types == ["flat_file"] and rows[102].ingestion_mode == "overwrite"
    assert rows[103].branch_name == "feature/pbi-103-work-item"


def test_slug_cut_after_trim_may_end_with_dash(spark):
    title = "abcdefghij abcdefghij abcdefghij a bcd"
    p = plan(spark, [(1, title, "", "x", [], "r")])[1]
    import re
    expect = re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-")[:35]
    assert p.branch_name == "feature/pbi-1-" + expect and expect.endswith("-")


def test_auto_answers_leave_table_question(spark):
    rows = plan(spark, [(99, "Create customer data pipeline", "", "", [], None)])
    df = spark.createDataFrame([(99,)], "work_item_id long")
    p = planning.with_plan(intake.normalize_tickets(spark.createDataFrame(
        [(99, "Create customer data pipeline", "", "", [], None)],
        "id long, title string, description string, acceptance_criteria string, tags array<string>, repo_name string")))
    p = p.withColumn("answers", F.transform("clarification_questions", lambda q: F.struct(q.alias("q"), F.lit("auto-default").alias("a"))))
    out = clarify.apply_answers(p).first()
    assert out.clarification_questions == [K.Q_TABLE] and out.needs_clarification
    assert out.target_repo == "auto-default"
    assert rows and df.count() == 1


def test_human_answers_applied(spark):
    p = planning.with_plan(intake.normalize_tickets(spark.createDataFrame(
        [(7, "Create customer data pipeline", "", "", [], None)],
        "id long, title string, description string, acceptance_criteria string, tags array<string>, repo_name string")))
    answers = [
        (K.Q_TABLE, " Main.Silver.Orders "), (K.Q_SOURCE, "CSV drops on a volume"), (K.Q_MODE, "   "),
        (K.Q_REPO, "repo: Team Repo/Alpha!"), (K.Q_CRITERIA, "no nulls"),
    ]
    p = p.withColumn("answers", F.array(*[F.struct(F.lit(q).alias("q"), F.lit(a).alias("a")) for q, a in answers]))
    out = clarify.apply_answers(p).first()
    assert (out.target_catalog, out.target_schema, out.target_table) == ("main", "silver", "orders")
    assert out.source_types == ["flat_file"]
    assert out.ingestion_mode == "append"  # blank answer dropped; no mode word anywhere
    assert out.target_repo == "Team-Repo-Alpha"
    # the blank mode answer is dropped and no other answer names a mode
    assert out.clarification_questions == [K.Q_MODE]


def test_source_rank_ties_first_seen(spark):
    h = spark.createDataFrame([(1, ["flat_file"]), (2, ["jdbc"]), (3, ["jdbc", "flat_file"])], "seq long, source_types array<string>")
    ranked = [(r.source_type, r.rank) for r in learning.source_rank(h).orderBy("rank").collect()]
    assert ranked == [("flat_file", 1), ("jdbc", 2)]


def test_rank_sources_reorders_stably(spark):
    p = spark.createDataFrame([(1, ["jdbc", "flat_file"]), (2, ["unknown"])], "work_item_id long, source_types array<string>")
    rank = spark.createDataFrame([("flat_file", 1), ("jdbc", 2)], "source_type string, rank int")
    got = {r.work_item_id: r.source_types for r in planning.rank_sources(p, rank).collect()}
    assert got == {1: ["flat_file", "jdbc"], 2: ["unknown"]}


def test_history_keeps_last_500(spark):
    h = spark.range(1, 502).select(F.col("id").alias("seq"))
    kept = learning.retained_history(h, 500)
    assert kept.count() == 500 and kept.agg(F.min("seq")).first()[0] == 2
