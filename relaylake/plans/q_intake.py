"""Registered queries: intake, planning, idempotency, learning.

Each entry pairs the DataFrame job with DuckDB SQL computing the same rows
from the same parquet tables. Array outputs are flattened with a separator
so both sides produce scalar columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake.operators import intake, learning, planning
from relaylake.plans.sqlviews import with_views
from relaylake.sources import views

QUERIES: dict = {}
ORACLE: dict = {}

TOP_K = 50


def tickets(spark: SparkSession, sf: str) -> DataFrame:
    return intake.normalize_tickets(views.work_items(spark, sf))


def open_tickets(spark: SparkSession, sf: str) -> DataFrame:
    return intake.board_filter(tickets(spark, sf))


def _plan_out(df: DataFrame) -> DataFrame:
    return df.select(
        "work_item_id",
        F.array_join("source_types", ",").alias("source_types"),
        "ingestion_mode", "target_layer", "target_catalog", "target_schema", "target_table",
        "target_repo", "branch_name",
        F.array_join("notebook_tasks", ",").alias("notebook_tasks"),
        F.array_join("risk_notes", "|").alias("risk_notes"),
        "needs_clarification",
        F.array_join("clarification_questions", "|").alias("clarification_questions"),
    )


PLAN_OUT_SQL = """work_item_id, array_to_string(source_types, ',') AS source_types, ingestion_mode, target_layer,
  target_catalog, target_schema, target_table, target_repo, branch_name,
  array_to_string(['create_unity_catalog_table', 'run_ingestion_notebook', 'run_data_quality_checks'], ',') AS notebook_tasks,
  array_to_string(risk_notes, '|') AS risk_notes, len(clarification_questions) > 0 AS needs_clarification,
  array_to_string(clarification_questions, '|') AS clarification_questions"""

OPEN = "item_type IN ('Product Backlog Item', 'Bug', 'User Story') AND state <> 'Closed'"


# ---- F1 / C1-C3 --------------------------------------------------------------
def q_intake_filter(spark, sf):
    return open_tickets(spark, sf).select("id", "title", "item_type", "priority", "state", "repo_name")


QUERIES["intake_filter"] = q_intake_filter
ORACLE["intake_filter"] = with_views(["tickets"], f"SELECT id, title, item_type, priority, state, repo_name FROM tickets WHERE {OPEN}")


# ---- T1 ----------------------------------------------------------------------
def q_intake_topk(spark, sf):
    return intake.top_k(open_tickets(spark, sf), TOP_K).select("id", "priority", "title")


QUERIES["intake_topk"] = q_intake_topk
ORACLE["intake_topk"] = with_views(["tickets"], f"SELECT id, priority, title FROM tickets WHERE {OPEN} ORDER BY priority, id LIMIT {TOP_K}")


# ---- T2 ----------------------------------------------------------------------
def q_intake_two_phase_topk(spark, sf):
    return intake.two_phase_top_k(open_tickets(spark, sf), TOP_K).select("id", "priority", "changed_date")


QUERIES["intake_two_phase_topk"] = q_intake_two_phase_topk
ORACLE["intake_two_phase_topk"] = with_views(
    ["tickets"],
    f"SELECT id, priority, changed_date FROM (SELECT * FROM tickets WHERE {OPEN} "
    f"ORDER BY priority, changed_date DESC, id LIMIT {TOP_K}) ORDER BY priority, id")


# ---- C11 ---------------------------------------------------------------------
def q_plan_full(spark, sf):
    return _plan_out(planning.with_plan(tickets(spark, sf)))


QUERIES["plan_full"] = q_plan_full
ORACLE["plan_full"] = with_views(["plans"], f"SELECT {PLAN_OUT_SQL} FROM plans")


def q_plan_branch(spark, sf):
    """C8 alone over every ticket."""
    from relaylake.functions import text as T
    return tickets(spark, sf).select("id", T.branch_name(F.col("id"), F.col("title")).alias("branch_name"))


QUERIES["plan_branch"] = q_plan_branch
ORACLE["plan_branch"] = with_views(["plans"], "SELECT id, branch_name FROM plans")


def q_plan_questions(spark, sf):
    """Open questions per ticket, and how many tickets ask each one."""
    p = planning.with_plan(tickets(spark, sf))
    return (p.select(F.explode("clarification_questions").alias("question"))
            .groupBy("question").agg(F.count(F.lit(1)).alias("n_tickets")))


QUERIES["plan_questions"] = q_plan_questions
ORACLE["plan_questions"] = with_views(
    ["plans"], "SELECT question, count(*) AS n_tickets FROM (SELECT unnest(clarification_questions) AS question FROM plans) GROUP BY question")


# ---- C23 / E2 / B11 ----------------------------------------------------------
def q_run_ledger_latest(spark, sf):
    return intake.latest_run_status(views.run_ledger(spark, sf)).select("run_key", "status", "seq")


QUERIES["run_ledger_latest"] = q_run_ledger_latest
ORACLE["run_ledger_latest"] = with_views(
    ["run_ledger"], "SELECT run_key, arg_max(status, seq) AS status, max(seq) AS seq FROM run_ledger GROUP BY run_key")


def q_idempotent_skip(spark, sf):
    remaining = intake.skip_completed(open_tickets(spark, sf), views.run_ledger(spark, sf))
    return remaining.select("id", "run_key")


QUERIES["idempotent_skip"] = q_idempotent_skip
ORACLE["idempotent_skip"] = with_views(
    ["run_ledger"],
    f"""SELECT id, run_key FROM keyed WHERE {OPEN} AND run_key NOT IN (
        SELECT run_key FROM (SELECT run_key, arg_max(status, seq) AS s FROM run_ledger GROUP BY run_key) WHERE s = 'succeeded')""")


# ---- P1: intake → plan -------------------------------------------------------
def q_intake_plan(spark, sf):
    """P1 over every open ticket: F1 → E2 → C11."""
    remaining = intake.skip_completed(open_tickets(spark, sf), views.run_ledger(spark, sf))
    return _plan_out(planning.with_plan(remaining))


DONE_SQL = "SELECT run_key FROM (SELECT run_key, arg_max(status, seq) AS s FROM run_ledger GROUP BY run_key) WHERE s = 'succeeded'"

QUERIES["intake_plan"] = q_intake_plan
ORACLE["intake_plan"] = with_views(
    ["plans", "run_ledger"], f"SELECT {PLAN_OUT_SQL} FROM plans WHERE {OPEN} AND run_key NOT IN ({DONE_SQL})")


def q_intake_plan_topk(spark, sf):
    """P1 as one intake cycle: F1 → T2 (k tickets) → E2 → C11."""
    chosen = intake.two_phase_top_k(open_tickets(spark, sf), TOP_K)
    remaining = intake.skip_completed(chosen, views.run_ledger(spark, sf))
    return _plan_out(planning.with_plan(remaining))


QUERIES["intake_plan_topk"] = q_intake_plan_topk
ORACLE["intake_plan_topk"] = with_views(
    ["plans", "run_ledger"],
    f"""SELECT {PLAN_OUT_SQL} FROM (SELECT * FROM plans WHERE {OPEN}
        ORDER BY priority, changed_date DESC, id LIMIT {TOP_K}) WHERE run_key NOT IN ({DONE_SQL})""")


# ---- T3 ----------------------------------------------------------------------
def q_queue_head_per_repo(spark, sf):
    p = planning.with_plan(open_tickets(spark, sf))
    return intake.queue_head_per_repo(p, "target_repo")


QUERIES["queue_head_per_repo"] = q_queue_head_per_repo
ORACLE["queue_head_per_repo"] = with_views(
    ["plans"],
    f"""SELECT target_repo, arg_min(id, (priority, id)) AS id, min(priority) AS priority,
        arg_min(title, (priority, id)) AS title, count(*) AS queue_length
        FROM plans WHERE {OPEN} GROUP BY target_repo""")


# ---- C31 ---------------------------------------------------------------------
def q_active_view(spark, sf):
    p = planning.with_plan(open_tickets(spark, sf))
    v = planning.active_view(p, TOP_K)
    return v.withColumn("clarification_questions", F.array_join("clarification_questions", "|"))


QUERIES["active_view"] = q_active_view
ORACLE["active_view"] = with_views(
    ["plans"],
    f"""SELECT id, title, item_type AS type, priority, repo_name, state, len(clarification_questions) > 0 AS needs_clarification,
        array_to_string(clarification_questions, '|') AS clarification_questions
        FROM plans WHERE {OPEN} ORDER BY priority, id LIMIT {TOP_K}""")


# ---- G1 / T4 / W1 / E11 / P3 -------------------------------------------------
def q_source_rank(spark, sf):
    return learning.source_rank(views.learning_history(spark, sf))


QUERIES["source_rank"] = q_source_rank
SOURCE_RANK_SQL = """SELECT source_type, CAST(count(*) AS BIGINT) AS n,
    CAST(row_number() OVER (ORDER BY count(*) DESC, min(seq), min(pos)) AS INTEGER) AS rank
    FROM (SELECT seq, unnest(source_types) AS source_type, unnest(generate_series(0, len(source_types) - 1)) AS pos FROM {src})
    GROUP BY source_type"""
ORACLE["source_rank"] = with_views(["learning_history"], SOURCE_RANK_SQL.format(src="learning_history"))


RETAINED = 500  # the "latest records" view: a top-k


def q_history_last_500(spark, sf):
    return learning.retained_history(views.learning_history(spark, sf), RETAINED).select(
        "work_item_id", "status", "target_table", F.array_join("source_types", ",").alias("source_types"), "seq")


QUERIES["history_last_500"] = q_history_last_500
ORACLE["history_last_500"] = with_views(
    ["learning_history"],
    "SELECT work_item_id, status, target_table, array_to_string(source_types, ',') AS source_types, seq "
    "FROM learning_history ORDER BY seq DESC LIMIT 500")


def q_source_rank_retained(spark, sf):
    """G1 over the latest records only."""
    kept = learning.retained_history(views.learning_history(spark, sf), RETAINED)
    return learning.source_rank(kept)


QUERIES["source_rank_retained"] = q_source_rank_retained
ORACLE["source_rank_retained"] = with_views(
    ["learning_history"], SOURCE_RANK_SQL.format(src="(SELECT * FROM learning_history ORDER BY seq DESC LIMIT 500)"))


def q_plan_sources_ranked(spark, sf):
    """Plan source types reordered by the history rank."""
    rank = learning.source_rank(views.learning_history(spark, sf))
    p = planning.rank_sources(planning.with_plan(tickets(spark, sf)), rank)
    return p.select("work_item_id", F.array_join("source_types", ",").alias("source_types"))


QUERIES["plan_sources_ranked"] = q_plan_sources_ranked
ORACLE["plan_sources_ranked"] = with_views(
    ["plans", "learning_history"],
    """SELECT p.work_item_id, string_agg(s.source_type, ',' ORDER BY coalesce(r.rank, 1073741824), s.pos) AS source_types
       FROM (SELECT work_item_id, unnest(source_types) AS source_type, unnest(generate_series(0, len(source_types) - 1)) AS pos FROM plans) s
       JOIN plans p USING (work_item_id)
       LEFT JOIN sr r ON r.source_type = s.source_type
       GROUP BY p.work_item_id""",
    extra=[("sr", SOURCE_RANK_SQL.format(src="learning_history"))])
