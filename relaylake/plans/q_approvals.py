"""Registered queries: approvals and their deadlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import templates as TPL
from relaylake.operators import approvals as A
from relaylake.operators import planning, stages
from relaylake.plans.q_intake import tickets
from relaylake.plans.sqlviews import with_views
from relaylake.sources import views
from relaylake.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}

TIMEOUT_S = 8 * 3600

STATE_CTES = [
    ("reqs", """SELECT request_id, min(ts) AS created_at, arg_min(stage, (ts, seq)) AS stage,
        arg_min(summary, (ts, seq)) AS summary, arg_min(work_item_id, (ts, seq)) AS work_item_id
      FROM approval_events WHERE event = 'requested' GROUP BY request_id"""),
    ("dec", """SELECT request_id, arg_max(event, (ts, seq)) AS d_event, arg_max(actor, (ts, seq)) AS d_actor,
        arg_max(comment, (ts, seq)) AS d_comment, max(ts) AS d_ts
      FROM approval_events WHERE event IN ('approved', 'rejected') GROUP BY request_id"""),
    ("state", """SELECT r.*, CASE WHEN d.d_ts >= r.created_at THEN d.d_event ELSE 'pending' END AS status,
        CASE WHEN d.d_ts >= r.created_at THEN d.d_actor END AS approver,
        CASE WHEN d.d_ts >= r.created_at THEN d.d_comment END AS comment,
        CASE WHEN d.d_ts >= r.created_at THEN d.d_ts ELSE r.created_at END AS updated_at
      FROM reqs r LEFT JOIN dec d USING (request_id)"""),
]


def state_sql(body: str, more: list | None = None, views_: list | None = None) -> str:
    return with_views(["approval_events"] + (views_ or []), body, extra=STATE_CTES + (more or []))


def state(spark, sf):
    return A.latest_state(views.approval_events(spark, sf))


def q_approval_latest(spark, sf):
    return state(spark, sf).select("request_id", "work_item_id", "stage", "status", "approver", "comment", "updated_at")


QUERIES["approval_latest"] = q_approval_latest
ORACLE["approval_latest"] = state_sql("SELECT request_id, work_item_id, stage, status, approver, comment, updated_at FROM state")


def q_approval_pending(spark, sf):
    return A.pending(state(spark, sf)).select("request_id", "stage", "created_at")


QUERIES["approval_pending"] = q_approval_pending
ORACLE["approval_pending"] = state_sql("SELECT request_id, stage, created_at FROM state WHERE status = 'pending'")


def guided(spark, sf):
    return A.with_guidance(A.pending(state(spark, sf)), A.guidance_table(spark))


def q_approval_guidance(spark, sf):
    g = guided(spark, sf)
    return g.select("request_id", "stage", "recommended_action", "risk_level",
                    F.array_join("checklist", " | ").alias("checklist"))


CHECKLIST_SQL = ("CASE lower(trim(stage)) " + " ".join(
    f"WHEN '{s}' THEN '{' | '.join(items)}'" for s, items in K.STAGE_CHECKLISTS.items())
    + f" ELSE '{' | '.join(K.DEFAULT_CHECKLIST)}' END")
CHECKLIST_PY_SQL = ("CASE lower(trim(stage)) " + " ".join(
    "WHEN '{}' THEN '{}'".format(s, "[" + ", ".join("''" + i + "''" for i in items) + "]")
    for s, items in K.STAGE_CHECKLISTS.items())
    + " ELSE '{}' END".format("[" + ", ".join("''" + i + "''" for i in K.DEFAULT_CHECKLIST) + "]"))
RISK_SQL = "CASE WHEN lower(trim(stage)) = 'prod' THEN 'high' ELSE 'medium' END"

QUERIES["approval_guidance"] = q_approval_guidance
ORACLE["approval_guidance"] = state_sql(f"""SELECT request_id, stage, 'approve_if_all_checks_pass' AS recommended_action,
  {RISK_SQL} AS risk_level, {CHECKLIST_SQL} AS checklist FROM state WHERE status = 'pending'""")


def q_render_suggestion(spark, sf):
    """Approval suggestion text per pending request (template render)."""
    g = guided(spark, sf)
    text = TPL.render(TPL.literal("approval_suggestion"), {
        "stage": F.col("stage"), "summary": F.col("summary"),
        "checklist": TPL.python_list(F.col("checklist")), "risk_level": F.col("risk_level"),
    }, F.concat(F.lit("Review checklist for stage "), F.col("stage"), F.lit(".")))
    return g.select("request_id", text.alias("suggestion_text"))


def _sql_render(name: str, fields: dict[str, str]) -> str:
    out = "'" + K.TEMPLATES[name].replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for k, v in fields.items():
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


QUERIES["render_suggestion"] = q_render_suggestion
ORACLE["render_suggestion"] = state_sql(
    "SELECT request_id, " + _sql_render("approval_suggestion", {
        "stage": "stage", "summary": "summary", "checklist": CHECKLIST_PY_SQL, "risk_level": RISK_SQL})
    + " AS suggestion_text FROM state WHERE status = 'pending'")


def q_approval_timeout(spark, sf):
    t = A.timeout_outcomes(views.approval_events(spark, sf), TIMEOUT_S, "overwrite")
    return t.select("request_id", "stage", "deadline", "outcome", "outcome_actor", "final_status")


TIMEOUT_CTES = [
    ("dj", f"""SELECT d.request_id, d.event, d.actor, d.ts, d.seq, r.created_at,
        d.ts <= r.created_at + to_seconds({TIMEOUT_S}) AS in_time
      FROM approval_events d JOIN reqs r USING (request_id)
      WHERE d.event IN ('approved', 'rejected') AND d.ts >= r.created_at"""),
    ("dagg", """SELECT request_id,
        arg_min(event, (ts, seq)) FILTER (WHERE in_time) AS first_event,
        arg_min(actor, (ts, seq)) FILTER (WHERE in_time) AS first_actor,
        arg_max(event, (ts, seq)) AS last_event, max(ts) AS last_ts
      FROM dj GROUP BY request_id"""),
]

QUERIES["approval_timeout"] = q_approval_timeout
ORACLE["approval_timeout"] = state_sql(f"""
SELECT r.request_id, r.stage, r.created_at + to_seconds({TIMEOUT_S}) AS deadline,
  coalesce(first_event, 'timed_out') AS outcome, coalesce(first_actor, 'system-timeout') AS outcome_actor,
  CASE WHEN first_event IS NULL AND last_ts > r.created_at + to_seconds({TIMEOUT_S}) THEN last_event
       WHEN first_event IS NULL THEN 'timed_out' ELSE last_event END AS final_status
FROM reqs r LEFT JOIN dagg USING (request_id)""", more=TIMEOUT_CTES)


def q_approval_timeout_ignore_late(spark, sf):
    """X4 with late_decision='ignore': a decision after the deadline is dropped."""
    t = A.timeout_outcomes(views.approval_events(spark, sf), TIMEOUT_S, "ignore")
    return t.select("request_id", "outcome", "final_status")


QUERIES["approval_timeout_ignore_late"] = q_approval_timeout_ignore_late
ORACLE["approval_timeout_ignore_late"] = state_sql("""
SELECT r.request_id, coalesce(first_event, 'timed_out') AS outcome,
  CASE WHEN first_event IS NULL THEN 'timed_out' ELSE last_event END AS final_status
FROM reqs r LEFT JOIN dagg USING (request_id)""", more=TIMEOUT_CTES)


def q_lookup_by_id(spark, sf):
    ids = views.approval_events(spark, sf).select("request_id").distinct()
    return A.lookup(ids, state(spark, sf))


QUERIES["lookup_by_id"] = q_lookup_by_id
ORACLE["lookup_by_id"] = state_sql("""SELECT i.request_id, s.status, s.stage, s.request_id IS NOT NULL AS found
  FROM (SELECT DISTINCT request_id FROM approval_events) i LEFT JOIN state s USING (request_id)""")


def q_auto_approved(spark, sf):
    s = A.auto_approved(state(spark, sf))
    return s.groupBy("stage", "auto_approved", "status").agg(F.count(F.lit(1)).alias("n_requests"))


QUERIES["auto_approved"] = q_auto_approved
ORACLE["auto_approved"] = state_sql("""SELECT stage, stage IN ('dev') AS auto_approved, status, count(*) AS n_requests
  FROM state GROUP BY ALL""")


def q_payload_valid(spark, sf):
    e = views.approval_events(spark, sf).where(F.col("event").isin(*A.DECISIONS))
    return A.validate_decisions(e)


QUERIES["payload_valid"] = q_payload_valid
ORACLE["payload_valid"] = with_views(["approval_events"], """SELECT seq, request_id,
  length(actor) BETWEEN 2 AND 128 AND length(coalesce(comment, '')) <= 500 AS valid,
  CASE WHEN length(actor) NOT BETWEEN 2 AND 128 THEN 'approver length'
       WHEN length(coalesce(comment, '')) > 500 THEN 'comment length' END AS reason
  FROM approval_events WHERE event IN ('approved', 'rejected')""")


def q_message_valid(spark, sf):
    """message and responder bounds over all turns."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("message"), F.col("role").alias("responder"))
    return A.validate_messages(turns)


QUERIES["message_valid"] = q_message_valid
ORACLE["message_valid"] = """SELECT conv_id, turn, reason, reason IS NULL AS valid FROM (SELECT conv_id, turn,
  CASE WHEN length(coalesce(text, '')) NOT BETWEEN 1 AND 4000 THEN 'message length'
       WHEN length(role) NOT BETWEEN 2 AND 128 THEN 'responder length' END AS reason FROM conversations)"""


def q_approval_gate(spark, sf):
    p = planning.with_plan(tickets(spark, sf)).select("work_item_id")
    ps = stages.stage_cross(p).where(F.col("environment").isin(*K.APPROVAL_STAGES))
    return A.gate_status(ps, state(spark, sf))


QUERIES["approval_gate"] = q_approval_gate
ORACLE["approval_gate"] = state_sql("""
SELECT w.id AS work_item_id, st.environment, coalesce(l.approval_status, 'missing') AS approval_status,
  coalesce(l.approval_status, '') = 'approved' AS gate_passed
FROM work_items w CROSS JOIN (SELECT unnest(['qe', 'stg', 'prod']) AS environment) st
LEFT JOIN (SELECT work_item_id, stage, arg_max(status, (created_at, request_id)) AS approval_status
           FROM state GROUP BY work_item_id, stage) l
  ON l.work_item_id = w.id AND l.stage = st.environment""", views_=["work_items"])
