"""Registered queries: stage evaluation and run summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import text as T
from relaylake.operators import intake, learning, planning, stages
from relaylake.plans.q_intake import tickets
from relaylake.plans.sqlviews import with_views
from relaylake.session import scratch_path, stored
from relaylake.sources import views

QUERIES: dict = {}
ORACLE: dict = {}

HIL = "('qe', 'stg', 'prod')"
PROMOTE_SQL = "lower(status) IN ('succeeded', 'success', 'completed') AND qa_passed"

# ---- SQL twins of the stage operators --------------------------------------
GATE_CTES = [
    ("gate_log", """SELECT user_id % 100 AS team, ['dev', 'qe', 'stg', 'prod'][event_id % 4 + 1] AS environment, event_id AS seq,
        TIMESTAMP '1995-01-01' + to_seconds((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 * 80) AS since,
        event_type IN ('signup', 'purchase', 'error') AS decides, event_type IN ('view', 'click') AS checks,
        event_type <> 'error' AS approved, 'approver-' || CAST(event_id % 9 AS VARCHAR) AS actor, coalesce(props, '') AS comment, value < 20 AS passed
      FROM events"""),
    ("decisions", "SELECT * FROM gate_log WHERE decides QUALIFY row_number() OVER (PARTITION BY team, environment, since ORDER BY seq DESC) = 1"),
    ("results", "SELECT * FROM gate_log WHERE checks QUALIFY row_number() OVER (PARTITION BY team, environment, since ORDER BY seq DESC) = 1"),
    ("gated_runs", """SELECT r.*, NOT coalesce(d.approved, false) AS denied, coalesce(c.passed, false) AS qa_passed,
        coalesce(d.actor, 'system-timeout') AS approver, coalesce(d.comment, '') AS comment
      FROM stage_runs r ASOF LEFT JOIN decisions d ON d.team = r.team AND d.environment = r.environment AND r.started_at >= d.since
      ASOF LEFT JOIN results c ON c.team = r.team AND c.environment = r.environment AND r.started_at >= c.since"""),
]
STAGE_CTES = [
    *GATE_CTES,
    ("sa", f"SELECT *, {PROMOTE_SQL} AS promote_raw FROM gated_runs WHERE attempt <= {K.MAX_REMEDIATION_ATTEMPTS + 1}"),
    ("so1", f"""SELECT work_item_id, ord, any_value(environment) AS environment,
        bool_or(attempt = 1 AND denied) AND any_value(environment) IN {HIL} AS gate_denied,
        bool_or(attempt = 1 AND promote_raw) AS promote1,
        max(CASE WHEN attempt = 1 THEN status END) AS status1,
        bool_or(attempt = 1 AND qa_passed) AS qa1,
        max(CASE WHEN attempt = 1 THEN started_at END) AS start1,
        max(CASE WHEN attempt = 1 THEN approver END) AS approver, max(CASE WHEN attempt = 1 THEN comment END) AS comment,
        min(CASE WHEN attempt >= 2 AND (denied OR (fix_ok AND promote_raw)) THEN attempt - 1 END) AS stop_j
      FROM sa GROUP BY work_item_id, ord"""),
    ("used", f"""SELECT s.work_item_id, s.ord, a.attempt - 1 AS j, a.denied, a.fix_ok,
        (NOT a.denied AND a.fix_ok AND a.promote_raw) AS promote, a.status, a.qa_passed, a.started_at, a.approver
      FROM so1 s JOIN sa a ON a.work_item_id = s.work_item_id AND a.ord = s.ord
      WHERE a.attempt >= 2 AND NOT s.gate_denied AND NOT s.promote1
        AND a.attempt - 1 <= coalesce(s.stop_j, {K.MAX_REMEDIATION_ATTEMPTS})"""),
    ("used_agg", """SELECT work_item_id, ord, count(*) AS n, bool_or(promote) AS recovered,
        string_agg(CASE WHEN denied THEN 'attempt=' || j || ': remediation approval denied by ' || approver
          ELSE 'attempt=' || j || ': status=' || CASE WHEN fix_ok THEN 'succeeded' ELSE 'failed' END
            || '; detail=' || CASE WHEN fix_ok THEN 'fix applied' ELSE 'fix failed' END
            || CASE WHEN promote THEN ' ; attempt=' || j || ': pipeline recovered and QA passed' ELSE '' END END,
          ' ; ' ORDER BY j) AS trail,
        arg_max(status, j) FILTER (WHERE NOT denied AND fix_ok) AS last_status,
        arg_max(qa_passed, j) FILTER (WHERE NOT denied AND fix_ok) AS last_qa,
        arg_max(started_at, j) FILTER (WHERE NOT denied AND fix_ok) AS last_start
      FROM used GROUP BY work_item_id, ord"""),
    ("stage_outcomes", f"""SELECT s.work_item_id, s.ord, s.environment, s.approver, s.comment,
        CASE WHEN s.gate_denied THEN 'denied' WHEN s.environment IN {HIL} THEN 'approved' ELSE 'not_required' END AS gate,
        CASE WHEN NOT s.gate_denied AND (s.promote1 OR coalesce(a.recovered, false)) THEN 'succeeded' ELSE 'failed' END AS stage_status,
        CAST(coalesce(a.n, 0) AS INTEGER) AS attempts_used,
        coalesce(a.trail, '') AS trail,
        coalesce(a.last_status, s.status1) AS pipeline_status,
        coalesce(a.last_qa, s.qa1) AS qa_passed,
        coalesce(a.last_start, s.start1) AS pipeline_started_at
      FROM so1 s LEFT JOIN used_agg a USING (work_item_id, ord)"""),
    ("rs", """SELECT work_item_id, min(CASE WHEN stage_status = 'failed' THEN ord END) AS first_failed_ord
      FROM stage_outcomes GROUP BY work_item_id"""),
    ("failed_repos", """SELECT event_id // 4 AS work_item_id,
        arg_min(['checkout', 'change', 'tests', 'pull request'][event_id % 4 + 1] || ' failed: ' || coalesce(props, ''), event_id) AS repository_details
      FROM events WHERE event_type = 'error' AND value >= 100 GROUP BY event_id // 4"""),
    ("run_status", """SELECT coalesce(rs.work_item_id, f.work_item_id) AS work_item_id, f.repository_details,
        CASE WHEN rs.first_failed_ord IS NULL AND f.work_item_id IS NULL THEN 'succeeded' ELSE 'failed' END AS overall_status
      FROM rs FULL JOIN failed_repos f ON f.work_item_id = rs.work_item_id"""),
    ("kept", """SELECT o.*, r.overall_status FROM stage_outcomes o JOIN rs USING (work_item_id) JOIN run_status r USING (work_item_id)
      WHERE o.ord <= coalesce(rs.first_failed_ord, 1048576) AND r.repository_details IS NULL"""),
]


def stage_sql(body: str, more_views: list[str] | None = None, extra: list | None = None) -> str:
    return with_views(["stage_runs"] + (more_views or []), body, extra=STAGE_CTES + (extra or []))


def gated_runs(spark: SparkSession, sf: str, max_attempts: int | None = K.MAX_REMEDIATION_ATTEMPTS) -> DataFrame:
    return stages.with_gates(views.stage_runs(spark, sf), views.gate_log(spark, sf), max_attempts)


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return stages.stage_outcomes(gated_runs(spark, sf))


def plans(spark: SparkSession, sf: str) -> DataFrame:
    return planning.with_plan(tickets(spark, sf))


def summaries(spark: SparkSession, sf: str, stage_outcomes: DataFrame | None = None) -> DataFrame:
    o = outcomes(spark, sf) if stage_outcomes is None else stage_outcomes
    return stages.run_summaries(o, stages.failed_repositories(views.repo_steps(spark, sf)))


# ---- C16 / E7 ----------------------------------------------------------------
def q_promotion_decision(spark, sf):
    return stages.promotion_decision(gated_runs(spark, sf, None))


QUERIES["promotion_decision"] = q_promotion_decision
ORACLE["promotion_decision"] = with_views(["stage_runs"], f"""
SELECT work_item_id, ord, environment, attempt, {PROMOTE_SQL} AS can_promote,
  CASE WHEN {PROMOTE_SQL} THEN 'Promotion allowed from ' || environment || '.'
       ELSE 'Promotion blocked at ' || environment || ': pipeline_status=' || status || ', qa_passed='
            || CASE WHEN qa_passed THEN 'True' ELSE 'False' END || '.' END AS reason
FROM gated_runs""", extra=GATE_CTES)


# ---- E6 as of each attempt ----
def q_attempt_gates(spark, sf):
    """The decision and the check result that hold at each attempt's start."""
    return gated_runs(spark, sf, None).select("work_item_id", "ord", "attempt", "denied", "qa_passed", "approver")


QUERIES["attempt_gates"] = q_attempt_gates
ORACLE["attempt_gates"] = with_views(["stage_runs"], "SELECT work_item_id, ord, attempt, denied, qa_passed, approver FROM gated_runs", extra=GATE_CTES)


# ---- W4 ----------------------------------------------------------------------
def q_stage_attempts(spark, sf):
    return outcomes(spark, sf).select("work_item_id", "ord", "environment", "gate", "stage_status",
                                      "attempts_used", "trail", "pipeline_status", "qa_passed")


QUERIES["stage_attempts"] = q_stage_attempts
ORACLE["stage_attempts"] = stage_sql("""SELECT work_item_id, ord, environment, gate, stage_status, attempts_used,
  trail, pipeline_status, qa_passed FROM stage_outcomes""")


# ---- W3 ----------------------------------------------------------------------
def q_stage_prefix(spark, sf):
    return stages.kept_stages(summaries(spark, sf)).select(
        "work_item_id", "overall_status", "ord", "environment", "stage_status")


QUERIES["stage_prefix"] = q_stage_prefix
ORACLE["stage_prefix"] = stage_sql("SELECT work_item_id, overall_status, ord, environment, stage_status FROM kept")


# ---- P2 / G3 / G6 ------------------------------------------------------------
def q_stage_summary(spark, sf):
    s = summaries(spark, sf)
    return s.select(
        "work_item_id", "overall_status",
        F.size("stage_results").alias("n_stages"),
        F.array_join(F.transform("stage_results", lambda x: F.concat(x["environment"], F.lit(":"), x["stage_status"])),
                     ",").alias("stages"),
        F.aggregate("stage_results", F.lit(0), lambda acc, x: acc + x["attempts_used"]).alias("remediation_attempts"))


QUERIES["stage_summary"] = q_stage_summary
ORACLE["stage_summary"] = stage_sql("""SELECT r.work_item_id, any_value(r.overall_status) AS overall_status,
  CAST(count(k.ord) AS INTEGER) AS n_stages, coalesce(string_agg(environment || ':' || stage_status, ',' ORDER BY ord), '') AS stages,
  CAST(coalesce(sum(attempts_used), 0) AS INTEGER) AS remediation_attempts
  FROM run_status r LEFT JOIN kept k ON k.work_item_id = r.work_item_id GROUP BY r.work_item_id""")


def q_stage_status_counts(spark, sf):
    """G3 roll-up: how many runs end in each overall status."""
    return summaries(spark, sf).groupBy("overall_status").agg(F.count(F.lit(1)).alias("n_runs"))


QUERIES["stage_status_counts"] = q_stage_status_counts
ORACLE["stage_status_counts"] = stage_sql(
    "SELECT overall_status, count(*) AS n_runs FROM run_status GROUP BY overall_status")


def q_repository_step(spark, sf):
    """Runs that failed before their first stage, with the step that failed."""
    return summaries(spark, sf).where(F.col("repository_details").isNotNull()).select(
        "work_item_id", "overall_status", F.size("stage_results").alias("n_stages"), "repository_details")


QUERIES["repository_step"] = q_repository_step
ORACLE["repository_step"] = stage_sql("""SELECT work_item_id, 'failed' AS overall_status, CAST(0 AS INTEGER) AS n_stages, repository_details
  FROM run_status WHERE repository_details IS NOT NULL""")


# ---- G8 ----------------------------------------------------------------------
def q_remediation_trail(spark, sf):
    return outcomes(spark, sf).where(F.col("trail") != "").select(
        "work_item_id", "ord", F.concat(F.lit("remediation="), F.col("trail")).alias("trail"))


QUERIES["remediation_trail"] = q_remediation_trail
ORACLE["remediation_trail"] = stage_sql(
    "SELECT work_item_id, ord, 'remediation=' || trail AS trail FROM stage_outcomes WHERE trail <> ''")


# ---- E13 / C15 ---------------------------------------------------------------
def q_execution_notes(spark, sf):
    p = planning.with_plan(tickets(spark, sf))
    x = stages.stage_cross(p)
    return x.select("work_item_id", "ord", "environment", T.execution_notes(
        F.col("environment"), F.col("target_catalog"), F.col("target_schema"), F.col("target_table"),
        F.col("ingestion_mode"), F.col("source_types"), F.col("target_repo"), F.col("branch_name")).alias("notes"))


NOTES_SQL = ("'Prepare ' || environment || ' deployment for ' || target_catalog || '.' || target_schema || '.' || target_table"
             " || ' using mode=' || ingestion_mode || ', sources=' || array_to_string(source_types, ',')"
             " || ', repo=' || target_repo || ', branch=' || branch_name")

QUERIES["execution_notes"] = q_execution_notes
ORACLE["execution_notes"] = with_views(["plans"], f"""
SELECT work_item_id, ord, environment, {NOTES_SQL} AS notes
FROM plans, (SELECT unnest(['dev', 'qe', 'stg', 'prod']) AS environment, unnest([1, 2, 3, 4]) AS ord) st""")


def q_stage_cross(spark, sf):
    p = planning.with_plan(tickets(spark, sf))
    return stages.stage_cross(p).groupBy("environment", "ord").agg(F.count(F.lit(1)).alias("n_plans"))


QUERIES["stage_cross"] = q_stage_cross
ORACLE["stage_cross"] = with_views(["work_items"], """
SELECT environment, ord, count(*) AS n_plans FROM work_items,
  (SELECT unnest(['dev', 'qe', 'stg', 'prod']) AS environment, unnest([1, 2, 3, 4]) AS ord) st GROUP BY environment, ord""")


# ---- C30 / C28 ---------------------------------------------------------------
def q_run_ids(spark, sf):
    return stages.run_ids(views.stage_runs(spark, sf))


QUERIES["run_ids"] = q_run_ids
ORACLE["run_ids"] = with_views(["stage_runs"], """
SELECT work_item_id, ord, attempt, 'local-' || environment AS pipeline_name,
  'local-' || environment || '-' || CAST(work_item_id AS VARCHAR) || '-' || CAST(epoch(started_at) AS BIGINT) AS run_id,
  'http://localhost/pipelines/' || run_id AS dashboard_url,
  'http://localhost/pipelines/' || run_id || '/logs' AS logs_url
FROM stage_runs""")


def q_stage_duration(spark, sf):
    return stages.stage_duration(views.stage_runs(spark, sf))


QUERIES["stage_duration"] = q_stage_duration
ORACLE["stage_duration"] = with_views(["stage_runs"], """
SELECT work_item_id, ord, attempt,
  CAST(epoch_us(started_at + to_seconds(duration_s)) - epoch_us(started_at) AS DOUBLE) / 1000000 AS duration_seconds
FROM stage_runs""")


# ---- G7 ----------------------------------------------------------------------
def q_stage_details(spark, sf):
    p = planning.with_plan(tickets(spark, sf))
    kept = stages.kept_stages(summaries(spark, sf))
    return stages.stage_details(kept, p)


QA_LIST_SQL = ("CASE environment " + " ".join(f"WHEN '{s}' THEN '{','.join(c)}'" for s, c in K.QA_CHECKS.items())
               + f" ELSE '{','.join(K.QA_DEFAULT_CHECKS)}' END")
APPROVAL_SQL = ("CASE WHEN gate = 'not_required' THEN 'Approval not required.' WHEN gate = 'approved' "
                "THEN 'approval_status=approved, approver=' || approver || ', comment=' || comment "
                "ELSE 'approval_status=rejected, approver=' || approver || ', comment=' || comment END")
REASON_SQL = ("CASE WHEN lower(pipeline_status) IN ('succeeded', 'success', 'completed') AND qa_passed "
              "THEN 'Promotion allowed from ' || environment || '.' ELSE 'Promotion blocked at ' || environment "
              "|| ': pipeline_status=' || pipeline_status || ', qa_passed=' || CASE WHEN qa_passed THEN 'True' ELSE 'False' END || '.' END")

QUERIES["stage_details"] = q_stage_details
ORACLE["stage_details"] = stage_sql(f"""
SELECT k.work_item_id, k.ord, k.environment, k.stage_status,
  CASE WHEN gate = 'denied' THEN 'Promotion denied at ' || environment || '. ' || {APPROVAL_SQL}
  ELSE concat_ws(' | ', {NOTES_SQL}, {APPROVAL_SQL},
    CASE WHEN environment IN ('dev') THEN 'Local Databricks simulation completed. Job spec written to jobs/' || environment
         || '_work_item_' || CAST(k.work_item_id AS VARCHAR) || '.yaml.'
         ELSE 'Databricks apply skipped for stage=' || environment || ' by workflow config.' END,
    'pipeline_run_id=local-' || environment || '-' || CAST(k.work_item_id AS VARCHAR) || '-'
      || CAST(CAST(epoch(pipeline_started_at) AS BIGINT) AS VARCHAR),
    'QA checks ' || CASE WHEN qa_passed THEN 'passed' ELSE 'failed' END || ' in ' || environment || ' for '
      || target_catalog || '.' || target_schema || '.' || target_table || ': ' || {QA_LIST_SQL},
    {REASON_SQL},
    CASE WHEN trail <> '' THEN 'remediation=' || trail ELSE '' END) END AS details
FROM kept k JOIN plans p ON p.work_item_id = k.work_item_id""", more_views=["plans"])


# ---- P3: learning feedback ---------------------------------------------------
def reached_stage_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Plans of runs that reached the stage loop: not skipped by the ledger and
    clarification complete under automatic answers (the table question is the
    one automatic answers cannot settle)."""
    p = planning.with_plan(tickets(spark, sf))
    p = intake.skip_completed(p, views.run_ledger(spark, sf))
    return p.where(~F.array_contains("clarification_questions", K.Q_TABLE))


def q_learning_feedback(spark, sf):
    s = summaries(spark, sf).select("work_item_id", "overall_status")
    p = reached_stage_loop(spark, sf).select("work_item_id", "title", "target_table", "source_types")
    rows = s.join(p, "work_item_id").withColumn("reached_stages", F.lit(True))
    fb = learning.learning_feedback(rows)
    return fb.select("work_item_id", "status", "target_table", F.array_join("source_types", ",").alias("source_types"))


QUERIES["learning_feedback"] = q_learning_feedback
ORACLE["learning_feedback"] = stage_sql(f"""
SELECT DISTINCT k.work_item_id, k.overall_status AS status, p.target_table, array_to_string(p.source_types, ',') AS source_types
FROM run_status k JOIN plans p ON p.work_item_id = k.work_item_id
WHERE NOT list_contains(p.clarification_questions, '{K.Q_TABLE}')
  AND p.run_key NOT IN (SELECT run_key FROM (SELECT run_key, arg_max(status, seq) AS s FROM run_ledger GROUP BY run_key) WHERE s = 'succeeded')
""", more_views=["plans", "run_ledger"])


# ---- B6 / B7 / B8: text artefacts -------------------------------------------
def q_job_specs(spark, sf):
    from relaylake.sinks import artifacts
    p = planning.with_plan(tickets(spark, sf))
    return artifacts.job_specs(stages.stage_cross(p).where(F.col("environment").isin(*K.APPLY_STAGES)))


QUERIES["job_specs"] = q_job_specs
ORACLE["job_specs"] = with_views(["plans"], """
SELECT 'dev' AS environment, work_item_id,
  '# local simulation artifact' || chr(10) || 'work_item_id: ' || CAST(work_item_id AS VARCHAR) || chr(10)
  || 'environment: dev' || chr(10) || 'target_table: ' || target_catalog || '.' || target_schema || '.' || target_table || chr(10)
  || 'ingestion_mode: ' || ingestion_mode || chr(10) || 'notebook_tasks:' || chr(10)
  || '  - create_unity_catalog_table' || chr(10) || '  - run_ingestion_notebook' || chr(10) || '  - run_data_quality_checks' || chr(10) AS spec
FROM plans""")


def q_change_notes(spark, sf, plan_rows=None):
    from relaylake.sinks import artifacts
    return artifacts.change_notes(plans(spark, sf) if plan_rows is None else plan_rows)


QUERIES["change_notes"] = q_change_notes
ORACLE["change_notes"] = with_views(["plans"], """
SELECT work_item_id, 'generated_changes/work_item_' || CAST(work_item_id AS VARCHAR) || '.md' AS path,
  concat_ws(chr(10), '# Work Item ' || CAST(work_item_id AS VARCHAR), 'Title: ' || title, 'Priority: ' || CAST(priority AS VARCHAR),
    'Target Repo: ' || target_repo, 'Branch: ' || branch_name,
    'Target Table: ' || target_catalog || '.' || target_schema || '.' || target_table,
    'Ingestion Mode: ' || ingestion_mode, 'Source Types: ' || array_to_string(source_types, ', ')) AS note
FROM plans""")


def q_remediation_notes(spark, sf, plan_rows=None, stage_outcomes=None):
    from relaylake.sinks import artifacts
    p = plans(spark, sf) if plan_rows is None else plan_rows
    o = outcomes(spark, sf) if stage_outcomes is None else stage_outcomes
    return artifacts.remediation_notes(o, p)


QUERIES["remediation_notes"] = q_remediation_notes
ORACLE["remediation_notes"] = stage_sql("""
SELECT u.work_item_id, so1.environment, u.j AS attempt,
  'generated_changes/remediation_' || CAST(u.work_item_id AS VARCHAR) || '_' || so1.environment || '_attempt_' || CAST(u.j AS VARCHAR) || '.md' AS path,
  concat_ws(chr(10), '# Remediation for Work Item ' || CAST(u.work_item_id AS VARCHAR), 'Environment: ' || so1.environment,
    'Attempt: ' || CAST(u.j AS VARCHAR), 'Repo: ' || p.target_repo,
    'Target Table: ' || p.target_catalog || '.' || p.target_schema || '.' || p.target_table, 'Suggested Fix:',
    'Investigate ' || so1.environment || ' pipeline failure for ' || p.target_table
      || '. Focus on schema mismatch, missing source credentials, and DQ rule failures.') AS note
FROM used u JOIN so1 USING (work_item_id, ord) JOIN plans p ON p.work_item_id = u.work_item_id
WHERE NOT u.denied""", more_views=["plans"])


# ---- B5: run summary as JSON -------------------------------------------------
GENERATED_AT = "2024-01-31T00:00:00Z"  # a run's own time would change the rows


def q_run_summary_json(spark, sf, generated_at: str = GENERATED_AT, plan_rows=None, stage_outcomes=None):
    """One JSON document per run: ticket, repository, questions, and the
    ordered, nested stage results with their times."""
    p = plans(spark, sf) if plan_rows is None else plan_rows
    p = p.select("work_item_id", "title", "target_repo", "clarification_questions")
    s = summaries(spark, sf, stage_outcomes).join(p, "work_item_id")
    doc = F.struct(
        F.col("work_item_id"), F.col("title"), F.col("target_repo").alias("repository"), F.col("overall_status"),
        F.col("clarification_questions").alias("clarification"), F.lit(generated_at).alias("generated_at"),
        F.coalesce("repository_details", F.lit("")).alias("repository_failure"),
        F.transform("stage_results", lambda x: F.struct(
            x["environment"].alias("environment"), x["stage_status"].alias("status"), x["gate"].alias("gate"),
            x["attempts_used"].alias("attempts"), x["trail"].alias("trail"),
            F.date_format(x["pipeline_started_at"], "yyyy-MM-dd HH:mm:ss").alias("started_at"))).alias("stage_results"))
    return s.select("work_item_id", F.to_json(doc).alias("summary_json"))


QUERIES["run_summary_json"] = q_run_summary_json
ORACLE["run_summary_json"] = stage_sql(f"""
SELECT k.work_item_id, CAST(to_json(struct_pack(work_item_id := k.work_item_id, title := any_value(p.title), repository := any_value(p.target_repo),
  overall_status := any_value(k.overall_status), clarification := any_value(p.clarification_questions), generated_at := '{GENERATED_AT}',
  repository_failure := any_value(coalesce(k.repository_details, '')), stage_results := coalesce(list(struct_pack(environment := environment, status := stage_status, gate := gate, attempts := attempts_used, trail := trail,
                                    started_at := strftime(pipeline_started_at, '%Y-%m-%d %H:%M:%S')) ORDER BY ord) FILTER (WHERE s.ord IS NOT NULL), []))) AS VARCHAR) AS summary_json
FROM run_status k JOIN plans p ON p.work_item_id = k.work_item_id LEFT JOIN kept s ON s.work_item_id = k.work_item_id GROUP BY k.work_item_id""", more_views=["plans"])


# ---- B5, B7, B8, B9, B12: written and read back ------------------------------
def q_artifact_store(spark, sf):
    """Run summaries, notes, clarification comments and learning history
    written as versions of one table, and its last version read back. The plans
    and stage outcomes that several of the texts tell of are worked out once."""
    from relaylake.plans import q_clarify
    from relaylake.sinks import artifacts as AR
    table = AR.artifact_table(spark, scratch_path(spark, f"relaylake-artifacts/{uuid.uuid4().hex[:12]}"))
    history = views.learning_history(spark, sf)
    p = stored(plans(spark, sf).select(
        "work_item_id", "title", "priority", "target_repo", "branch_name", "target_catalog", "target_schema", "target_table", "ingestion_mode",
        "source_types", "clarification_questions"), "plans")
    o = stored(outcomes(spark, sf), "outcomes")
    parts = [
        AR.artifact_rows(q_run_summary_json(spark, sf, plan_rows=p, stage_outcomes=o), "run_summary", "work_item_id", F.lit("summary.json"), F.col("summary_json")),
        AR.artifact_rows(q_change_notes(spark, sf, p), "change_note", "work_item_id", F.col("path"), F.col("note")),
        AR.artifact_rows(q_remediation_notes(spark, sf, p, o), "remediation_note", "work_item_id", F.col("path"), F.col("note")),
        AR.artifact_rows(q_clarify.q_clarification_comments(spark, sf), "comment", None,
                         F.concat_ws(":", "request_id", F.col("line_no").cast("string")), F.col("line")),
        AR.artifact_rows(history, "history", "work_item_id", F.col("target_table"), F.concat_ws(",", "status", "source_types")),
    ]
    for batch, part in enumerate(parts):
        table.append(part, batch)
        table.append(part, batch)  # once more, as after a failure: left out
    return table.read().select("kind", "work_item_id", "name", F.sha2("body", 256).alias("body_sha256"))


def _artifact_sql() -> str:
    from relaylake.plans import q_clarify
    history = with_views(["learning_history"], "SELECT work_item_id, target_table, status || ',' || array_to_string(source_types, ',') AS body FROM learning_history")
    return f"""SELECT kind, work_item_id, name, sha256(body) AS body_sha256 FROM (
  SELECT 'run_summary' AS kind, work_item_id, 'summary.json' AS name, summary_json AS body FROM ({ORACLE['run_summary_json']})
  UNION ALL SELECT 'change_note', work_item_id, path, note FROM ({ORACLE['change_notes']})
  UNION ALL SELECT 'remediation_note', work_item_id, path, note FROM ({ORACLE['remediation_notes']})
  UNION ALL SELECT 'comment', NULL, request_id || ':' || line_no, line FROM ({q_clarify.ORACLE['clarification_comments']})
  UNION ALL SELECT 'history', work_item_id, target_table, body FROM ({history}))"""


QUERIES["artifact_store"] = q_artifact_store
ORACLE["artifact_store"] = _artifact_sql()


# ---- A10: template chosen per row from the template table -------------------
def q_stage_messages(spark, sf):
    """A10/C20: a message per stage that ran, from the template each row
    names (failure remediation for failed stages, approval suggestion for
    approved ones, none otherwise → fallback). The template table is a
    handful of rows, joined by broadcast on the name."""
    from relaylake.functions import templates as TPL
    from relaylake.operators import approvals as A
    p = planning.with_plan(tickets(spark, sf)).select("work_item_id", "target_catalog", "target_schema", "target_table",
                                                      "target_repo", "ingestion_mode")
    k = stages.kept_stages(summaries(spark, sf)).join(p, "work_item_id")
    k = k.withColumn("template_name", F.when(F.col("stage_status") == "failed", F.lit("failure_remediation"))
                     .when(F.col("gate") == "approved", F.lit("approval_suggestion")).otherwise(F.lit("stage_note")))
    k = A.with_guidance(k.withColumn("stage", F.col("environment")), A.guidance_table(spark))
    ctx = {
        "environment": F.col("environment"), "attempt": F.col("attempts_used"),
        "target_table": F.concat_ws(".", "target_catalog", "target_schema", "target_table"),
        "repo": F.col("target_repo"), "ingestion_mode": F.col("ingestion_mode"), "failure_context": F.col("trail"),
        "stage": F.col("environment"), "risk_level": F.col("risk_level"),
        "summary": F.concat(F.lit("stage "), F.col("environment"), F.lit(" of work item "), F.col("work_item_id").cast("string")),
        "checklist": TPL.python_list(F.col("checklist")),
    }
    out = TPL.render_by_name(k, TPL.template_table(spark), "template_name", ctx,
                             F.concat(F.lit("No template for stage "), F.col("environment"), F.lit(".")), "message")
    return out.select("work_item_id", "ord", "template_name", F.sha2("message", 256).alias("message_sha256"))


def _render_sql(name: str, fields: list[tuple[str, str]]) -> str:
    out = "'" + K.TEMPLATES[name].replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for key, v in fields:
        out = f"replace({out}, '{{{key}}}', {v})"
    return out


def _stage_messages_sql() -> str:
    from relaylake.plans.q_approvals import CHECKLIST_PY_SQL, RISK_SQL
    checklist = CHECKLIST_PY_SQL.replace("lower(trim(stage))", "environment")
    risk = RISK_SQL.replace("lower(trim(stage))", "environment")
    rem = _render_sql("failure_remediation", [
        ("environment", "environment"), ("attempt", "CAST(attempts_used AS VARCHAR)"),
        ("target_table", "target_catalog || '.' || target_schema || '.' || target_table"), ("repo", "target_repo"),
        ("ingestion_mode", "ingestion_mode"), ("failure_context", "trail")])
    sug = _render_sql("approval_suggestion", [
        ("stage", "environment"), ("risk_level", risk),
        ("summary", "'stage ' || environment || ' of work item ' || CAST(k.work_item_id AS VARCHAR)"),
        ("checklist", checklist)])
    return stage_sql(f"""
SELECT work_item_id, ord, template_name, sha256(CASE template_name WHEN 'failure_remediation' THEN {rem}
    WHEN 'approval_suggestion' THEN {sug} ELSE 'No template for stage ' || environment || '.' END) AS message_sha256
FROM (SELECT k.*, p.target_catalog, p.target_schema, p.target_table, p.target_repo, p.ingestion_mode,
        CASE WHEN k.stage_status = 'failed' THEN 'failure_remediation' WHEN k.gate = 'approved' THEN 'approval_suggestion'
             ELSE 'stage_note' END AS template_name
      FROM kept k JOIN plans p ON p.work_item_id = k.work_item_id) k""", more_views=["plans"])


QUERIES["stage_messages"] = q_stage_messages
ORACLE["stage_messages"] = _stage_messages_sql()


# ---- P3 full cycle: feedback → history → source rank ------------------------
def q_learning_cycle(spark, sf):
    """This cycle's learning rows are appended after the stored history
    (in ticket order) and the source-type rank is recomputed from all of them.
    The sequence goes on as (is_new, key): no global row numbering is needed."""
    s = summaries(spark, sf).select("work_item_id", "overall_status")
    p = reached_stage_loop(spark, sf).select("work_item_id", "source_types")
    new = s.join(p, "work_item_id").select(F.lit(1).alias("grp"), F.col("work_item_id").alias("k"), "source_types")
    old = views.learning_history(spark, sf).select(F.lit(0).alias("grp"), F.col("seq").alias("k"), "source_types")
    seq = (F.col("grp") * (1 << 40) + F.col("k")).alias("seq")
    return learning.source_rank(learning.append_history(old.select(seq, "source_types"), new.select(seq, "source_types")))


QUERIES["learning_cycle"] = q_learning_cycle
ORACLE["learning_cycle"] = stage_sql(f"""
SELECT source_type, CAST(count(*) AS BIGINT) AS n,
  CAST(row_number() OVER (ORDER BY count(*) DESC, min(seq), min(pos)) AS INTEGER) AS rank
FROM (SELECT grp * 1099511627776 + k AS seq, unnest(source_types) AS source_type,
             unnest(generate_series(0, len(source_types) - 1)) AS pos
      FROM (SELECT * FROM (
              SELECT 1 AS grp, k.work_item_id AS k, any_value(p.source_types) AS source_types
              FROM run_status k JOIN plans p ON p.work_item_id = k.work_item_id
              WHERE NOT list_contains(p.clarification_questions, '{K.Q_TABLE}')
                AND p.run_key NOT IN (SELECT run_key FROM (SELECT run_key, arg_max(status, seq) AS s FROM run_ledger GROUP BY run_key)
                                      WHERE s = 'succeeded')
              GROUP BY k.work_item_id
              UNION ALL
              SELECT 0, seq, source_types FROM learning_history)))
GROUP BY source_type""", more_views=["plans", "run_ledger", "learning_history"])
