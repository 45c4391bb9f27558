"""Stage evaluation: gates, promotion, remediation attempts, run summaries.

Operators C16, C28, C30, E7, E8, E12, E13, W3, W4, G3, G6, G7, G8, P2.

Scale notes. Rows are dealt by run and sorted once; two windows follow there:
  1. per (run, stage) over its attempt rows → the stage outcome; the list
     collected there holds at most ``max_attempts`` entries (attempts beyond
     the configured maximum are filtered out before);
  2. per run over its stage outcomes → stop-at-first-failure and the run
     summary; the list holds at most one entry per configured stage.
Grouped aggregates would sort every row again before and after the shuffle, as
few rows share a stage. Attempts are numbered within their stage, so at most
``max_attempts`` + 1 rows of a stage get that far, however hot a run is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import text as T
from relaylake.operators.asof import as_of

NO_DECISION = "system-timeout"
WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def with_gates(runs: DataFrame, log: DataFrame, max_attempts: int | None = K.MAX_REMEDIATION_ATTEMPTS) -> DataFrame:
    """Each attempt with the latest decision and check result of its
    team and stage at or before its start. ``denied``: rejected, or none there
    is; ``qa_passed``: the checks passed; ``approver``, ``comment``: the
    decision's. Attempts beyond ``max_attempts`` reruns (null: none) take no part.

    ``runs``: team, environment, attempt, started_at …; ``log``: team,
    environment, since, seq, decision (approved, actor, comment), checks_passed."""
    used = runs if max_attempts is None else runs.where(F.col("attempt") <= max_attempts + 1)
    out = as_of(used, log, ["team", "environment"], "started_at", "since", "seq", ["decision", "checks_passed"], spans_of=runs)
    return out.withColumns({
        "denied": ~F.coalesce("decision.approved", F.lit(False)),
        "qa_passed": F.coalesce("checks_passed", F.lit(False)),
        "approver": F.coalesce("decision.actor", F.lit(NO_DECISION)),
        "comment": F.coalesce("decision.comment", F.lit("")),
    }).drop("decision", "checks_passed")


def promotable(status: Column, qa_passed: Column) -> Column:
    """lower(status) in {succeeded, success, completed} and QA passed."""
    return F.lower(status).isin(*K.PROMOTABLE_STATUSES) & qa_passed


def promotion_reason(environment: Column, status: Column, qa_passed: Column) -> Column:
    qa_text = F.when(qa_passed, F.lit("True")).otherwise(F.lit("False"))
    return F.when(promotable(status, qa_passed),
                  F.concat(F.lit("Promotion allowed from "), environment, F.lit(".")))\
        .otherwise(F.concat(F.lit("Promotion blocked at "), environment, F.lit(": pipeline_status="),
                            status, F.lit(", qa_passed="), qa_text, F.lit(".")))


def promotion_decision(runs: DataFrame) -> DataFrame:
    """Promotion decision and reason for every pipeline run row."""
    return runs.select(
        "work_item_id", "ord", "environment", "attempt",
        promotable(F.col("status"), F.col("qa_passed")).alias("can_promote"),
        promotion_reason(F.col("environment"), F.col("status"), F.col("qa_passed")).alias("reason"))


def stage_outcomes(runs: DataFrame, approval_stages: list[str] | None = None,
                   max_attempts: int = K.MAX_REMEDIATION_ATTEMPTS) -> DataFrame:
    """W4 + gate: one row per (run, stage).

    Attempt 1 is the first pipeline run. Remediation attempt j uses row
    j + 1: its ``denied`` flag is the remediation approval, ``fix_ok`` whether
    the fix applied, and when applied the rerun's status. The loop stops at
    the first denial or recovery; a failed fix uses up an attempt without a
    rerun. A HIL stage whose first row is denied fails at the gate.
    """
    hil = approval_stages if approval_stages is not None else K.APPROVAL_STAGES
    if "started_at" not in runs.columns:
        runs = runs.withColumn("started_at", F.lit(None).cast("timestamp_ntz"))
    for name in ("approver", "comment"):  # of the gate (attempt 1) or the remediation approval
        if name not in runs.columns:
            runs = runs.withColumn(name, F.lit(""))
    r = runs.where(F.col("attempt") <= max_attempts + 1).withColumn(
        "_promote", promotable(F.col("status"), F.col("qa_passed"))).repartition("work_item_id")
    first = F.col("attempt") == 1
    rem = F.struct(
        (F.col("attempt") - 1).alias("j"),
        F.col("denied").alias("denied"),
        F.col("fix_ok").alias("fix_ok"),
        (~F.col("denied") & F.col("fix_ok") & F.col("_promote")).alias("promote"),
        F.col("status").alias("status"),
        F.col("qa_passed").alias("qa_passed"),
        F.col("started_at").alias("started_at"),
        F.col("approver").alias("approver"),
    )
    stage = Window.partitionBy("work_item_id", "ord").orderBy("attempt")
    each = {
        "environment": F.min("environment"),  # one value per stage; min is deterministic
        "_first_denied": F.bool_or(first & F.col("denied")),
        "promote1": F.bool_or(first & F.col("_promote")),
        "status1": F.max(F.when(first, F.col("status"))),
        "qa1": F.bool_or(first & F.col("qa_passed")),
        "start1": F.max(F.when(first, F.col("started_at"))),
        "_gate_by": F.max(F.when(first, F.struct("approver", "comment"))),
        "_rems": F.collect_list(F.when(~first, rem)),
    }
    agg = r.select("work_item_id", "ord", F.row_number().over(stage).alias("_row"),
                   *[c.over(stage.rowsBetween(*WHOLE)).alias(name) for name, c in each.items()]).where("_row = 1")
    gate_denied = F.col("environment").isin(*hil) & F.col("_first_denied")
    remediate = ~gate_denied & ~F.col("promote1")
    rems = F.sort_array(F.col("_rems"))  # structs sort by j first
    stop_j = F.array_min(F.transform(F.filter(rems, lambda x: x["denied"] | x["promote"]), lambda x: x["j"]))
    used = F.filter(rems, lambda x: x["j"] <= F.coalesce(F.col("_stop"), F.lit(max_attempts)))
    out = agg.withColumns({"_gate_denied": gate_denied, "_remediate": remediate})
    out = out.withColumn("_stop", stop_j)
    out = out.withColumn("_used", F.when(F.col("_remediate"), used).otherwise(F.array().cast(used_type())))
    recovered = F.exists("_used", lambda x: x["promote"])
    succeeded = ~F.col("_gate_denied") & (F.col("promote1") | recovered)
    last_run = F.filter("_used", lambda x: ~x["denied"] & x["fix_ok"])
    final_status = F.coalesce(F.get(F.reverse(F.transform(last_run, lambda x: x["status"])), 0), F.col("status1"))
    final_qa = F.coalesce(F.get(F.reverse(F.transform(last_run, lambda x: x["qa_passed"])), 0), F.col("qa1"))
    final_start = F.coalesce(F.get(F.reverse(F.transform(last_run, lambda x: x["started_at"])), 0), F.col("start1"))
    return out.select(
        "work_item_id", "ord", "environment",
        F.when(F.col("_gate_denied"), F.lit("denied"))
         .when(F.col("environment").isin(*hil), F.lit("approved"))
         .otherwise(F.lit("not_required")).alias("gate"),
        F.col("_gate_by.approver").alias("approver"), F.col("_gate_by.comment").alias("comment"),
        F.when(succeeded, F.lit("succeeded")).otherwise(F.lit("failed")).alias("stage_status"),
        F.size("_used").alias("attempts_used"),
        F.array_join(F.transform("_used", trail_entry), " ; ").alias("trail"),
        final_status.alias("pipeline_status"),
        final_qa.alias("qa_passed"),
        final_start.alias("pipeline_started_at"),
        F.col("_used").alias("remediations"),
    )


def used_type() -> str:
    return ("array<struct<j:int,denied:boolean,fix_ok:boolean,promote:boolean,"
            "status:string,qa_passed:boolean,started_at:timestamp_ntz,approver:string>>")


def trail_entry(x: Column) -> Column:
    """G8 entry for one remediation attempt."""
    j = x["j"].cast("string")
    applied = F.concat(
        F.lit("attempt="), j, F.lit(": status="),
        F.when(x["fix_ok"], F.lit("succeeded")).otherwise(F.lit("failed")),
        F.lit("; detail="), F.when(x["fix_ok"], F.lit("fix applied")).otherwise(F.lit("fix failed")),
        F.when(x["promote"], F.concat(F.lit(" ; attempt="), j, F.lit(": pipeline recovered and QA passed")))
         .otherwise(F.lit("")))
    return F.when(x["denied"], F.concat(F.lit("attempt="), j, F.lit(": remediation approval denied by "), x["approver"])) \
        .otherwise(applied)


def failed_repositories(steps: DataFrame) -> DataFrame:
    """The runs whose repository step failed, with the first failing step:
    ``work_item_id, repository_details``."""
    failed = steps.where(F.lower("status") == "failed")
    first = F.min_by(F.concat(F.col("step"), F.lit(" failed: "), F.coalesce("detail", F.lit(""))), "seq")
    return failed.groupBy("work_item_id").agg(first.alias("repository_details"))


def run_summaries(outcomes: DataFrame, failed_repos: DataFrame | None = None) -> DataFrame:
    """W3 + G3 + G6: per run, the stages up to and including the first failed
    one, the overall status and the nested stage list (ordered by stage).

    A run in ``failed_repos`` fails before its first stage: it has a summary,
    and no stages, whether or not stage rows of it are known."""
    st = F.struct("ord", "environment", "stage_status", "gate", "approver", "comment", "attempts_used", "trail",
                  "pipeline_status", "qa_passed", "pipeline_started_at")
    run = Window.partitionBy("work_item_id").orderBy("ord")
    whole = run.rowsBetween(*WHOLE)
    agg = outcomes.select(
        "work_item_id", F.row_number().over(run).alias("_row"),
        F.sort_array(F.collect_list(st).over(whole)).alias("_all"),
        F.min(F.when(F.col("stage_status") == "failed", F.col("ord"))).over(whole).alias("first_failed_ord"),
    ).where("_row = 1").drop("_row")
    if failed_repos is None:
        agg = agg.withColumn("repository_details", F.lit(None).cast("string"))
    else:
        agg = agg.join(failed_repos, "work_item_id", "full")
    bad = F.col("repository_details").isNotNull()
    kept = F.filter("_all", lambda s: ~bad & (s["ord"] <= F.coalesce(F.col("first_failed_ord"), F.lit(1 << 20))))
    none = F.array().cast(agg.schema["_all"].dataType)
    return agg.select(
        "work_item_id",
        F.when(F.col("first_failed_ord").isNull() & ~bad, F.lit("succeeded")).otherwise(F.lit("failed")).alias("overall_status"),
        F.coalesce(kept, none).alias("stage_results"),
        F.when(~bad, F.col("first_failed_ord")).alias("first_failed_ord"),
        "repository_details",
    )


def kept_stages(summaries: DataFrame) -> DataFrame:
    """W3 as rows: one row per stage that ran."""
    return summaries.select("work_item_id", "overall_status", F.inline("stage_results"))


def stage_cross(plans: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """Every plan paired with every configured stage, in order. A
    generator over the literal stage list, not a join."""
    seq = stages or K.STAGE_SEQUENCE
    return plans.select("*", F.posexplode(T.str_array(seq)).alias("stage_pos", "environment")) \
        .withColumn("ord", F.col("stage_pos") + 1).drop("stage_pos")


def run_id_of(environment: Column, work_item_id: Column, started_at: Column, prefix: str = K.PIPELINE_PREFIX) -> Column:
    """C30 run id ``<prefix>-<env>-<ticket>-<epoch seconds>``; the epoch of a
    wall-clock (NTZ) value is taken without the session time zone."""
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                             started_at.cast("timestamp_ntz")).cast("string")
    return F.concat_ws("-", F.lit(prefix), environment, work_item_id.cast("string"), epoch)


def run_ids(runs: DataFrame, prefix: str = K.PIPELINE_PREFIX) -> DataFrame:
    """Pipeline name, run id and URLs per run row."""
    run_id = run_id_of(F.col("environment"), F.col("work_item_id"), F.col("started_at"), prefix)
    return runs.select(
        "work_item_id", "ord", "attempt",
        F.concat(F.lit(prefix + "-"), F.col("environment")).alias("pipeline_name"),
        run_id.alias("run_id"),
        F.concat(F.lit("http://localhost/pipelines/"), run_id).alias("dashboard_url"),
        F.concat(F.lit("http://localhost/pipelines/"), run_id, F.lit("/logs")).alias("logs_url"))


def stage_duration(runs: DataFrame) -> DataFrame:
    """Duration between start and finish (finish = start + duration_s)."""
    start = F.col("started_at").cast("timestamp_ntz")
    finish = start + F.make_dt_interval(secs=F.col("duration_s").cast("decimal(18,6)"))
    return runs.select("work_item_id", "ord", "attempt",
                       (F.timestamp_diff("MICROSECOND", start, finish) / 1_000_000).alias("duration_seconds"))


def resolve_pipelines(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pipeline name → id, first catalog entry wins, missing is flagged.
    The catalog is deduplicated with a partial ``min_by`` before the join."""
    first = catalog.groupBy("name").agg(F.min_by("pipeline_id", "ord").alias("pipeline_id"))
    return requests.join(first, requests["pipeline_name"] == first["name"], "left") \
        .select(requests["*"], "pipeline_id", F.col("pipeline_id").isNotNull().alias("found"))


def missing_workspaces(apply_stages: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Configured apply stages without a workspace URL (left anti)."""
    return apply_stages.join(workspaces, "stage", "left_anti")


def stage_details(kept: DataFrame, plans: DataFrame, apply_stages: list[str] | None = None) -> DataFrame:
    """The seven-part " | " details text for each stage that ran."""
    apply = apply_stages or K.APPLY_STAGES
    p = plans.select("work_item_id", "target_catalog", "target_schema", "target_table", "ingestion_mode",
                     "source_types", "target_repo", "branch_name")
    j = kept.join(p, "work_item_id")
    env = F.col("environment")
    notes = T.execution_notes(env, F.col("target_catalog"), F.col("target_schema"), F.col("target_table"),
                              F.col("ingestion_mode"), F.col("source_types"), F.col("target_repo"),
                              F.col("branch_name"))
    approval = (F.when(F.col("gate") == "not_required", F.lit("Approval not required."))
                .otherwise(F.concat(F.lit("approval_status="), F.when(F.col("gate") == "approved", F.lit("approved")).otherwise(F.lit("rejected")),
                                    F.lit(", approver="), F.col("approver"), F.lit(", comment="), F.col("comment"))))
    full_table = F.concat_ws(".", "target_catalog", "target_schema", "target_table")
    apply_text = F.when(env.isin(*apply), F.concat(
        F.lit("Local Databricks simulation completed. Job spec written to jobs/"), env, F.lit("_work_item_"),
        F.col("work_item_id").cast("string"), F.lit(".yaml."))) \
        .otherwise(F.concat(F.lit("Databricks apply skipped for stage="), env, F.lit(" by workflow config.")))
    qa_text = F.concat(F.lit("QA checks "), F.when(F.col("qa_passed"), F.lit("passed")).otherwise(F.lit("failed")),
                       F.lit(" in "), env, F.lit(" for "), full_table, F.lit(": "), qa_check_list(env))
    trail = F.when(F.col("trail") != "", F.concat(F.lit("remediation="), F.col("trail"))).otherwise(F.lit(""))
    run_id = F.concat(F.lit("pipeline_run_id="),
                      run_id_of(env, F.col("work_item_id"), F.col("pipeline_started_at")))
    ran = F.concat_ws(" | ", notes, approval, apply_text, run_id,
                      qa_text, promotion_reason(env, F.col("pipeline_status"), F.col("qa_passed")), trail)
    denied = F.concat(F.lit("Promotion denied at "), env, F.lit(". "), approval)
    return j.select("work_item_id", "ord", "environment", "stage_status",
                    F.when(F.col("gate") == "denied", denied).otherwise(ran).alias("details"))


def qa_check_list(env: Column) -> Column:
    expr = None
    for stage, checks in K.QA_CHECKS.items():
        val = F.lit(",".join(checks))
        expr = F.when(env == stage, val) if expr is None else expr.when(env == stage, val)
    return expr.otherwise(F.lit(",".join(K.QA_DEFAULT_CHECKS)))
