"""Text artefacts per ticket / stage / attempt (B5-B9, B12) and their sink.

The texts are built as columns and written as rows of a versioned table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake.sinks.versioned import VersionedTable


NL = "\n"


def _table(prefix: str = "") -> Column:
    return F.concat_ws(".", F.col(prefix + "target_catalog"), F.col(prefix + "target_schema"),
                       F.col(prefix + "target_table"))


def job_specs(plan_stages: DataFrame) -> DataFrame:
    """Job-spec text per (environment, ticket)."""
    tasks = F.array_join(F.transform("notebook_tasks", lambda t: F.concat(F.lit("  - "), t, F.lit(NL))), "")
    spec = F.concat(
        F.lit("# local simulation artifact" + NL),
        F.lit("work_item_id: "), F.col("work_item_id").cast("string"), F.lit(NL),
        F.lit("environment: "), F.col("environment"), F.lit(NL),
        F.lit("target_table: "), _table(), F.lit(NL),
        F.lit("ingestion_mode: "), F.col("ingestion_mode"), F.lit(NL),
        F.lit("notebook_tasks:" + NL), tasks)
    return plan_stages.select("environment", "work_item_id", spec.alias("spec"))


def change_notes(plans: DataFrame) -> DataFrame:
    """Change note per ticket."""
    note = F.concat_ws(
        NL,
        F.concat(F.lit("# Work Item "), F.col("work_item_id").cast("string")),
        F.concat(F.lit("Title: "), F.col("title")),
        F.concat(F.lit("Priority: "), F.col("priority").cast("string")),
        F.concat(F.lit("Target Repo: "), F.col("target_repo")),
        F.concat(F.lit("Branch: "), F.col("branch_name")),
        F.concat(F.lit("Target Table: "), _table()),
        F.concat(F.lit("Ingestion Mode: "), F.col("ingestion_mode")),
        F.concat(F.lit("Source Types: "), F.array_join("source_types", ", ")))
    path = F.concat(F.lit("generated_changes/work_item_"), F.col("work_item_id").cast("string"), F.lit(".md"))
    return plans.select("work_item_id", path.alias("path"), note.alias("note"))


def fallback_suggestion(environment: Column, target_table: Column) -> Column:
    """C21 fallback text (used when the template is not available)."""
    return F.concat(F.lit("Investigate "), environment, F.lit(" pipeline failure for "), target_table,
                    F.lit(". Focus on schema mismatch, missing source credentials, and DQ rule failures."))


def remediation_notes(outcomes: DataFrame, plans: DataFrame) -> DataFrame:
    """Note per (ticket, environment, remediation attempt) that was
    approved (denied attempts write nothing)."""
    att = outcomes.select("work_item_id", "environment", F.inline("remediations")).where(~F.col("denied"))
    p = plans.select("work_item_id", "target_repo", "target_catalog", "target_schema", "target_table")
    j = att.join(p, "work_item_id")
    js = F.col("j").cast("string")
    note = F.concat_ws(
        NL,
        F.concat(F.lit("# Remediation for Work Item "), F.col("work_item_id").cast("string")),
        F.concat(F.lit("Environment: "), F.col("environment")),
        F.concat(F.lit("Attempt: "), js),
        F.concat(F.lit("Repo: "), F.col("target_repo")),
        F.concat(F.lit("Target Table: "), _table()),
        F.lit("Suggested Fix:"),
        fallback_suggestion(F.col("environment"), F.col("target_table")))
    path = F.concat(F.lit("generated_changes/remediation_"), F.col("work_item_id").cast("string"), F.lit("_"),
                    F.col("environment"), F.lit("_attempt_"), js, F.lit(".md"))
    return j.select("work_item_id", "environment", F.col("j").alias("attempt"), path.alias("path"), note.alias("note"))


SCHEMA = "kind string, work_item_id long, name string, body string"


def artifact_table(spark: SparkSession, path: str) -> VersionedTable:
    """Where texts are kept: one row each, by kind. A write is seen whole or
    not at all, and a batch that is written again is left out."""
    return VersionedTable(spark, path, SCHEMA)


def artifact_rows(df: DataFrame, kind: str, work_item_id: str | None, name: Column, body: Column) -> DataFrame:
    key = F.col(work_item_id).cast("long") if work_item_id else F.lit(None).cast("long")
    return df.select(F.lit(kind).alias("kind"), key.alias("work_item_id"), name.alias("name"), body.alias("body"))
