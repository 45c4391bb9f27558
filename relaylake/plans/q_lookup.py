"""Registered queries: lookups and rule tables (E1, E4, E8, A9, A10, C20/C11 summary, Q1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import templates as TPL
from relaylake.functions import text as T
from relaylake.operators import intake, planning, stages
from relaylake.operators import quality as Q
from relaylake.plans.q_intake import TOP_K, open_tickets, tickets
from relaylake.plans.sqlviews import with_views
from relaylake.sources import views
from relaylake.sources.tables import TABLES, table

QUERIES: dict = {}
ORACLE: dict = {}


# ---- E1 ----------------------------------------------------------------------
def q_intake_details(spark, sf):
    """The chosen ids (top-k of the board query) ⋉ full ticket details."""
    ids = intake.top_k(open_tickets(spark, sf), TOP_K).select("id")
    return intake.select_details(tickets(spark, sf), ids).select("id", "title", "description", "priority")


QUERIES["intake_details"] = q_intake_details
ORACLE["intake_details"] = with_views(["tickets"], f"""
SELECT id, title, description, priority FROM tickets WHERE id IN (
  SELECT id FROM tickets WHERE item_type IN ('Product Backlog Item', 'Bug', 'User Story') AND state <> 'Closed'
  ORDER BY priority, id LIMIT {TOP_K})""")


# ---- E4 ----------------------------------------------------------------------
def enrichment(spark, sf):
    """External enrichment rows (from orders): every eleventh ticket gets a
    source list and mode from the enrichment service."""
    o = table(spark, sf, "orders")
    return o.where(F.col("o_orderkey") % 11 == 0).select(
        F.col("o_orderkey").alias("work_item_id"),
        F.when(F.col("o_custkey") % 2 == 0, T.str_array(["jdbc"])).otherwise(T.str_array(["flat_file", "jdbc"])).alias("source_types"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("overwrite")).alias("ingestion_mode"))


def q_enrichment_override(spark, sf):
    p = planning.enrich(planning.with_plan(tickets(spark, sf)), enrichment(spark, sf))
    return p.select("work_item_id", F.array_join("source_types", ",").alias("source_types"), "ingestion_mode")


QUERIES["enrichment_override"] = q_enrichment_override
ORACLE["enrichment_override"] = with_views(["plans"], """
SELECT p.work_item_id, array_to_string(coalesce(e.s, p.source_types), ',') AS source_types,
  coalesce(e.m, p.ingestion_mode) AS ingestion_mode
FROM plans p LEFT JOIN (
  SELECT o_orderkey AS work_item_id, CASE WHEN o_custkey % 2 = 0 THEN ['jdbc'] ELSE ['flat_file', 'jdbc'] END AS s,
         CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'overwrite' END AS m
  FROM orders WHERE o_orderkey % 11 = 0) e USING (work_item_id)""")


# ---- E8 ----------------------------------------------------------------------
def pipeline_catalog(spark, sf):
    """Pipeline catalog (name, id, listing order) from supplier; names repeat,
    the first listed wins."""
    s = table(spark, sf, "supplier")
    return s.select(F.concat(F.lit("local-"), F.get(T.str_array(K.STAGE_SEQUENCE + ["uat"]), (F.col("s_suppkey") % 5).cast("int")))
                    .alias("name"), F.col("s_suppkey").alias("pipeline_id"), F.col("s_suppkey").alias("ord"))


def q_resolve_run_names(spark, sf):
    names = stages.run_ids(views.stage_runs(spark, sf)).select("pipeline_name").distinct()
    extra = spark.createDataFrame([("local-unknown",)], "pipeline_name string")
    return stages.resolve_pipelines(names.unionByName(extra), pipeline_catalog(spark, sf))


QUERIES["resolve_run_names"] = q_resolve_run_names
ORACLE["resolve_run_names"] = with_views(["stage_runs"], """
SELECT n.pipeline_name, c.pipeline_id, c.pipeline_id IS NOT NULL AS found
FROM (SELECT DISTINCT 'local-' || environment AS pipeline_name FROM stage_runs UNION ALL SELECT 'local-unknown') n
LEFT JOIN (SELECT name, arg_min(s_suppkey, s_suppkey) AS pipeline_id FROM (
  SELECT 'local-' || ['dev', 'qe', 'stg', 'prod', 'uat'][CAST(s_suppkey % 5 AS INTEGER) + 1] AS name, s_suppkey FROM supplier)
  GROUP BY name) c ON c.name = n.pipeline_name""")


# ---- A9 ----------------------------------------------------------------------
def qa_rule_table(spark):
    rows = [(stage, ",".join(checks)) for stage, checks in K.QA_CHECKS.items()]
    return spark.createDataFrame(rows, "environment string, checks string")


def q_rule_tables(spark, sf):
    """Stage rule tables (QA checks, approval need, checklist size) joined
    to the stage runs they govern; the rule tables are fixed and broadcast."""
    r = views.stage_runs(spark, sf).groupBy("environment").agg(F.count(F.lit(1)).alias("n_runs"))
    g = spark.createDataFrame([(s, len(c)) for s, c in K.STAGE_CHECKLISTS.items()], "environment string, checklist_items int")
    out = r.join(F.broadcast(qa_rule_table(spark)), "environment", "left").join(F.broadcast(g), "environment", "left")
    return out.select("environment", "n_runs", F.coalesce("checks", F.lit(",".join(K.QA_DEFAULT_CHECKS))).alias("checks"),
                      F.coalesce("checklist_items", F.lit(len(K.DEFAULT_CHECKLIST))).alias("checklist_items"),
                      F.col("environment").isin(*K.APPROVAL_STAGES).alias("needs_approval"))


QUERIES["rule_tables"] = q_rule_tables
ORACLE["rule_tables"] = with_views(["stage_runs"], "SELECT environment, count(*) AS n_runs, CASE environment "
    + " ".join(f"WHEN '{s}' THEN '{','.join(c)}'" for s, c in K.QA_CHECKS.items())
    + f" ELSE '{','.join(K.QA_DEFAULT_CHECKS)}' END AS checks, CAST(CASE WHEN environment IN ('qe', 'stg', 'prod') THEN 3 ELSE 1 END AS INTEGER) AS checklist_items, "
    + "environment IN ('qe', 'stg', 'prod') AS needs_approval FROM stage_runs GROUP BY environment")


# ---- A10 + C20: plan summary from the template table -----------------------
MCP_STATUS = "disabled"


def q_plan_summary(spark, sf):
    """C11 summary / C20: every plan's summary rendered from the
    ``requirement_summary`` template. The template is the same for every row,
    so it is bound as a literal when the plan is built (no join); per-row
    template choice goes through ``templates.render_by_name``."""
    p = planning.with_plan(tickets(spark, sf))
    summary = TPL.render(TPL.literal("requirement_summary"), {
        "title": F.col("title"), "description": F.col("description"), "acceptance_criteria": F.col("acceptance_criteria"),
        "target_repo": F.col("target_repo"), "priority": F.col("priority"), "mcp_status": F.lit(MCP_STATUS),
    }, F.concat(F.lit("Implement "), F.col("title")))
    return p.select("work_item_id", F.sha2(summary, 256).alias("summary_sha256"), F.length(summary).alias("summary_chars"))


def _render_sql(name: str, fields: list[tuple[str, str]]) -> str:
    out = "'" + K.TEMPLATES[name].replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for k, v in fields:
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


SUMMARY_SQL = _render_sql("requirement_summary", [
    ("priority", "CAST(priority AS VARCHAR)"), ("target_repo", "target_repo"), ("mcp_status", f"'{MCP_STATUS}'"),
    ("acceptance_criteria", "acceptance_criteria"), ("description", "description"), ("title", "title")])

QUERIES["plan_summary"] = q_plan_summary
ORACLE["plan_summary"] = with_views(["plans"], f"SELECT work_item_id, sha256({SUMMARY_SQL}) AS summary_sha256, "
                                               f"CAST(length({SUMMARY_SQL}) AS INTEGER) AS summary_chars FROM plans")


# ---- Q1 ----------------------------------------------------------------------
def q_table_exists(spark, sf):
    """Q1 for every table: its rows can be read."""
    return Q.table_exists({t: table(spark, sf, t) for t in TABLES})


QUERIES["table_exists"] = q_table_exists
ORACLE["table_exists"] = " UNION ALL ".join(
    f"SELECT 'table_exists' AS \"check\", '{t}' AS subject, CAST(CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS BIGINT) AS failed, "
    f"count(*) > 0 AS passed, 'critical' AS severity, count(*) AS n_rows FROM {t}" for t in TABLES)
