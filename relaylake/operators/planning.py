"""Requirement planning: ticket text → ingestion plan columns.

Operators C4-C15, C31, E4, E5, E11, F5, W7 (SURVEY section 2). One chained
projection per plan; no UDF, so the whole plan stays in one codegen span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import text as T

PLAN_COLUMNS = [
    "work_item_id", "source_types", "ingestion_mode", "target_layer", "target_catalog",
    "target_schema", "target_table", "target_repo", "branch_name", "notebook_tasks",
    "risk_notes", "needs_clarification", "clarification_questions",
]


def with_plan(tickets: DataFrame, default_repo: str = K.DEFAULT_REPO,
              branch_prefix: str = K.BRANCH_PREFIX) -> DataFrame:
    """C11: add every plan column to normalised tickets (keeps ticket columns)."""
    text = T.requirement_text(F.col("title"), F.col("description"), F.col("acceptance_criteria"))
    blob = F.lower(text)
    tickets = tickets.withColumns({"_text": text, "_blob": blob})
    t, b = F.col("_text"), F.col("_blob")
    tickets = tickets.withColumn("_tm", T.table_match(t))
    catalog, schema, table, explicit = T.table_parts(F.col("_tm"), F.col("id"))
    out = tickets.withColumns({
        "work_item_id": F.col("id"),
        "source_types": T.source_types(b),
        "_sources_explicit": T.has_jdbc(b) | T.has_flat_file(b),
        "ingestion_mode": T.ingestion_mode(b),
        "_mode_explicit": T.ingestion_explicit(b),
        "_table_explicit": explicit,
        "target_layer": F.lit(K.TARGET_LAYER),
        "target_catalog": catalog,
        "target_schema": schema,
        "target_table": table,
        "target_repo": F.coalesce(F.col("repo_name"), F.lit(default_repo)),
        "branch_name": T.branch_name(F.col("id"), F.col("title"), branch_prefix),
        "notebook_tasks": T.str_array(K.NOTEBOOK_TASKS),
    })
    out = out.withColumns({
        "risk_notes": T.risk_notes(F.col("source_types"), F.col("ingestion_mode")),
        "clarification_questions": T.clarification_questions(
            F.col("_table_explicit"), F.col("_sources_explicit"), F.col("_mode_explicit"),
            F.col("repo_name"), F.col("acceptance_criteria")),
    })
    out = out.withColumn("needs_clarification", F.size("clarification_questions") > 0)
    return out.drop("_text", "_blob", "_tm", "_sources_explicit", "_mode_explicit", "_table_explicit")


def rank_sources(plans: DataFrame, source_rank: DataFrame) -> DataFrame:
    """Reorder each plan's source types by historical rank, unseen last,
    ties by original position (stable).

    ``source_rank`` (source_type, rank) has one row per distinct source type,
    so the join side is tiny; AQE broadcasts it from measured size. The
    re-grouping is by unique plan id, so there is no hot key.
    """
    exploded = plans.select("work_item_id", F.posexplode("source_types").alias("pos", "source_type"))
    ranked = exploded.join(source_rank.select("source_type", "rank"), "source_type", "left")
    big = F.lit(1 << 30)
    ordered = ranked.groupBy("work_item_id").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("rank"), big).alias("r"),
                                             F.col("pos"), F.col("source_type")))).alias("s"))
    reordered = ordered.select("work_item_id", F.transform("s", lambda x: x["source_type"]).alias("ranked_sources"))
    return plans.join(reordered, "work_item_id", "left").withColumn(
        "source_types", F.coalesce(F.col("ranked_sources"), F.col("source_types"))).drop("ranked_sources")


def active_view(plans: DataFrame, limit: int = 50) -> DataFrame:
    """The eight-column active-ticket listing, best `limit` tickets."""
    return plans.orderBy("priority", "id").limit(limit).select(
        "id", "title", F.col("item_type").alias("type"), "priority", "repo_name", "state",
        "needs_clarification", "clarification_questions")


def enrich(plans: DataFrame, enrichment: DataFrame) -> DataFrame:
    """External enrichment overrides source types / mode when present."""
    e = enrichment.select(F.col("work_item_id"), F.col("source_types").alias("_e_sources"),
                          F.col("ingestion_mode").alias("_e_mode"))
    return (plans.join(e, "work_item_id", "left")
            .withColumn("source_types", F.coalesce("_e_sources", "source_types"))
            .withColumn("ingestion_mode", F.coalesce("_e_mode", "ingestion_mode"))
            .drop("_e_sources", "_e_mode"))
