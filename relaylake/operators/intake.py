"""Ticket intake: normalisation, board filter, ranking and de-duplication.

Operators C1-C3, F1, T1-T3, E1, E2, C23 (see SURVEY section 2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import text as T


def normalize_tickets(df: DataFrame, strict_types: bool = True) -> DataFrame:
    """Defaults for missing fields, enum check, repo hint from tags.

    ``strict_types`` raises on an unknown type (file scan behaviour); when
    False an unknown type becomes the default type (board payload behaviour).
    """
    cols = set(df.columns)

    def opt(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in cols else default

    item_type = opt("item_type", F.lit(K.DEFAULT_ITEM_TYPE))
    valid = item_type.isin(*K.WORK_ITEM_TYPES)
    if strict_types:
        item_type = F.when(valid, item_type).otherwise(
            F.raise_error(F.concat(F.lit("unknown work item type: "), item_type)))
    else:
        item_type = F.when(valid, item_type).otherwise(F.lit(K.DEFAULT_ITEM_TYPE))
    tags = opt("tags", T.empty_str_array())
    explicit_repo = F.nullif(T.strip(opt("repo_name", F.lit(""))), F.lit(""))
    extra = [c for c in ("project", "changed_date", "ingested_at") if c in cols]
    return df.select(
        F.col("id").cast("bigint").alias("id"),
        F.col("title").cast("string").alias("title"),
        opt("description", F.lit("")).cast("string").alias("description"),
        item_type.alias("item_type"),
        tags.alias("tags"),
        opt("acceptance_criteria", F.lit("")).cast("string").alias("acceptance_criteria"),
        opt("priority", F.lit(K.DEFAULT_PRIORITY)).cast("int").alias("priority"),
        F.coalesce(explicit_repo, T.repo_from_tags(tags)).alias("repo_name"),
        opt("state", F.lit(K.DEFAULT_STATE)).cast("string").alias("state"),
        *extra,
    )


def board_filter(df: DataFrame, project: str | None = None,
                 types: list[str] | None = None) -> DataFrame:
    """project = @project AND type IN (...) AND state <> 'Closed'.
    The predicate reaches the parquet scan where the columns are stored."""
    cond = F.col("item_type").isin(*(types or K.WORK_ITEM_TYPES)) & (F.col("state") != K.CLOSED_STATE)
    if project is not None:
        cond = cond & (F.col("project") == project)
    return df.where(cond)


def top_k(df: DataFrame, k: int) -> DataFrame:
    """Best k by (priority asc, id asc) — a TakeOrderedAndProject, so each
    partition keeps only k rows before the final merge."""
    return df.orderBy(F.col("priority").asc(), F.col("id").asc()).limit(k)


def two_phase_top_k(df: DataFrame, k: int) -> DataFrame:
    """Choose k by (priority asc, changed_date desc, id asc), present by
    (priority, id)."""
    chosen = df.orderBy(F.col("priority").asc(), F.col("changed_date").desc(), F.col("id").asc()).limit(k)
    return chosen.orderBy("priority", "id")


def queue_head_per_repo(df: DataFrame, repo_col: str = "target_repo") -> DataFrame:
    """Head ticket per repository queue.

    A grouped ``min_by`` instead of a ranking window: the aggregate is
    partial on the map side, so a repository holding a third of all tickets
    still ships one row per partition to the reducer."""
    order_key = F.struct(F.col("priority"), F.col("id"))
    head = F.min_by(F.struct(F.col("id"), F.col("priority"), F.col("title")), order_key)
    return (df.groupBy(repo_col).agg(head.alias("h"), F.count(F.lit(1)).alias("queue_length"))
            .select(repo_col, "h.id", "h.priority", "h.title", "queue_length"))


def select_details(details: DataFrame, ids: DataFrame) -> DataFrame:
    """Ticket details for chosen ids (left semi join)."""
    return details.join(ids.select("id"), "id", "left_semi")


def with_run_key(df: DataFrame) -> DataFrame:
    """Idempotency key id:sha256(id|strip(title)|strip(description))[:16]."""
    return df.withColumn("run_key", T.run_key(F.col("id"), F.col("title"), F.col("description")))


# FIXED VALUES: the run ledger's status domain (written by the run loop only).
LEDGER_STATUSES = ["in_progress", "succeeded", "failed"]


def _status_code(status: Column) -> Column:
    expr = None
    for i, s in enumerate(LEDGER_STATUSES):
        expr = F.when(status == s, F.lit(i)) if expr is None else expr.when(status == s, F.lit(i))
    return expr.otherwise(F.lit(None).cast("int"))


def latest_run_status(ledger: DataFrame) -> DataFrame:
    """Last write wins per run key.

    The status is aggregated as a small integer code: ``max_by`` over a
    fixed-width buffer runs as a hash aggregate with map-side partial
    aggregation (a string buffer would force a sort-based aggregate)."""
    agg = ledger.groupBy("run_key").agg(F.max_by(_status_code(F.col("status")), F.col("seq")).alias("_code"),
                                        F.max("seq").alias("seq"))
    return agg.select("run_key", F.get(F.array(*[F.lit(s) for s in LEDGER_STATUSES]), F.col("_code")).alias("status"),
                      "seq")


def succeeded_keys(ledger: DataFrame) -> DataFrame:
    """Run keys whose latest ledger entry is ``succeeded`` (boolean buffer,
    hash aggregate)."""
    latest = ledger.groupBy("run_key").agg(F.max_by(F.col("status") == "succeeded", F.col("seq")).alias("done"))
    return latest.where(F.col("done")).select("run_key")


def skip_completed(tickets: DataFrame, ledger: DataFrame) -> DataFrame:
    """Drop tickets whose key already succeeded; in_progress and failed keys
    do not block. Left anti join on run_key."""
    done = succeeded_keys(ledger)
    keyed = tickets if "run_key" in tickets.columns else with_run_key(tickets)
    return keyed.join(done, "run_key", "left_anti")
