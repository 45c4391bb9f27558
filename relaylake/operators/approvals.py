"""Approvals over an append-only decision log.

Operators W2, B10, F2, F4, F10, F12, E3, E6, C17, C22, X2 (batch twin), X4.

The log has one row per event (requested / approved / rejected / comment)
with ``request_id``, ``stage``, ``actor``, ``ts`` and ``seq``. State is never
updated in place: the current status is the latest decision per request,
computed with partial aggregates (``max_by`` / ``min_by``) so that a request
with a very large number of events is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import text as T

DECISIONS = ["approved", "rejected"]


def requests(events: DataFrame) -> DataFrame:
    """One row per request that was actually requested: creation time, stage
    and summary of the first request event."""
    req = events.where(F.col("event") == "requested")
    # one aggregate: the earliest request event by (ts, seq) carries the rest
    first = req.groupBy("request_id").agg(
        F.min(F.struct("ts", "seq", "stage", "summary", "work_item_id")).alias("f"))
    return first.select("request_id", F.col("f.ts").alias("created_at"), F.col("f.stage").alias("stage"),
                        F.col("f.summary").alias("summary"), F.col("f.work_item_id").alias("work_item_id"))


def latest_state(events: DataFrame) -> DataFrame:
    """Status per request = its latest decision at or after creation
    (last write wins, ordered by (ts, seq)); no decision → pending."""
    reqs = requests(events)
    dec = events.where(F.col("event").isin(*DECISIONS))
    latest = dec.groupBy("request_id").agg(
        F.max_by(F.struct("event", "actor", "comment", "ts"), F.struct("ts", "seq")).alias("d"))
    j = reqs.join(latest, "request_id", "left")
    valid = F.col("d").isNotNull() & (F.col("d.ts") >= F.col("created_at"))
    return j.select(
        "request_id", "work_item_id", "stage", "summary", "created_at",
        F.when(valid, F.col("d.event")).otherwise(F.lit("pending")).alias("status"),
        F.when(valid, F.col("d.actor")).alias("approver"),
        F.when(valid, F.col("d.comment")).alias("comment"),
        F.when(valid, F.col("d.ts")).otherwise(F.col("created_at")).alias("updated_at"),
    )


def pending(state: DataFrame) -> DataFrame:
    """requests still pending."""
    return state.where(F.col("status") == "pending")


def guidance_table(spark: SparkSession) -> DataFrame:
    """C17 rule table: one row per stage with a checklist (fixed size)."""
    rows = [(stage, "high" if stage in K.HIGH_RISK_STAGES else "medium", items)
            for stage, items in K.STAGE_CHECKLISTS.items()]
    return spark.createDataFrame(rows, "stage_key string, risk_level string, checklist array<string>")


def with_guidance(pending_df: DataFrame, guidance: DataFrame) -> DataFrame:
    """Pending requests ⟕ stage guidance on lower(trim(stage)), default
    checklist for unknown stages. The guidance side is a fixed rule table of
    three rows, so it is broadcast explicitly."""
    key = F.lower(T.strip(F.col("stage")))
    j = pending_df.withColumn("stage_key", key).join(F.broadcast(guidance), "stage_key", "left")
    return j.select(
        *[c for c in pending_df.columns],
        F.lit(K.RECOMMENDED_ACTION).alias("recommended_action"),
        F.when(F.col("stage_key").isin(*K.HIGH_RISK_STAGES), F.lit("high")).otherwise(F.lit("medium")).alias("risk_level"),
        F.coalesce(F.col("checklist"), T.str_array(K.DEFAULT_CHECKLIST)).alias("checklist"),
    )


def python_list_text(arr: Column) -> Column:
    """How a list of strings prints inside a Python format string: ['a', 'b']."""
    return F.concat(F.lit("['"), F.array_join(arr, "', '"), F.lit("']"))


def timeout_outcomes(events: DataFrame, timeout_seconds: int, late_decision: str = "overwrite",
                     decisions: tuple[str, ...] = tuple(DECISIONS)) -> DataFrame:
    """X2/X4 batch twin: what the wait returned and what the store ends with.

    * outcome: the first decision in [created_at, created_at + timeout],
      else ``timed_out`` by ``system-timeout`` at the deadline;
    * final_status: with ``late_decision='overwrite'`` a decision after the
      deadline replaces ``timed_out`` (last write wins); with ``'ignore'``
      it is dropped.
    """
    reqs = requests(events)
    dec = events.where(F.col("event").isin(*decisions)).select("request_id", "event", "actor", "ts", "seq")
    # one row per request joins the decision rows; AQE splits a hot request
    j = dec.join(reqs.select("request_id", "created_at"), "request_id").where(F.col("ts") >= F.col("created_at"))
    deadline = F.col("created_at") + F.make_dt_interval(secs=F.lit(timeout_seconds))
    in_time = F.col("ts") <= deadline
    agg = j.groupBy("request_id").agg(
        F.min(F.when(in_time, F.struct("ts", "seq", "event", "actor"))).alias("first_in_time"),
        F.max(F.struct("ts", "seq", "event")).alias("last"),
    )
    out = reqs.join(agg, "request_id", "left").withColumn("deadline", deadline)
    timed_out = F.col("first_in_time").isNull()
    late_wins = timed_out & F.col("last").isNotNull() & (F.col("last.ts") > F.col("deadline"))
    if late_decision == "overwrite":
        final = F.when(late_wins, F.col("last.event")).when(timed_out, F.lit("timed_out")).otherwise(F.col("last.event"))
    elif late_decision == "ignore":
        final = F.when(timed_out, F.lit("timed_out")).otherwise(F.col("last.event"))
    else:
        raise ValueError("late_decision must be 'overwrite' or 'ignore'")
    return out.select(
        "request_id", "stage", "created_at", "deadline",
        F.coalesce(F.col("first_in_time.event"), F.lit("timed_out")).alias("outcome"),
        F.coalesce(F.col("first_in_time.actor"), F.lit("system-timeout")).alias("outcome_actor"),
        final.alias("final_status"),
    )


def lookup(ids: DataFrame, state: DataFrame) -> DataFrame:
    """point lookups; not-found is a flag column, never an exception."""
    s = state.select("request_id", "status", "stage", F.lit(True).alias("_hit"))
    return ids.join(s, "request_id", "left").select(
        "request_id", "status", "stage", F.coalesce(F.col("_hit"), F.lit(False)).alias("found"))


def auto_approved(state: DataFrame, auto_stages: list[str] | None = None) -> DataFrame:
    """requests whose stage is auto-approved by configuration."""
    stages = auto_stages if auto_stages is not None else K.AUTO_APPROVE_STAGES
    return state.withColumn("auto_approved", F.array_contains(T.str_array(stages) if stages else
                                                              T.empty_str_array(), F.col("stage")))


def validate_decisions(decisions: DataFrame) -> DataFrame:
    """approver 2-128 characters, comment at most 500 → valid flag and
    the first failing rule."""
    a_len, c_len = F.length("actor"), F.length(F.coalesce(F.col("comment"), F.lit("")))
    bad_actor = (a_len < K.ACTOR_MIN_LEN) | (a_len > K.ACTOR_MAX_LEN)
    bad_comment = c_len > K.COMMENT_MAX_LEN
    return decisions.select(
        "seq", "request_id",
        (~bad_actor & ~bad_comment).alias("valid"),
        F.when(bad_actor, F.lit("approver length")).when(bad_comment, F.lit("comment length")).alias("reason"))


def validate_messages(messages: DataFrame) -> DataFrame:
    """a message has 1 to 4000 characters, its responder, if there is
    one, 2 to 128 → valid flag and the first failing rule. ``messages``: key
    columns, ``message``, ``responder``."""
    size, name = F.length(F.coalesce(F.col("message"), F.lit(""))), F.length("responder")
    bad_message = (size < K.MESSAGE_MIN_LEN) | (size > K.MESSAGE_MAX_LEN)
    bad_name = F.coalesce((name < K.ACTOR_MIN_LEN) | (name > K.ACTOR_MAX_LEN), F.lit(False))
    reason = F.when(bad_message, F.lit("message length")).when(bad_name, F.lit("responder length"))
    return messages.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("message", "responder")


def gate_status(plan_stages: DataFrame, state: DataFrame) -> DataFrame:
    """(ticket, stage) ⟕ the latest approval request for it; the gate
    passes only when that request is approved (missing → fails)."""
    latest = state.groupBy("work_item_id", "stage").agg(
        F.max_by("status", F.struct("created_at", "request_id")).alias("approval_status"))
    j = plan_stages.join(latest, (plan_stages["work_item_id"] == latest["work_item_id"]) &
                         (plan_stages["environment"] == latest["stage"]), "left")
    return j.select(plan_stages["work_item_id"], "environment",
                    F.coalesce(F.col("approval_status"), F.lit("missing")).alias("approval_status"),
                    (F.coalesce(F.col("approval_status"), F.lit("")) == "approved").alias("gate_passed"))
