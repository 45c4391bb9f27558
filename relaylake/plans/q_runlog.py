"""Registered queries: log metrics and status replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import templates as TPL
from relaylake.functions import text as T
from relaylake.operators import approvals as A
from relaylake.operators import clarify as C
from relaylake.operators import runlog as RL
from relaylake.plans import q_approvals, q_clarify, q_intake
from relaylake.plans.sqlviews import with_views
from relaylake.sources import files, views
from relaylake.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}

LOG_RE = r"^(\S+) \| (\w+) \| ([^|]+?) \| (\S+)(.*)$"


def parsed_logs(spark, sf):
    return files.parse_log_lines(views.log_lines(spark, sf))


def _kv_sql(key: str) -> str:
    return f"regexp_extract(regexp_extract(value, '{LOG_RE}', 5), '{key}=(\\S+)', 1)"


def q_log_metrics(spark, sf):
    return RL.operation_metrics(parsed_logs(spark, sf))


QUERIES["log_metrics"] = q_log_metrics
ORACLE["log_metrics"] = with_views(["log_lines"], f"""
SELECT name, count(*) AS runs, CAST(sum(d) AS DECIMAL(28, 3)) AS total_seconds, max(d) AS max_seconds, max(rss) AS max_rss_kb FROM (
  SELECT {_kv_sql('name')} AS name, CAST({_kv_sql('duration_seconds')} AS DECIMAL(18, 3)) AS d,
         CAST({_kv_sql('max_rss_kb')} AS BIGINT) AS rss
  FROM log_lines WHERE regexp_extract(value, '{LOG_RE}', 4) = 'operation_finished') GROUP BY name""")


def q_retry_metrics(spark, sf):
    return RL.retry_metrics(parsed_logs(spark, sf))


QUERIES["retry_metrics"] = q_retry_metrics
ORACLE["retry_metrics"] = with_views(["log_lines"], f"""
SELECT name, count(*) AS failures, count(*) FILTER (WHERE a = m) AS exhausted FROM (
  SELECT {_kv_sql('name')} AS name, CAST(split_part({_kv_sql('attempt')}, '/', 1) AS INTEGER) AS a,
         CAST(split_part({_kv_sql('attempt')}, '/', 2) AS INTEGER) AS m
  FROM log_lines WHERE regexp_extract(value, '{LOG_RE}', 4) = 'operation_retry_failed') GROUP BY name""")


def counts(spark, sf):
    pa = A.pending(q_approvals.state(spark, sf))
    pc = C.requests(q_clarify.pairs(spark, sf)).where(F.col("status") == "pending")
    return RL.status_counts(pa, pc, q_intake.open_tickets(spark, sf))


def q_counts_reply(spark, sf):
    """Pending approvals, pending clarifications, active tickets."""
    return counts(spark, sf)


COUNTS_SQL = """SELECT (SELECT count(*) FROM state WHERE status = 'pending') AS pending_approvals,
  (SELECT count(*) FROM creq WHERE status = 'pending') AS pending_clarifications,
  (SELECT count(*) FROM tickets WHERE item_type IN ('Product Backlog Item', 'Bug', 'User Story')
     AND state <> 'Closed') AS active_items"""

QUERIES["counts_reply"] = q_counts_reply
ORACLE["counts_reply"] = with_views(["approval_events", "tickets"], COUNTS_SQL,
                                    extra=q_approvals.STATE_CTES + q_clarify.PAIR_CTES)


COUNT_COLUMNS = ("pending_approvals", "pending_clarifications", "active_items")


def q_chat_reply(spark, sf):
    """A reply per user message with the three counts.

    The counts are one aggregate row, broadcast to the messages."""
    c = counts(spark, sf).select(*[F.col(k).cast("string").alias(k) for k in COUNT_COLUMNS])
    msgs = table(spark, sf, "conversations").where(F.col("role") == "user").join(F.broadcast(c))
    message = T.strip(F.col("text"))
    fb = F.concat(F.lit("I can help with workflow control. Pending approvals="), F.col("pending_approvals"),
                  F.lit(", pending clarifications="), F.col("pending_clarifications"),
                  F.lit(", active items="), F.col("active_items"), F.lit(". Request received: "), message)
    text = TPL.render(TPL.literal("hil_chat_response"), {
        "message": message, "context": F.lit("{}"),
        **{k: F.col(k) for k in COUNT_COLUMNS},
    }, fb)
    return msgs.select("conv_id", "turn", F.sha2(text, 256).alias("reply_sha256"))


def _render_sql(name: str, fields: list[tuple[str, str]]) -> str:
    out = "'" + K.TEMPLATES[name].replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for k, v in fields:
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
QUERIES["chat_reply"] = q_chat_reply
ORACLE["chat_reply"] = with_views(["approval_events", "tickets"], "SELECT conv_id, turn, sha256(" + _render_sql(
    "hil_chat_response", [("context", "'{}'"), ("pending_approvals", "CAST(c.pending_approvals AS VARCHAR)"),
                          ("pending_clarifications", "CAST(c.pending_clarifications AS VARCHAR)"),
                          ("active_items", "CAST(c.active_items AS VARCHAR)"), ("message", f"trim(text, {WS})")])
    + ") AS reply_sha256 FROM conversations, counts c WHERE role = 'user'",
    extra=q_approvals.STATE_CTES + q_clarify.PAIR_CTES + [("counts", COUNTS_SQL)])
