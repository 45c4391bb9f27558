"""Operation logs and status replies.

Log lines are parsed once (``sources.files.parse_log_lines``); metrics are
grouped aggregates with partial aggregation, so a hot operation name is
combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylake.sources.files import kv_get


def operation_metrics(parsed: DataFrame) -> DataFrame:
    """Per operation — runs, total and max duration, max RSS."""
    ops = parsed.where(F.col("event") == "operation_finished").select(
        kv_get(F.col("kv"), "name").alias("name"),
        kv_get(F.col("kv"), "duration_seconds").cast("decimal(18,3)").alias("duration"),
        kv_get(F.col("kv"), "max_rss_kb").cast("bigint").alias("rss"))
    return ops.groupBy("name").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("duration").alias("total_seconds"),
        F.max("duration").alias("max_seconds"), F.max("rss").alias("max_rss_kb"))


def retry_metrics(parsed: DataFrame) -> DataFrame:
    """Per operation — failed attempts and exhausted retries (attempt
    equal to the configured maximum)."""
    att = F.split(kv_get(F.col("kv"), "attempt"), "/")
    r = parsed.where(F.col("event") == "operation_retry_failed").select(
        kv_get(F.col("kv"), "name").alias("name"),
        F.get(att, 0).cast("int").alias("attempt"), F.get(att, 1).cast("int").alias("max_attempts"))
    return r.groupBy("name").agg(F.count(F.lit(1)).alias("failures"),
                                 F.count_if(F.col("attempt") == F.col("max_attempts")).alias("exhausted"))


def status_counts(pending_approvals: DataFrame, pending_clarifications: DataFrame, active: DataFrame) -> DataFrame:
    """The three counts of the status reply in one aggregate (a tagged
    union, no join)."""
    tagged = (pending_approvals.select(F.lit(1).alias("k"))
              .unionByName(pending_clarifications.select(F.lit(2).alias("k")))
              .unionByName(active.select(F.lit(3).alias("k"))))
    return tagged.agg(F.count_if(F.col("k") == 1).alias("pending_approvals"),
                      F.count_if(F.col("k") == 2).alias("pending_clarifications"),
                      F.count_if(F.col("k") == 3).alias("active_items"))
