"""Learning history: bounded retention, source ranking, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retained_history(history: DataFrame, limit: int | None = None) -> DataFrame:
    """All records, or with ``limit`` the latest by seq (top-k, each
    partition keeps at most ``limit`` rows before the merge)."""
    return history if limit is None else history.orderBy(F.col("seq").desc()).limit(limit)


def source_rank(history: DataFrame) -> DataFrame:
    """G1/T4: frequency of each source type over the history rows, ranked by
    count desc, ties by first appearance (seq, position in the list).

    The count is a partial aggregate; what is ranked is one array of the
    distinct source types, the few kinds that the plan's keyword rules give.
    """
    exploded = history.select("seq", F.posexplode("source_types").alias("pos", "source_type"))
    agg = exploded.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "pos")).alias("first_seen"))
    ranked = agg.agg(F.array_sort(F.collect_list(
        F.struct((-F.col("n")).alias("order"), "first_seen", "source_type", "n"))).alias("types"))
    return ranked.select(F.posexplode("types").alias("pos", "t")).select(
        "t.source_type", "t.n", (F.col("pos") + 1).alias("rank"))


def append_history(history: DataFrame, new_records: DataFrame, limit: int | None = None) -> DataFrame:
    """Append records (carrying their own increasing ``seq``) and keep all,
    or the last ``limit``. The caller writes the result as a new table version."""
    return retained_history(history.unionByName(new_records.select(*history.columns)), limit)


def learning_feedback(summaries: DataFrame) -> DataFrame:
    """One learning row per run that reached the stage loop (also when
    the repository step failed); skipped, clarification and denied runs
    write nothing."""
    return summaries.where(F.col("reached_stages")).select(
        "work_item_id", "title", F.col("overall_status").alias("status"), "target_table", "source_types")
