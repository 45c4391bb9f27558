"""Data-quality checks over landed tables (Q1-Q13).

Every check returns rows of the same shape,
``check, subject, failed, passed, severity``, so stage summaries are a
union plus one aggregate. Row-level rules over one table are evaluated in a
single scan (one ``agg`` with a ``count_if`` per rule); uniqueness is a
grouped count; referential integrity is a left-anti join. Schema checks
count the landed text values that don't fit their declared type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaylake import constants as K

CHECK_SCHEMA = "check string, subject string, failed bigint, passed boolean, severity string"


@dataclass(frozen=True)
class Rule:
    """A row-level rule: ``violation`` is true for a bad row."""
    name: str
    violation: Column
    severity: str = "major"


def not_null(col: str, severity: str = "critical") -> Rule:
    return Rule(f"not_null:{col}", F.col(col).isNull(), severity)


def in_range(col: str, lo, hi, severity: str = "major") -> Rule:
    return Rule(f"range:{col}", F.col(col).isNotNull() & ~F.col(col).between(lo, hi), severity)


def accepted(col: str, values: list, severity: str = "major") -> Rule:
    return Rule(f"accepted:{col}", F.col(col).isNotNull() & ~F.col(col).isin(*values), severity)


def row_rules(df: DataFrame, subject: str, rules: list[Rule]) -> DataFrame:
    """Q4: all row-level rules in one pass, one output row per rule."""
    agg = df.agg(*[F.count_if(r.violation).alias(f"r{i}") for i, r in enumerate(rules)])
    stacked = F.array(*[F.struct(F.lit(r.name).alias("check"), F.col(f"r{i}").alias("failed"),
                                 F.lit(r.severity).alias("severity")) for i, r in enumerate(rules)])
    return agg.select(F.inline(stacked)).select(
        "check", F.lit(subject).alias("subject"), "failed", (F.col("failed") == 0).alias("passed"), "severity")


def unique(df: DataFrame, subject: str, keys: list[str], severity: str = "critical") -> DataFrame:
    """Q4 uniqueness: number of key values that occur more than once."""
    dup = df.groupBy(*keys).count().where(F.col("count") > 1)
    return dup.agg(F.count(F.lit(1)).alias("failed")).select(
        F.lit("unique:" + ",".join(keys)).alias("check"), F.lit(subject).alias("subject"), "failed",
        (F.col("failed") == 0).alias("passed"), F.lit(severity).alias("severity"))


def foreign_key(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, subject: str,
                severity: str = "critical") -> DataFrame:
    """Q4 referential integrity: child rows whose key has no parent.

    Child rows are first counted per key (partial aggregate on the map
    side) and parent keys are de-duplicated, so the join shuffles one row
    per distinct key instead of every child row. An outer join with a
    null test is used rather than an anti-join, which the optimizer would
    push below the count again. The orphan count is the sum of counts."""
    per_key = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_k")) \
        .agg(F.count(F.lit(1)).alias("_n"))
    parents = parent.select(F.col(parent_key).alias("_k")).where(F.col("_k").isNotNull()).distinct() \
        .withColumn("_hit", F.lit(True))
    orphans = per_key.join(parents, "_k", "left").where(F.col("_hit").isNull())
    return orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("failed")).select(
        F.lit(f"fk:{child_key}->{parent_key}").alias("check"), F.lit(subject).alias("subject"), "failed",
        (F.col("failed") == 0).alias("passed"), F.lit(severity).alias("severity"))


def row_count_non_zero(df: DataFrame, subject: str) -> DataFrame:
    """Q2: the table has rows (``failed`` = 1 when empty)."""
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("row_count_non_zero").alias("check"), F.lit(subject).alias("subject"),
        F.when(F.col("n") > 0, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("failed"),
        (F.col("n") > 0).alias("passed"), F.lit("critical").alias("severity"))


def smoke_query(result: DataFrame, subject: str, check: str = "smoke_test_query_success") -> DataFrame:
    """Q5/Q10: a configured aggregate query returns at least one row."""
    return result.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(check).alias("check"), F.lit(subject).alias("subject"),
        F.when(F.col("n") > 0, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("failed"),
        (F.col("n") > 0).alias("passed"), F.lit("critical").alias("severity"))


def row_delta(previous: DataFrame, current: DataFrame, subject: str, threshold: float) -> DataFrame:
    """Q6: |current - previous| / previous <= threshold (counts of two snapshots)."""
    sides = previous.select(F.lit(1).alias("_side")).unionByName(current.select(F.lit(2).alias("_side")))
    s = sides.agg(F.count_if(F.col("_side") == 1).alias("prev"), F.count_if(F.col("_side") == 2).alias("curr"))
    ratio = F.abs(F.col("curr") - F.col("prev")) / F.col("prev")
    return s.select(
        F.lit("row_delta_within_threshold").alias("check"), F.lit(subject).alias("subject"),
        "prev", "curr", F.round(ratio, 6).alias("delta"), (ratio <= threshold).alias("passed"))


def fingerprint_diff(a: DataFrame, b: DataFrame, key: str, subject: str) -> DataFrame:
    """Q7: two versions of a dataset compared by per-key fingerprints
    (count and sums of two independent row hashes, exact): partial aggregates
    on each side, then one join of one row per key, instead of shuffling whole
    rows twice."""
    def fp(df: DataFrame, name: str) -> DataFrame:
        columns = [F.col(c) for c in df.columns]
        total = lambda h: F.sum(h.cast("decimal(38,0)"))
        return df.groupBy(key).agg(F.struct(F.count(F.lit(1)), total(F.xxhash64(*columns)),
                                            total(F.xxhash64(F.lit("second"), *reversed(columns)))).alias(name))
    diff = fp(a, "x").join(fp(b, "y"), key, "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return diff.agg(F.count(F.lit(1)).alias("failed")).select(
        F.lit("regression_suite_passed").alias("check"), F.lit(subject).alias("subject"), "failed",
        (F.col("failed") == 0).alias("passed"), F.lit("critical").alias("severity"))


SPAN = 4096  # width of value spans for percentiles


def performance_baseline(durations: DataFrame, group: str, value: str, baseline: DataFrame,
                         pct: float = 0.95) -> DataFrame:
    """Q8: the exact (interpolated) ``pct`` percentile of durations per group
    against a baseline table (group, max_seconds; one row per group).

    Equal values are counted first, map-side; running totals over a group's
    distinct values, summed in spans of ``SPAN`` values, give the two values
    around the wanted place. No task holds a whole group's rows."""
    counts = durations.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("span", F.floor(F.col("v") / SPAN))
    spans = counts.groupBy(group, "span").agg(F.sum("c").alias("sc"))
    before = Window.partitionBy(group).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(group, "span", F.coalesce(F.sum("sc").over(before), F.lit(0)).alias("below"),
                         F.sum("sc").over(Window.partitionBy(group)).alias("n"))
    inside = Window.partitionBy(group, "span").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(spans, [group, "span"]).withColumn("upto", F.col("below") + F.sum("c").over(inside))
    place = pct * (F.col("n") - 1)
    holds = lambda at: (F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)
    p = placed.groupBy(group).agg(F.max(place).alias("place"), F.max(F.when(holds(F.floor(place)), F.col("v"))).alias("lo"),
                                  F.max(F.when(holds(F.ceil(place)), F.col("v"))).alias("hi"))
    p = p.select(group, (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("place") - F.floor("place"))).alias("p"))
    j = p.join(baseline, group, "left")
    return j.select(group, F.round("p", 3).alias("p_value"), "max_seconds",
                    (F.col("max_seconds").isNotNull() & (F.col("p") <= F.col("max_seconds"))).alias("passed"))


def table_exists(tables: dict[str, DataFrame]) -> DataFrame:
    """Q1: a table exists if its rows can be read, also where it has none (that
    is Q2's check): one count for each. A table that can't be read fails the query."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit("table_exists").alias("check"), F.lit(name).alias("subject"), F.lit(0).cast("long").alias("failed"),
            F.lit(True).alias("passed"), F.lit("critical").alias("severity"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def misfits(df: DataFrame, contract: list[tuple[str, str]]) -> list[tuple[str, str, Column]]:
    """Per column of a contract (name, type): the number of landed text values
    that don't cast to it; of a missing column, all rows."""
    return [(name, kind, F.count_if(F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull()) if name in df.columns else F.count(F.lit(1)))
            for name, kind in contract]


def schema_fit(landed: DataFrame, contract: list[tuple[str, str]], subject: str) -> DataFrame:
    """Q3: landed text against its contract, by values, in one scan: subject,
    name, expected_type, failed, passed."""
    counted = misfits(landed, contract)
    row = landed.agg(*[c.alias(f"c{i}") for i, (_, _, c) in enumerate(counted)])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("expected_type"), F.col(f"c{i}").alias("failed")) for i, (n, t, _) in enumerate(counted)])
    return row.select(F.explode(rows).alias("r")).select(
        F.lit(subject).alias("subject"), "r.name", "r.expected_type", "r.failed", (F.col("r.failed") == 0).alias("passed"))


def alerts_by_window(events: DataFrame, ts: str, kind: str, error_value: str, window: str = "1 day") -> DataFrame:
    """Q12: error events per time window; green when there are none.
    On wall-clock (TIMESTAMP_NTZ) times the windows align to wall-clock
    midnight whatever the session time zone."""
    w = F.window(F.col(ts), window)
    agg = events.groupBy(w.alias("w")).agg(F.count_if(F.col(kind) == error_value).alias("n_errors"),
                                           F.count(F.lit(1)).alias("n_events"))
    return agg.select(F.col("w.start").alias("window_start"), "n_errors", "n_events",
                      (F.col("n_errors") == 0).alias("green"))


def stage_summary(spark: SparkSession, checks: DataFrame, target: str) -> DataFrame:
    """Q13: per stage, run its configured check list; all must pass.

    ``checks`` holds one row per (check name, passed) — several rows for the
    same name (different subjects) must all pass. The stage → checks table
    is fixed configuration (a few rows), broadcast for the join.
    """
    cfg_rows = [(stage, i, c) for stage, names in K.QA_CHECKS.items() for i, c in enumerate(names)]
    cfg = spark.createDataFrame(cfg_rows, "stage string, pos int, check string")
    names = sorted({c for _, _, c in cfg_rows})
    # only configured check names can match, so the grouped side has at most
    # len(names) rows: a proven bound for the broadcast
    per_check = checks.where(F.col("check").isin(*names)).groupBy("check").agg(F.bool_and("passed").alias("ok"))
    j = cfg.join(F.broadcast(per_check), "check", "left")
    agg = j.groupBy("stage").agg(
        F.array_sort(F.collect_list(F.struct("pos", "check", F.coalesce(F.col("ok"), F.lit(False)).alias("ok")))).alias("l"))
    names = F.array_join(F.transform("l", lambda x: x["check"]), ",")
    failed = F.array_join(F.transform(F.filter("l", lambda x: ~x["ok"]), lambda x: x["check"]), ",")
    passed = F.forall("l", lambda x: x["ok"])
    msg = F.when(passed, F.concat(F.lit("QA checks passed in "), F.col("stage"), F.lit(" for " + target + ": "), names)) \
        .otherwise(F.concat(F.lit("QA checks failed in "), F.col("stage"), F.lit(" for " + target + ": "), failed))
    return agg.select("stage", passed.alias("passed"), msg.alias("message"))
