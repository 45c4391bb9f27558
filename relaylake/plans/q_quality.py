"""Registered queries: data-quality checks Q1-Q13 on the landed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.operators import hashtree, profiles
from relaylake.operators import quality as Q
from relaylake.plans.sqlviews import with_views
from relaylake.session import scratch_path
from relaylake.sources import views
from relaylake.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}

SNAPSHOT_CUTOFF = "1999-01-01"
DELTA_THRESHOLD = 0.5
PERF_BASELINE = [("dev", 2800.0), ("qe", 2900.0), ("stg", 3000.0), ("prod", 2880.0)]
TARGET = "main.bronze.lineitem"

def lineitem_rules() -> list[Q.Rule]:
    return [
        Q.not_null("l_orderkey"), Q.not_null("l_partkey"), Q.not_null("l_suppkey"), Q.not_null("l_shipdate"),
        Q.in_range("l_quantity", 1, 50), Q.in_range("l_discount", 0.0, 0.1), Q.in_range("l_tax", 0.0, 0.08),
        Q.accepted("l_returnflag", ["A", "N", "R"]), Q.accepted("l_linestatus", ["O", "F"]),
    ]

RULES_SQL = """
SELECT "check", 'lineitem' AS subject, failed, failed = 0 AS passed, severity FROM (
  SELECT unnest([
    {"check": 'not_null:l_orderkey', 'failed': count(*) FILTER (WHERE l_orderkey IS NULL), 'severity': 'critical'},
    {"check": 'not_null:l_partkey', 'failed': count(*) FILTER (WHERE l_partkey IS NULL), 'severity': 'critical'},
    {"check": 'not_null:l_suppkey', 'failed': count(*) FILTER (WHERE l_suppkey IS NULL), 'severity': 'critical'},
    {"check": 'not_null:l_shipdate', 'failed': count(*) FILTER (WHERE l_shipdate IS NULL), 'severity': 'critical'},
    {"check": 'range:l_quantity', 'failed': count(*) FILTER (WHERE l_quantity IS NOT NULL AND NOT l_quantity BETWEEN 1 AND 50), 'severity': 'major'},
    {"check": 'range:l_discount', 'failed': count(*) FILTER (WHERE l_discount IS NOT NULL AND NOT l_discount BETWEEN 0.0 AND 0.1), 'severity': 'major'},
    {"check": 'range:l_tax', 'failed': count(*) FILTER (WHERE l_tax IS NOT NULL AND NOT l_tax BETWEEN 0.0 AND 0.08), 'severity': 'major'},
    {"check": 'accepted:l_returnflag', 'failed': count(*) FILTER (WHERE l_returnflag IS NOT NULL AND l_returnflag NOT IN ('A', 'N', 'R')), 'severity': 'major'},
    {"check": 'accepted:l_linestatus', 'failed': count(*) FILTER (WHERE l_linestatus IS NOT NULL AND l_linestatus NOT IN ('O', 'F')), 'severity': 'major'}
  ], recursive := true) FROM lineitem)
UNION ALL
SELECT 'unique:o_orderkey', 'orders', count(*), count(*) = 0, 'critical' FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL
SELECT 'unique:l_orderkey,l_linenumber', 'lineitem', count(*), count(*) = 0, 'major'
  FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL
SELECT 'fk:l_orderkey->o_orderkey', 'lineitem', count(*), count(*) = 0, 'critical'
  FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL))
UNION ALL
SELECT 'fk:o_custkey->c_custkey', 'orders', count(*), count(*) = 0, 'critical'
  FROM (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL))
"""


def dq_rule_rows(spark: SparkSession, sf: str) -> DataFrame:
    li, o, c = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "customer")
    return (Q.row_rules(li, "lineitem", lineitem_rules())
            .unionByName(Q.unique(o, "orders", ["o_orderkey"]))
            .unionByName(Q.unique(li, "lineitem", ["l_orderkey", "l_linenumber"], "major"))
            .unionByName(Q.foreign_key(li, "l_orderkey", o, "o_orderkey", "lineitem"))
            .unionByName(Q.foreign_key(o, "o_custkey", c, "c_custkey", "orders")))


def q_dq_rules(spark, sf):
    return dq_rule_rows(spark, sf)


QUERIES["dq_rules"] = q_dq_rules
ORACLE["dq_rules"] = RULES_SQL


def q_dq_critical(spark, sf):
    """Q11: the critical subset."""
    return dq_rule_rows(spark, sf).where(F.col("severity") == "critical")


QUERIES["dq_critical"] = q_dq_critical
ORACLE["dq_critical"] = f"SELECT * FROM ({RULES_SQL}) WHERE severity = 'critical'"


def q_dq_fk(spark, sf):
    li, o, c = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "customer")
    return Q.foreign_key(li, "l_orderkey", o, "o_orderkey", "lineitem").unionByName(
        Q.foreign_key(o, "o_custkey", c, "c_custkey", "orders"))


QUERIES["dq_fk"] = q_dq_fk
ORACLE["dq_fk"] = f"""SELECT * FROM ({RULES_SQL}) WHERE "check" LIKE 'fk:%'"""


def q_dq_row_delta(spark, sf):
    o = table(spark, sf, "orders")
    prev = o.where(F.col("o_orderdate") < F.lit(SNAPSHOT_CUTOFF).cast("timestamp_ntz"))
    return Q.row_delta(prev, o, "orders", DELTA_THRESHOLD)


QUERIES["dq_row_delta"] = q_dq_row_delta
ORACLE["dq_row_delta"] = f"""
SELECT 'row_delta_within_threshold' AS "check", 'orders' AS subject, prev, curr, round(abs(curr - prev) / prev, 6) AS delta,
  abs(curr - prev) / prev <= {DELTA_THRESHOLD} AS passed
FROM (SELECT count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{SNAPSHOT_CUTOFF}') AS prev, count(*) AS curr FROM orders)"""


ORDERS_CONTRACT = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                   ("o_totalprice", "decimal(12,2)"), ("o_orderdate", "date"), ("o_comment", "string")]


def orders_text(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as they land, all text: since the snapshot some prices carry a
    currency; some dates never were given."""
    o = table(spark, sf, "orders")
    key, later = F.col("o_orderkey"), F.col("o_orderdate") >= F.lit(SNAPSHOT_CUTOFF).cast("timestamp_ntz")
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    return o.select(
        later.alias("later"), key.cast("string").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus",
        F.when(later & (key % 13 == 0), F.concat(price, F.lit(" EUR"))).otherwise(price).alias("o_totalprice"),
        F.when(key % 19 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("o_orderdate"))


def q_dq_schema(spark, sf):
    """Q3: landed orders against their contract: values that don't fit the
    declared type, per column."""
    return Q.schema_fit(orders_text(spark, sf), ORDERS_CONTRACT, "orders")


PRICE_BAD = f"o_orderdate >= TIMESTAMP '{SNAPSHOT_CUTOFF}' AND o_orderkey % 13 = 0 AND o_totalprice IS NOT NULL"
QUERIES["dq_schema"] = q_dq_schema
ORACLE["dq_schema"] = f"""SELECT 'orders' AS subject, name, expected_type, failed, failed = 0 AS passed FROM (
  SELECT 'o_orderkey' AS name, 'bigint' AS expected_type, CAST(0 AS BIGINT) AS failed UNION ALL SELECT 'o_custkey', 'bigint', 0
  UNION ALL SELECT 'o_orderstatus', 'string', 0
  UNION ALL SELECT 'o_totalprice', 'decimal(12,2)', count(*) FILTER (WHERE {PRICE_BAD}) FROM orders
  UNION ALL SELECT 'o_orderdate', 'date', count(*) FILTER (WHERE o_orderkey % 19 = 0) FROM orders
  UNION ALL SELECT 'o_comment', 'string', count(*) FROM orders)"""


def orders_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as three landings, columns as text: from the second on prices
    carry a currency and a channel is given; the third has no customer, and
    keys with a prefix."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    version = sum((F.when(F.col("o_orderdate") >= F.lit(d).cast("timestamp_ntz"), 1).otherwise(0) for d in LANDINGS), F.lit(1))
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    cell = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    cells = F.array(
        cell("o_orderkey", F.when(F.col("version") < 3, key.cast("string")).otherwise(F.concat(F.lit("O-"), key.cast("string")))),
        F.when(F.col("version") < 3, cell("o_custkey", F.col("o_custkey").cast("string"))),
        cell("o_totalprice", F.when((F.col("version") > 1) & (key % 13 == 0), F.concat(price, F.lit(" EUR"))).otherwise(price)),
        cell("o_orderdate", F.when(key % 19 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))),
        F.when(F.col("version") > 1, cell("o_channel", F.lit("web"))))
    return o.withColumn("version", version).select("version", F.map_from_entries(F.array_compact(cells)).alias("values"))


def q_dq_schema_drift(spark, sf):
    """Q9: columns added, removed or of another inferred type, landing by landing."""
    return profiles.drift(profiles.column_profiles(orders_versions(spark, sf)))


LANDINGS = ["1997-01-01", "1999-01-01"]
_VERSION = "1 + " + " + ".join(f"CAST(o_orderdate >= TIMESTAMP '{d}' AS INTEGER)" for d in LANDINGS)
QUERIES["dq_schema_drift"] = q_dq_schema_drift
ORACLE["dq_schema_drift"] = f"""
WITH o AS (SELECT *, {_VERSION} AS version, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS price FROM orders),
cells AS (SELECT version, 'o_orderkey' AS name, CASE WHEN version < 3 THEN CAST(o_orderkey AS VARCHAR) ELSE 'O-' || o_orderkey END AS value FROM o
  UNION ALL SELECT version, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM o WHERE version < 3
  UNION ALL SELECT version, 'o_totalprice', CASE WHEN version > 1 AND o_orderkey % 13 = 0 THEN price || ' EUR' ELSE price END FROM o
  UNION ALL SELECT version, 'o_orderdate', CASE WHEN o_orderkey % 19 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END FROM o
  UNION ALL SELECT version, 'o_channel', 'web' FROM o WHERE version > 1),
typed AS (SELECT version, name, CASE WHEN count(value) = 0 THEN 'void' WHEN bool_and(TRY_CAST(value AS BIGINT) IS NOT NULL AND NOT contains(value, '.')) THEN 'bigint'
  WHEN bool_and(TRY_CAST(value AS DECIMAL(18,2)) IS NOT NULL) THEN 'decimal' WHEN bool_and(TRY_CAST(value AS DATE) IS NOT NULL) THEN 'date' ELSE 'string' END AS type
  FROM cells WHERE value IS NOT NULL GROUP BY ALL),
pairs AS (SELECT coalesce(b.version, a.version + 1) AS version, coalesce(a.name, b.name) AS name, a.type AS type_before, b.type AS type_after
  FROM (SELECT * FROM typed WHERE version < 3) a FULL JOIN (SELECT * FROM typed WHERE version > 1) b ON b.version = a.version + 1 AND a.name = b.name)
SELECT CAST(version AS INTEGER) AS version, name, CASE WHEN type_before IS NULL THEN 'added' WHEN type_after IS NULL THEN 'removed' ELSE 'retyped' END AS change,
  type_before, type_after FROM pairs WHERE type_before IS DISTINCT FROM type_after"""


def later_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """A later version of the table: returned lines of small quantity were
    written again without their discount, last lines are gone."""
    li = table(spark, sf, "lineitem")
    again = (F.col("l_returnflag") == "R") & (F.col("l_quantity") <= 2)
    return li.where(F.col("l_linenumber") < 7).withColumn("l_discount", F.when(again, F.lit(0).cast(li.schema["l_discount"].dataType))
                                                          .otherwise(F.col("l_discount")))


def q_dq_regression(spark, sf):
    """Q7: the rows in which two versions of the table differ, found by their
    trees of hash ranges."""
    base = scratch_path(spark, f"relaylake-versions/lineitem-{uuid.uuid4().hex[:12]}")
    for name, version in (("before", table(spark, sf, "lineitem")), ("after", later_lineitem(spark, sf))):
        hashtree.write_tree(version, f"{base}/{name}", ["l_orderkey"])
    return hashtree.changed_rows(spark, f"{base}/before", f"{base}/after", table(spark, sf, "lineitem").schema).select(
        "l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("l_discount"), "change", F.col("copies").cast("long").alias("copies"))


def q_dq_regression_check(spark, sf):
    """Q7 as a check row: in how many orders the versions differ."""
    return Q.fingerprint_diff(table(spark, sf, "lineitem"), later_lineitem(spark, sf), "l_orderkey", "lineitem")


QUERIES["dq_regression"] = q_dq_regression
QUERIES["dq_regression_check"] = q_dq_regression_check
LATER_SQL = """SELECT * REPLACE (CASE WHEN l_returnflag = 'R' AND l_quantity <= 2 THEN 0 ELSE l_discount END AS l_discount)
  FROM lineitem WHERE l_linenumber < 7"""
ORACLE["dq_regression_check"] = f"""WITH later AS ({LATER_SQL})
SELECT 'regression_suite_passed' AS "check", 'lineitem' AS subject, count(DISTINCT l_orderkey) AS failed, count(*) = 0 AS passed, 'critical' AS severity
FROM ((SELECT * FROM lineitem EXCEPT ALL SELECT * FROM later) UNION ALL (SELECT * FROM later EXCEPT ALL SELECT * FROM lineitem))"""
ORACLE["dq_regression"] = f"""WITH later AS ({LATER_SQL}),
gone AS (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM later), new AS (SELECT * FROM later EXCEPT ALL SELECT * FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) AS l_discount, change, CAST(copies AS BIGINT) AS copies FROM (
  SELECT COLUMNS(*), 'removed' AS change, count(*) AS copies FROM gone GROUP BY ALL
  UNION ALL SELECT COLUMNS(*), 'added', count(*) FROM new GROUP BY ALL)"""


def q_dq_perf(spark, sf):
    """Q8: p95 of stage durations per environment against a baseline."""
    base = spark.createDataFrame(PERF_BASELINE, "environment string, max_seconds double")
    return Q.performance_baseline(views.stage_runs(spark, sf), "environment", "duration_s", base)


QUERIES["dq_perf"] = q_dq_perf
ORACLE["dq_perf"] = with_views(["stage_runs"], """
SELECT s.environment, round(p, 3) AS p_value, b.max_seconds, b.max_seconds IS NOT NULL AND p <= b.max_seconds AS passed
FROM (SELECT environment, quantile_cont(duration_s, 0.95) AS p FROM stage_runs GROUP BY environment) s
LEFT JOIN (VALUES ('dev', 2800.0), ('qe', 2900.0), ('stg', 3000.0), ('prod', 2880.0)) b(environment, max_seconds)
  USING (environment)""".replace("2800.0)", "CAST(2800.0 AS DOUBLE))").replace("2900.0)", "CAST(2900.0 AS DOUBLE))")
    .replace("3000.0)", "CAST(3000.0 AS DOUBLE))").replace("2880.0)", "CAST(2880.0 AS DOUBLE))"))


def q_dq_alerts(spark, sf):
    """Q12: error events per day; a day is green without errors."""
    return Q.alerts_by_window(table(spark, sf, "events"), "ts", "event_type", "error", "1 day")


QUERIES["dq_alerts"] = q_dq_alerts
ORACLE["dq_alerts"] = """
SELECT date_trunc('day', ts) AS window_start, count(*) FILTER (WHERE event_type = 'error') AS n_errors,
  count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') = 0 AS green
FROM events GROUP BY 1"""


def smoke_result(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("qty"))


def q_dq_smoke(spark, sf):
    r = smoke_result(spark, sf)
    return Q.smoke_query(r, "lineitem").unionByName(Q.smoke_query(r, TARGET, "post_deploy_smoke_passed"))


QUERIES["dq_smoke"] = q_dq_smoke
ORACLE["dq_smoke"] = f"""
SELECT 'smoke_test_query_success' AS "check", 'lineitem' AS subject, CAST(CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS BIGINT) AS failed,
  count(*) > 0 AS passed, 'critical' AS severity FROM (SELECT l_returnflag FROM lineitem GROUP BY 1)
UNION ALL
SELECT 'post_deploy_smoke_passed', '{TARGET}', CAST(CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS BIGINT), count(*) > 0, 'critical'
  FROM (SELECT l_returnflag FROM lineitem GROUP BY 1)"""


def all_check_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows named after the twelve stage checks."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    rules = dq_rule_rows(spark, sf)
    named = [
        Q.table_exists({"lineitem": li}).drop("n_rows"),
        Q.row_count_non_zero(li, "lineitem"),
        q_dq_schema(spark, sf).select(F.lit("schema_validation").alias("check"), F.col("name").alias("subject"), "failed", "passed",
                                      F.lit("critical").alias("severity")),
        rules.withColumn("check", F.lit("dq_rules_passed")),
        rules.where(F.col("severity") == "critical").withColumn("check", F.lit("critical_dq_rules_passed")),
        q_dq_smoke(spark, sf),
        q_dq_row_delta(spark, sf).select("check", "subject", F.when(F.col("passed"), 0).otherwise(1).cast("bigint").alias("failed"),
                                         "passed", F.lit("major").alias("severity")),
        q_dq_regression_check(spark, sf),
        q_dq_perf(spark, sf).select(F.lit("performance_baseline_passed").alias("check"), F.col("environment").alias("subject"),
                                    F.when(F.col("passed"), 0).otherwise(1).cast("bigint").alias("failed"), "passed",
                                    F.lit("major").alias("severity")),
        q_dq_schema_drift(spark, sf).agg(F.count(F.lit(1)).alias("failed")).select(
            F.lit("schema_drift_absent").alias("check"), F.lit("orders").alias("subject"), "failed",
            (F.col("failed") == 0).alias("passed"), F.lit("major").alias("severity")),
        q_dq_alerts(spark, sf).select(F.lit("monitoring_alerts_green").alias("check"),
                                      F.col("window_start").cast("string").alias("subject"),
                                      F.col("n_errors").alias("failed"), F.col("green").alias("passed"),
                                      F.lit("major").alias("severity")),
    ]
    out = named[0]
    for d in named[1:]:
        out = out.unionByName(d)
    return out


def q_dq_stage_summary(spark, sf):
    """Q13: per stage, all configured checks must pass."""
    return Q.stage_summary(spark, all_check_rows(spark, sf), TARGET)


def _stage_summary_sql() -> str:
    status = {
        "table_exists": "(SELECT count(*) > 0 FROM lineitem)", "row_count_non_zero": "(SELECT count(*) > 0 FROM lineitem)",
        "schema_validation": f"(SELECT bool_and(passed) FROM ({ORACLE['dq_schema']}))",
        "dq_rules_passed": f"(SELECT bool_and(passed) FROM ({RULES_SQL}))",
        "critical_dq_rules_passed": f"(SELECT bool_and(passed) FROM ({RULES_SQL}) WHERE severity = 'critical')",
        "smoke_test_query_success": "(SELECT count(*) > 0 FROM (SELECT l_returnflag FROM lineitem GROUP BY 1))",
        "post_deploy_smoke_passed": "(SELECT count(*) > 0 FROM (SELECT l_returnflag FROM lineitem GROUP BY 1))",
        "row_delta_within_threshold": f"(SELECT passed FROM ({ORACLE['dq_row_delta']}))",
        "regression_suite_passed": f"(SELECT passed FROM ({ORACLE['dq_regression_check']}))",
        "performance_baseline_passed": f"(SELECT bool_and(passed) FROM ({ORACLE['dq_perf']}))",
        "schema_drift_absent": f"(SELECT count(*) = 0 FROM ({ORACLE['dq_schema_drift']}))",
        "monitoring_alerts_green": f"(SELECT bool_and(green) FROM ({ORACLE['dq_alerts']}))",
    }
    ctes = ", ".join(f"{n} AS (SELECT {v} AS ok)" for n, v in status.items())
    rows = []
    for stage, checks in K.QA_CHECKS.items():
        ok = " AND ".join(f"(SELECT ok FROM {c})" for c in checks)
        failed = " || ".join(
            f"CASE WHEN (SELECT ok FROM {c}) THEN '' ELSE '{c},' END" for c in checks)
        rows.append(f"SELECT '{stage}' AS stage, {ok} AS passed, CASE WHEN {ok} THEN 'QA checks passed in {stage} for {TARGET}: "
                    f"{','.join(checks)}' ELSE 'QA checks failed in {stage} for {TARGET}: ' || rtrim({failed}, ',') END AS message")
    # stage_runs view is not needed for dq_perf's inner text; it is a with_views statement itself
    return f"WITH {ctes} " + " UNION ALL ".join(rows)


QUERIES["dq_stage_summary"] = q_dq_stage_summary
ORACLE["dq_stage_summary"] = _stage_summary_sql()
