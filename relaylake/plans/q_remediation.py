"""Registered queries: remediation batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import templates as TPL
from relaylake.operators import planning
from relaylake.operators import remediation as R
from relaylake.plans.q_intake import tickets
from relaylake.plans.sqlviews import with_views
from relaylake.sources import views

QUERIES: dict = {}
ORACLE: dict = {}

OK_SQL = "('succeeded', 'success', 'completed')"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Pipeline runs with their log bodies, joined to the ticket's plan (1:1)."""
    fl = views.failure_logs(spark, sf)
    p = planning.with_plan(tickets(spark, sf)).select(
        "work_item_id", F.col("target_repo").alias("repo"), "target_catalog", "target_schema", "target_table",
        "ingestion_mode")
    return fl.join(p, "work_item_id")


def _hint_sql(col: str, hints: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{h}')" for h in hints) + ")"


RUN_CTES = [
    ("runs", """SELECT f.*, p.target_repo AS repo, p.target_catalog, p.target_schema, p.target_table, p.ingestion_mode
      FROM failure_logs f JOIN plans p ON p.work_item_id = f.work_item_id"""),
    ("ctx", f"""SELECT *, CASE WHEN lower(status) IN {OK_SQL} THEN ''
        WHEN coalesce(logs_url, '') = '' THEN 'No logs URL available for failed run_id=' || CAST(run_id AS VARCHAR) || '.'
        ELSE coalesce(log_body, '') END AS failure_context FROM runs"""),
    ("lab", f"""SELECT *, {_hint_sql('failure_context', K.NOTEBOOK_HINTS)} AS notebook_hint,
        {_hint_sql('failure_context', K.SQL_HINTS)} AS sql_hint, {_hint_sql('failure_context', K.ETL_HINTS)} AS etl_hint FROM ctx"""),
    ("failed", f"SELECT * FROM lab WHERE lower(status) NOT IN {OK_SQL}"),
]


def q_failure_labels(spark, sf):
    r = runs(spark, sf)
    r = R.with_labels(r.withColumn("failure_context", R.failure_context(
        F.col("status"), F.col("logs_url"), F.col("log_body"), F.col("run_id"))))
    return r.select("run_id", F.length("failure_context").alias("context_chars"), "notebook_hint", "sql_hint", "etl_hint")


QUERIES["failure_labels"] = q_failure_labels
ORACLE["failure_labels"] = with_views(["failure_logs", "plans"], """SELECT run_id, CAST(length(failure_context) AS INTEGER) AS context_chars,
  notebook_hint, sql_hint, etl_hint FROM lab""", extra=RUN_CTES)


def q_render_remediation(spark, sf):
    """Remediation suggestion per failed run (first attempt)."""
    r = runs(spark, sf).withColumn("failure_context", R.failure_context(
        F.col("status"), F.col("logs_url"), F.col("log_body"), F.col("run_id")))
    r = r.where(~F.lower("status").isin(*K.PROMOTABLE_STATUSES))
    full = F.concat_ws(".", "target_catalog", "target_schema", "target_table")
    text = TPL.render(TPL.literal("failure_remediation"), {
        "environment": F.col("environment"), "attempt": F.lit(1), "target_table": full, "repo": F.col("repo"),
        "ingestion_mode": F.col("ingestion_mode"), "failure_context": F.col("failure_context"),
    }, F.lit("fallback"))
    return r.select("run_id", F.sha2(text, 256).alias("suggestion_sha256"), F.length(text).alias("suggestion_chars"))


def _render_sql(name: str, fields: list[tuple[str, str]]) -> str:
    out = "'" + K.TEMPLATES[name].replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for k, v in fields:
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


REM_TEXT_SQL = _render_sql("failure_remediation", [
    ("environment", "environment"), ("attempt", "'1'"),
    ("target_table", "target_catalog || '.' || target_schema || '.' || target_table"), ("repo", "repo"),
    ("ingestion_mode", "ingestion_mode"), ("failure_context", "failure_context")])

QUERIES["render_remediation"] = q_render_remediation
ORACLE["render_remediation"] = with_views(["failure_logs", "plans"], f"""SELECT run_id, sha256({REM_TEXT_SQL}) AS suggestion_sha256,
  CAST(length({REM_TEXT_SQL}) AS INTEGER) AS suggestion_chars FROM failed""", extra=RUN_CTES)


# ---- file candidates -----------------------------------------------------------
def files(spark, sf):
    return views.source_files(spark, sf)


def q_path_filter(spark, sf):
    f = files(spark, sf)
    return f.select("repo", "path", R.etl_candidate(F.col("path")).alias("etl_candidate"))


ETL_CAND_SQL = ("(ends_with(path, '.py') AND NOT list_has_any(string_split(lower(path), '/'), ['tests', 'generated_changes', 'transformers']) "
                "AND list_has_any(string_split(lower(path), '/'), ['etl', 'pipelines', 'jobs', 'notebooks']))")

QUERIES["path_filter"] = q_path_filter
ORACLE["path_filter"] = with_views(["source_files"], f"SELECT repo, path, {ETL_CAND_SQL} AS etl_candidate FROM source_files")


def q_patched_guard(spark, sf):
    """files that already carry the fix (notebook setting / SQL bootstrap)."""
    f = files(spark, sf)
    return f.select("repo", "path", F.col("content").contains(K.NOTEBOOK_CONF_LINE).alias("notebook_configured"),
                    R.has_bootstrap(F.col("content"), F.lit(K.DEFAULT_SCHEMA)).alias("sql_bootstrapped"))


QUERIES["patched_guard"] = q_patched_guard
ORACLE["patched_guard"] = with_views(["source_files"], f"""SELECT repo, path, contains(content, '{K.NOTEBOOK_CONF_LINE}') AS notebook_configured,
  contains(lower(content), 'create schema if not exists') AND contains(lower(content), 'bronze') AS sql_bootstrapped FROM source_files""")


def q_file_union_dedupe(spark, sf):
    """All notebook files, each with the pattern that found it first."""
    c = R.notebook_candidates(files(spark, sf))
    return c.select("repo", "path", "pattern_rank")


NB_CAND_SQL = """SELECT * FROM (
    SELECT *, CASE WHEN starts_with(path, 'notebooks/') AND ends_with(path, '.py') THEN 0
                   WHEN string_split(path, '/')[-1] LIKE '%notebook%.py' THEN 1 END AS pattern_rank FROM source_files)
    WHERE pattern_rank IS NOT NULL"""

QUERIES["file_union_dedupe"] = q_file_union_dedupe
ORACLE["file_union_dedupe"] = with_views(["source_files"], f"SELECT repo, path, pattern_rank FROM ({NB_CAND_SQL})")


# ---- W5 ----------------------------------------------------------------------
NOTEBOOK_LIMIT, ETL_LIMIT, SQL_LIMIT = 10, 30, 5  # fixed values: files of a repository that a remediation looks at


def q_candidate_limits(spark, sf):
    """The files that a remediation with limits looks at, by repository and
    kind, and the SQL file it would patch for each target."""
    f = files(spark, sf)
    notebooks = R.notebook_candidates(f, NOTEBOOK_LIMIT).select("repo", F.lit("notebook").alias("kind"), F.lit("").alias("target"), "path")
    etl = R.etl_candidates(f, ETL_LIMIT).select("repo", F.lit("etl").alias("kind"), F.lit("").alias("target"), "path")
    sql_files = f.where(F.col("path").endswith(".sql"))
    plans = planning.with_plan(tickets(spark, sf)).select(F.col("target_repo").alias("repo"), "target_schema", "target_table")
    targets = R.sql_targets(sql_files, plans, SQL_LIMIT)
    named = F.concat_ws(".", "target_schema", "target_table")
    return notebooks.unionByName(etl).unionByName(targets.select("repo", F.lit("sql").alias("kind"), named.alias("target"), "path"))


QUERIES["candidate_limits"] = q_candidate_limits
ORACLE["candidate_limits"] = with_views(["source_files", "plans"], f"""
SELECT repo, 'notebook' AS kind, '' AS target, path FROM ({NB_CAND_SQL})
  QUALIFY row_number() OVER (PARTITION BY repo ORDER BY pattern_rank, path) <= 10
UNION ALL
SELECT repo, 'etl', '', path FROM source_files WHERE ends_with(path, '.py')
    AND len(list_intersect(string_split(lower(path), '/'), ['tests', 'generated_changes', 'transformers'])) = 0
    AND len(list_intersect(string_split(lower(path), '/'), ['etl', 'pipelines', 'jobs', 'notebooks'])) > 0
  QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 30
UNION ALL
SELECT k.repo, 'sql', k.target_schema || '.' || k.target_table,
  CASE WHEN bool_or(looked.path IS NOT NULL) THEN min(CASE WHEN NOT (looked.creates AND looked.names) THEN looked.path END) ELSE any_value(f.first_path) END
FROM (SELECT DISTINCT target_repo AS repo, target_schema, target_table FROM plans) k
LEFT JOIN (SELECT repo, min(path) AS first_path FROM source_files WHERE ends_with(path, '.sql') GROUP BY repo) f USING (repo)
LEFT JOIN (
  SELECT p.repo, p.target_schema, p.target_table, s.path, contains(lower(s.content), 'create schema if not exists') AS creates,
    contains(lower(s.content), lower(p.target_schema)) AS names
  FROM (SELECT DISTINCT target_repo AS repo, target_schema, target_table FROM plans) p
  JOIN source_files s ON s.repo = p.repo AND ends_with(s.path, '.sql')
    AND (contains(lower(s.content), lower(p.target_table)) OR contains(lower(s.content), lower(p.target_schema)))
  QUALIFY row_number() OVER (PARTITION BY p.repo, p.target_schema, p.target_table ORDER BY s.path) <= 5) looked USING (repo, target_schema, target_table)
GROUP BY k.repo, k.target_schema, k.target_table""")


# ---- U2 ----------------------------------------------------------------------
def q_notebook_patch(spark, sf):
    c = R.notebook_candidates(files(spark, sf))
    p = c.withColumn("patched", R.notebook_patch(F.col("content"))).where(F.col("patched") != F.col("content"))
    return p.select("repo", "path", F.sha2("patched", 256).alias("patched_sha256"), F.length("patched").alias("patched_chars"))


SNIPPET_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in ["", K.NOTEBOOK_MARKER] + K.NOTEBOOK_BOOTSTRAP + [K.NOTEBOOK_CONF_LINE]) + "]"
NB_PATCH_SQL = f"""
SELECT repo, path, content, lines, n, header_end,
  coalesce(list_max(list_filter(generate_series(header_end, greatest(n - 1, header_end)),
    lambda i: i < stop_at AND i < n AND (starts_with(trim(lines[i + 1]), 'import ') OR starts_with(trim(lines[i + 1]), 'from '))
  )) + 1, header_end) AS insert_at
FROM (
  SELECT *, coalesce(list_min(list_filter(generate_series(header_end, greatest(n - 1, header_end)),
    lambda i: i < n AND trim(lines[i + 1]) <> '' AND NOT (starts_with(trim(lines[i + 1]), 'import ') OR starts_with(trim(lines[i + 1]), 'from ')))), n) AS stop_at
  FROM (
    SELECT *, sb + CASE WHEN n > sb AND regexp_matches(lines[sb + 1], '^[ \\t]*#.*coding[:=][ \\t]*[-\\w.]+') THEN 1 ELSE 0 END AS header_end
    FROM (SELECT *, len(lines) AS n, CASE WHEN len(lines) > 0 AND starts_with(lines[1], '#!') THEN 1 ELSE 0 END AS sb
          FROM (SELECT *, CASE WHEN ends_with(content, chr(10)) THEN string_split(content, chr(10))[1:-2]
                               ELSE string_split(content, chr(10)) END AS lines FROM ({NB_CAND_SQL})))))"""

QUERIES["notebook_patch"] = q_notebook_patch
ORACLE["notebook_patch"] = with_views(["source_files"], f"""
SELECT repo, path, sha256(patched) AS patched_sha256, CAST(length(patched) AS INTEGER) AS patched_chars FROM (
  SELECT repo, path, array_to_string(list_concat(lines[1:insert_at], {SNIPPET_SQL},
      CASE WHEN n > 0 AND trim(lines[n]) <> '' THEN [''] ELSE [] END, lines[insert_at + 1:]), chr(10))
    || CASE WHEN ends_with(content, chr(10)) THEN chr(10) ELSE '' END AS patched
  FROM ({NB_PATCH_SQL}) WHERE NOT contains(content, '{K.NOTEBOOK_CONF_LINE}'))""")


# ---- U3 ----------------------------------------------------------------------
def q_etl_patch(spark, sf):
    c = R.etl_candidates(files(spark, sf))
    p = c.withColumn("patched", R.etl_patch(F.col("content"))).where(F.col("patched") != F.col("content"))
    return p.select("repo", "path", F.sha2("patched", 256).alias("patched_sha256"))


QUERIES["etl_patch"] = q_etl_patch
# DuckDB's patterns have no lookahead: the text is cut at every ``.mode(...)``
# call; the first part after one that doesn't start with the option gets it.
MODE_CALL = r"""\.mode\(\s*"(?:append|overwrite)"\s*\)\s*"""
ETL_SQL = f"""SELECT repo, path, content, parts, calls, list_position(list_transform(parts[2:], lambda p:
      NOT regexp_matches(p, '^\\.\\s*option\\(\\s*"mergeSchema"')), true) AS k
  FROM (SELECT *, regexp_split_to_array(content, '{MODE_CALL}') AS parts, regexp_extract_all(content, '{MODE_CALL}') AS calls
        FROM source_files WHERE {ETL_CAND_SQL})"""
ORACLE["etl_patch"] = with_views(["source_files"], f"""
SELECT repo, path, sha256(array_to_string(list_transform(generate_series(1, len(parts)), lambda i: parts[i]
    || coalesce(calls[i], '') || CASE WHEN i = k THEN '.option("mergeSchema", "true")' ELSE '' END), '')) AS patched_sha256
FROM ({ETL_SQL}) WHERE k IS NOT NULL AND k > 0""")


# ---- U4 / E9 -----------------------------------------------------------------
def failed_runs(spark, sf):
    r = runs(spark, sf).withColumn("failure_context", R.failure_context(
        F.col("status"), F.col("logs_url"), F.col("log_body"), F.col("run_id")))
    return R.with_labels(r).where(~F.lower("status").isin(*K.PROMOTABLE_STATUSES))


def q_sql_patch(spark, sf):
    r = failed_runs(spark, sf).where(F.col("sql_hint"))
    sql_files = files(spark, sf).where(F.col("path").endswith(".sql"))
    p = R.sql_patches(r, sql_files)
    keys = ["repo", "target_catalog", "target_schema", "sql_path"]
    written = R.sql_patched_files(p, sql_files).select(*keys, F.sha2("content", 256).alias("sql_sha256"))
    return p.join(written, keys).select("run_id", "sql_path", "sql_generated", "sql_sha256")


SQL_CTES = [
    ("keys", "SELECT DISTINCT repo, target_catalog, target_schema, target_table FROM failed WHERE sql_hint"),
    ("sqlf", "SELECT repo, path, content FROM source_files WHERE ends_with(path, '.sql')"),
    ("pref", """SELECT k.*, f.path, f.content FROM keys k JOIN sqlf f ON f.repo = k.repo
        AND (contains(lower(f.content), lower(k.target_table)) OR contains(lower(f.content), lower(k.target_schema)))"""),
    ("prefk", "SELECT DISTINCT repo, target_catalog, target_schema, target_table FROM pref"),
    ("cand", """SELECT * FROM pref
        UNION ALL
        SELECT k.*, f.path, f.content FROM keys k JOIN sqlf f ON f.repo = k.repo
          WHERE NOT EXISTS (SELECT 1 FROM prefk p WHERE p.repo = k.repo AND p.target_catalog = k.target_catalog
                            AND p.target_schema = k.target_schema AND p.target_table = k.target_table)"""),
    ("firstlack", """SELECT repo, target_catalog, target_schema, target_table, min(path) AS path, arg_min(content, path) AS content FROM cand
        WHERE NOT (contains(lower(content), 'create schema if not exists') AND target_schema <> '' AND contains(lower(content), lower(target_schema)))
        GROUP BY ALL"""),
    ("sqlp", """SELECT f.run_id, coalesce(fl.path, 'sql/remediation_bootstrap_wi_' || CAST(f.work_item_id AS VARCHAR) || '.sql') AS sql_path,
        fl.path IS NULL AS sql_generated,
        '-- Added by remediation plugin to prevent missing namespace failures.' || chr(10) || 'CREATE CATALOG IF NOT EXISTS ' || f.target_catalog
          || ';' || chr(10) || 'CREATE SCHEMA IF NOT EXISTS ' || f.target_catalog || '.' || f.target_schema || ';' || chr(10) || chr(10)
          || coalesce(fl.content, '') AS sql_content
      FROM failed f LEFT JOIN firstlack fl USING (repo, target_catalog, target_schema, target_table) WHERE f.sql_hint"""),
]

QUERIES["sql_patch"] = q_sql_patch
ORACLE["sql_patch"] = with_views(["failure_logs", "plans", "source_files"],
                                 "SELECT run_id, sql_path, sql_generated, sha256(sql_content) AS sql_sha256 FROM sqlp",
                                 extra=RUN_CTES + SQL_CTES)


# ---- G9 / U5 / P5 ------------------------------------------------------------
def q_remediation_batch(spark, sf):
    rep = R.remediation_report(runs(spark, sf), files(spark, sf))
    return rep.select("run_id", "report", "remediation_status", "remediation_detail")


REPORT_CTES = SQL_CTES + [
    ("nbc", f"SELECT repo, path FROM ({NB_CAND_SQL}) WHERE NOT contains(content, '{K.NOTEBOOK_CONF_LINE}')"),
    ("etlc", f"SELECT repo, path FROM ({ETL_SQL}) WHERE k IS NOT NULL AND k > 0"),
    ("per_repo", """SELECT repo, count(*) FILTER (WHERE plugin = 'nb') AS nb_n, count(*) FILTER (WHERE plugin = 'etl') AS etl_n
      FROM (SELECT repo, path, 'nb' AS plugin FROM nbc UNION ALL SELECT repo, path, 'etl' FROM etlc) GROUP BY repo"""),
    ("rep", """SELECT f.run_id, f.work_item_id, f.environment,
        f.notebook_hint AND coalesce(pr.nb_n, 0) > 0 AS nb_on, f.sql_hint AND s.sql_path IS NOT NULL AS sql_on,
        f.etl_hint AND coalesce(pr.etl_n, 0) > 0 AS etl_on, pr.nb_n, pr.etl_n
      FROM failed f LEFT JOIN per_repo pr USING (repo) LEFT JOIN sqlp s USING (run_id)"""),
    ("rep2", """SELECT *, list_filter([CASE WHEN nb_on THEN 'databricks_notebook:' || CAST(nb_n AS VARCHAR) || ' file(s)' END,
          CASE WHEN sql_on THEN 'sql:1 file(s)' END,
          CASE WHEN etl_on THEN 'python_etl:' || CAST(etl_n AS VARCHAR) || ' file(s)' END], lambda x: x IS NOT NULL) AS entries,
        CASE WHEN nb_on THEN nb_n ELSE 0 END + CASE WHEN sql_on THEN 1 ELSE 0 END + CASE WHEN etl_on THEN etl_n ELSE 0 END AS changed
      FROM rep"""),
]

QUERIES["remediation_batch"] = q_remediation_batch
ORACLE["remediation_batch"] = with_views(["failure_logs", "plans", "source_files"], f"""
SELECT run_id, CASE WHEN len(entries) > 0 THEN array_to_string(entries, ', ') ELSE '{K.NO_PLUGIN_TEXT}' END AS report,
  'succeeded' AS remediation_status,
  CASE WHEN len(entries) > 0 THEN 'transformers=' || array_to_string(entries, ', ') || '; changed_files=' || CAST(changed AS VARCHAR)
       ELSE 'remediation_artifact=generated_changes/remediation_' || CAST(work_item_id AS VARCHAR) || '_' || environment || '_attempt_1.md' END
    AS remediation_detail
FROM rep2""", extra=RUN_CTES + REPORT_CTES)


def q_patch_report(spark, sf):
    """How many runs end with each transformer report."""
    rep = R.remediation_report(runs(spark, sf), files(spark, sf))
    return rep.groupBy("report").agg(F.count(F.lit(1)).alias("n_runs"))


QUERIES["patch_report"] = q_patch_report
ORACLE["patch_report"] = with_views(["failure_logs", "plans", "source_files"], f"""
SELECT CASE WHEN len(entries) > 0 THEN array_to_string(entries, ', ') ELSE '{K.NO_PLUGIN_TEXT}' END AS report, count(*) AS n_runs
FROM rep2 GROUP BY 1""", extra=RUN_CTES + REPORT_CTES)
