"""DuckDB text of the derived views, for the oracle queries.

Written independently of the DataFrame code in ``relaylake.sources.views``
so that the oracle checks the binding as well as the operators. Each entry
is a CTE body; ``with_views(names, body)`` assembles a statement.
"""

from __future__ import annotations

from relaylake import constants as K

STAGES_SQL = "['dev', 'qe', 'stg', 'prod']"

VIEWS: dict[str, str] = {}

VIEWS["work_items"] = """
SELECT o_orderkey AS id,
  'Load ' || CASE WHEN o_orderkey % 4 <> 0 THEN 'main.bronze.cust_' || CAST(o_custkey % 50 AS VARCHAR) ELSE 'customer data' END
    || CASE o_orderkey % 5 WHEN 0 THEN ' from jdbc' WHEN 1 THEN ' from flat file' WHEN 2 THEN ' via edw and csv' ELSE '' END
    || CASE o_orderkey % 3 WHEN 0 THEN ' append' WHEN 1 THEN ' overwrite' ELSE '' END AS title,
  'Ingest order ' || CAST(o_orderkey AS VARCHAR) || ' of customer ' || CAST(o_custkey AS VARCHAR) || '.' AS description,
  CASE o_orderkey % 3 WHEN 0 THEN 'Product Backlog Item' WHEN 1 THEN 'Bug' ELSE 'User Story' END AS item_type,
  CASE WHEN o_orderkey % 13 = 0 THEN ['bronze', 'repo: ', 'repo:late']
       WHEN o_orderkey % 6 <> 0 THEN ['bronze', 'repo:repo-' || CAST(o_custkey % 7 AS VARCHAR)]
       ELSE ['bronze'] END AS tags,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Row counts match the source and keys stay unique.' END AS acceptance_criteria,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
  CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Active' ELSE 'New' END AS state,
  'p' || CAST(o_custkey % 4 AS VARCHAR) AS project,
  o_orderdate AS changed_date,
  o_custkey % 3 AS cust_group
FROM orders
"""

# normalised tickets: repo hint from the first repo: tag (later tags not tried)
VIEWS["tickets"] = """
SELECT *, nullif(trim(substr(trim(list_filter(tags, lambda t: starts_with(lower(trim(t)), 'repo:'))[1]), 6)), '') AS repo_name
FROM work_items
"""

VIEWS["keyed"] = """
SELECT *, CAST(id AS VARCHAR) || ':' || sha256(CAST(id AS VARCHAR) || '|' || trim(title) || '|' || trim(description))[1:16] AS run_key
FROM tickets
"""

VIEWS["run_ledger"] = """
SELECT run_key, 'in_progress' AS status, id * 2 AS seq FROM keyed
UNION ALL
SELECT run_key, CASE WHEN cust_group = 0 THEN 'succeeded' ELSE 'failed' END, id * 2 + 1 FROM keyed WHERE cust_group < 2
"""

VIEWS["plans"] = f"""
SELECT t.*,
  id AS work_item_id,
  CASE WHEN jd AND ff THEN ['jdbc', 'flat_file'] WHEN jd THEN ['jdbc'] WHEN ff THEN ['flat_file'] ELSE ['unknown'] END AS source_types,
  CASE WHEN contains(blob, 'overwrite') THEN 'overwrite' ELSE 'append' END AS ingestion_mode,
  'bronze' AS target_layer,
  CASE WHEN tx THEN lower(regexp_extract(txt, '{K.TABLE_PATTERN}', 1)) ELSE 'main' END AS target_catalog,
  CASE WHEN tx THEN lower(regexp_extract(txt, '{K.TABLE_PATTERN}', 2)) ELSE 'bronze' END AS target_schema,
  CASE WHEN tx THEN lower(regexp_extract(txt, '{K.TABLE_PATTERN}', 3)) ELSE 'wi_' || CAST(id AS VARCHAR) || '_table' END AS target_table,
  coalesce(repo_name, '{K.DEFAULT_REPO}') AS target_repo,
  '{K.BRANCH_PREFIX}' || CAST(id AS VARCHAR) || '-' ||
    coalesce(nullif(left(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 35), ''), 'work-item') AS branch_name,
  list_filter([CASE WHEN jd THEN '{K.RISK_JDBC}' END,
               CASE WHEN contains(blob, 'overwrite') THEN '{K.RISK_OVERWRITE}' END], lambda x: x IS NOT NULL) AS risk_notes,
  list_filter([CASE WHEN NOT tx THEN '{K.Q_TABLE}' END,
               CASE WHEN NOT (jd OR ff) THEN '{K.Q_SOURCE}' END,
               CASE WHEN NOT (contains(blob, 'overwrite') OR contains(blob, 'append')) THEN '{K.Q_MODE}' END,
               CASE WHEN coalesce(repo_name, '') = '' THEN '{K.Q_REPO}' END,
               CASE WHEN trim(acceptance_criteria) = '' THEN '{K.Q_CRITERIA}' END], lambda x: x IS NOT NULL) AS clarification_questions
FROM (
  SELECT *, contains(blob, 'jdbc') OR contains(blob, 'edw') AS jd,
         contains(blob, 'flat file') OR contains(blob, 'volume') OR contains(blob, 'csv') AS ff,
         regexp_matches(txt, '{K.TABLE_PATTERN}') AS tx
  FROM (SELECT *, title || ' ' || description || ' ' || acceptance_criteria AS txt,
               lower(title || ' ' || description || ' ' || acceptance_criteria) AS blob FROM keyed)
) t
"""

VIEWS["stage_runs"] = f"""
SELECT l_orderkey AS work_item_id, CAST((l_linenumber - 1) % 4 + 1 AS INTEGER) AS ord,
  {STAGES_SQL}[(l_linenumber - 1) % 4 + 1] AS environment,
  CAST(row_number() OVER (PARTITION BY l_orderkey, (l_linenumber - 1) % 4 ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS INTEGER) AS attempt,
  CASE l_returnflag WHEN 'N' THEN 'succeeded' WHEN 'A' THEN 'failed' ELSE 'partiallySucceeded' END AS status,
  l_linestatus = 'O' AS fix_ok,
  l_suppkey % 100 AS team,
  l_shipdate AS started_at,
  CAST(l_quantity * 60 AS BIGINT) AS duration_s
FROM lineitem
"""

VIEWS["approval_events"] = f"""
SELECT CAST(user_id AS VARCHAR) || ':' || CAST(day(ts) AS VARCHAR) AS request_id,
  {STAGES_SQL}[CAST(user_id % 4 AS INTEGER) + 1] AS stage,
  CASE event_type WHEN 'signup' THEN 'requested' WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'comment' END AS event,
  CASE WHEN event_id % 50 = 0 THEN 'x' ELSE 'approver-' || CAST(event_id % 9 AS VARCHAR) END AS actor,
  props AS comment, ts, event_id AS seq, user_id AS work_item_id,
  'Approve deployment for work item ' || CAST(user_id AS VARCHAR) AS summary
FROM events
"""

VIEWS["learning_history"] = """
SELECT p_partkey AS work_item_id, p_name AS title,
  CASE WHEN p_size % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS status,
  'wi_' || CAST(p_partkey AS VARCHAR) || '_table' AS target_table,
  CASE p_type WHEN 'PROMO' THEN ['jdbc'] WHEN 'SMALL' THEN ['flat_file'] WHEN 'LARGE' THEN ['jdbc', 'flat_file'] ELSE ['unknown'] END AS source_types,
  p_partkey AS seq
FROM part
"""

VIEWS["endpoints"] = "SELECT 'page-' || CAST(page_id AS VARCHAR) AS name, url FROM pages"

VIEWS["failure_logs"] = f"""
SELECT doc_id AS run_id, doc_id AS work_item_id,
  {STAGES_SQL}[CAST(doc_id % 4 AS INTEGER) + 1] AS environment,
  CASE doc_id % 5 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'Succeeded' ELSE 'failed' END AS status,
  CASE WHEN doc_id % 10 = 9 THEN '' ELSE 'http://localhost/pipelines/' || CAST(doc_id AS VARCHAR) || '/logs' END AS logs_url,
  text || chr(10) || ['AnalysisException: schema mismatch on write', 'Table or view not found: main.bronze.target',
                      'cannot resolve column amount', 'timeout while waiting for cluster'][CAST(doc_id % 4 AS INTEGER) + 1] AS log_body
FROM documents
"""

VIEWS["log_lines"] = """
SELECT event_id AS line_no,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' | ' ||
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END || ' | ' ||
  'relay.' || event_type || ' | ' ||
  CASE WHEN event_type = 'error' THEN 'operation_retry_failed name=op_' || CAST(user_id % 5 AS VARCHAR) || ' attempt=' || CAST(event_id % 3 + 1 AS VARCHAR) || '/3 error=boom'
       WHEN event_type = 'view' THEN 'operation_finished name=op_' || CAST(user_id % 5 AS VARCHAR) || ' duration_seconds='
            || CAST(CAST(round(value * 1000) AS BIGINT) // 1000 AS VARCHAR) || '.' || lpad(CAST(CAST(round(value * 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0')
            || ' max_rss_kb=' || CAST(event_id % 1000 + 1000 AS VARCHAR)
       ELSE 'event_seen user_id=' || CAST(user_id AS VARCHAR) END AS value
FROM events
"""

VIEWS["pipeline_configs"] = """
SELECT c_custkey AS config_id,
  CASE WHEN c_custkey % 5 = 0 THEN ['dev', 'qe', 'prod'] ELSE ['dev', 'qe', 'stg', 'prod'] END AS stage_sequence,
  CASE WHEN c_custkey % 7 = 0 THEN ['dev', 'uat'] ELSE ['dev'] END AS apply_stages,
  ['qe', 'stg', 'prod'] AS approval_stages,
  CAST(c_custkey % 4 AS INTEGER) AS retry_attempts, c_acctbal / 1000 AS retry_initial, 8.0 AS retry_max,
  CASE WHEN c_custkey % 11 = 0 THEN 0.5 ELSE 2.0 END AS backoff,
  CASE WHEN c_custkey % 13 = 0 THEN -1 ELSE 2 END AS max_remediation,
  CASE WHEN c_custkey % 3 = 0 THEN 'simulate' ELSE 'connected' END AS mode,
  c_custkey % 2 = 0 AS strict, c_custkey % 3 = 1 AS llm_enabled,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'http://llm.internal:8080/v1' WHEN 2 THEN 'https://api.example.com/v1'
       ELSE CASE c_custkey % 16 WHEN 7 THEN 'http://[fd12:3456::' || upper(to_hex(c_custkey % 65536)) || ']:8080/v1'
         WHEN 11 THEN 'http://[2606:4700::' || upper(to_hex(c_custkey % 65536)) || ']/v1' ELSE 'http://10.1.2.3/v1' END END AS llm_url,
  CASE WHEN c_custkey % 9 = 0 THEN ['  ', ''] ELSE ['databricks_notebook', 'sql', 'python_etl'] END AS plugins,
  CASE WHEN c_custkey % 8 = 0 THEN [] ELSE ['https://adb-' || CAST(c_custkey AS VARCHAR) || '.azuredatabricks.net'] END AS workspace_urls,
  CASE WHEN c_custkey % 8 = 0 THEN [] ELSE ['dev'] END AS workspace_stages,
  CASE c_custkey % 6 WHEN 0 THEN ['https://mcp-' || CAST(c_custkey AS VARCHAR) || '.example.org/api']
    WHEN 2 THEN ['http://mcp.internal/api', 'http://[fe80::7%eth0]/api'] ELSE [] END AS mcp_urls,
  c_custkey % 5 < 3 AS mcp_enabled, 'checkouts/repo-' || CAST(c_custkey % 9 AS VARCHAR) AS checkout_path, c_custkey % 9 < 7 AS checkout_exists,
  c_custkey % 4 <> 1 AS dry_run, c_custkey % 7 <> 3 AS is_work_tree,
  'https://dev.azure.com/org' AS devops_url, 'https://dev.azure.com/org' AS pipelines_url,
  CASE WHEN c_custkey % 10 = 0 THEN 'git.corp.example.com:7999/scm' ELSE 'https://dev.azure.com/org' END AS repos_url
FROM customer
"""

VIEWS["source_files"] = f"""
SELECT 'repo-' || CAST(p_partkey % 7 AS VARCHAR) AS repo,
  CASE p_partkey % 4 WHEN 0 THEN 'etl/load_' || CAST(p_partkey AS VARCHAR) || '.py'
       WHEN 1 THEN 'sql/create_' || CAST(p_partkey AS VARCHAR) || '.sql'
       WHEN 2 THEN 'notebooks/nb_' || CAST(p_partkey AS VARCHAR) || '.py'
       ELSE 'tests/test_' || CAST(p_partkey AS VARCHAR) || '.py' END AS path,
  CASE p_partkey % 4
    WHEN 0 THEN 'import pyspark' || chr(10) || chr(10) || 'df = spark.read.table("raw.' || p_brand || '")' || chr(10)
      || CASE WHEN p_size % 3 = 0 THEN 'df.write.mode("overwrite")' || chr(10) || '    .option("mergeSchema", "true").saveAsTable("main.bronze.part_'
              || CAST(p_partkey AS VARCHAR) || '")' || chr(10) ELSE '' END
      || 'df.write.mode("append").saveAsTable("main.bronze.part_' || CAST(p_partkey AS VARCHAR) || '")' || chr(10)
      || CASE WHEN p_size % 2 = 0 THEN 'df.write.mode( "overwrite" ) .saveAsTable("main.bronze.part_' || CAST(p_partkey AS VARCHAR)
              || '_copy")' || chr(10) ELSE '' END
    WHEN 1 THEN CASE WHEN p_size % 5 = 0 THEN 'CREATE SCHEMA IF NOT EXISTS main.bronze;' || chr(10) ELSE '' END
      || 'CREATE TABLE IF NOT EXISTS main.bronze.part_' || CAST(p_partkey AS VARCHAR) || ' AS SELECT ' || chr(39) || p_name || chr(39)
      || ' AS name;' || chr(10)
    WHEN 2 THEN CASE WHEN p_size % 4 = 0 THEN '#!/usr/bin/env python' || chr(10) || '# -*- coding: utf-8 -*-' || chr(10) ELSE '' END
      || 'import os' || chr(10) || chr(10) || 'from pyspark.sql import functions as F' || chr(10)
      || CASE WHEN p_size % 6 = 0 THEN '{K.NOTEBOOK_CONF_LINE}' || chr(10) ELSE '' END
      || '# transform ' || p_name || chr(10) || 'df = spark.table("main.bronze.part_' || CAST(p_partkey AS VARCHAR) || '")' || chr(10)
    ELSE 'def test_part_' || CAST(p_partkey AS VARCHAR) || '():' || chr(10) || '    assert "' || p_name || '"' || chr(10) END AS content
FROM part
"""

# dependencies between the views above (a CTE list must be ordered)
DEPENDS = {
    "tickets": ["work_items"],
    "keyed": ["tickets"],
    "run_ledger": ["keyed"],
    "plans": ["keyed"],
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in DEPENDS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(names: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <views and their dependencies>, <extra CTEs> <body>``."""
    ctes = [f"{n} AS ({VIEWS[n]})" for n in _closure(names)]
    ctes += [f"{n} AS ({sql})" for n, sql in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" + body
