"""Registered queries: endpoint audit and configuration rules."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import network as N
from relaylake.operators import endpoints as EP
from relaylake.plans.sqlviews import with_views
from relaylake.sources import views

QUERIES: dict = {}
ORACLE: dict = {}

ALLOWED = views.ENDPOINT_SUFFIXES


# ---- DuckDB text helpers (the oracle side) ------------------------------------
def _h_sql(u: str) -> str:
    netloc = f"regexp_extract({u}, '{N.NETLOC}', 1)"
    info = f"regexp_extract({netloc}, '([^@]*)$', 1)"
    host = (f"CASE WHEN contains({info}, '[') THEN regexp_extract({info}, '\\[([^\\]]*)', 1) "
            f"ELSE regexp_extract({info}, '^([^:]*)', 1) END")
    return f"nullif(lower({host}), '')"


def host_sql(u: str) -> str:
    lu = f"ltrim({u})"
    return (f"coalesce({_h_sql(lu)}, CASE WHEN NOT contains({lu}, '://') AND NOT starts_with({lu}, '//') "
            f"THEN {_h_sql(chr(39) + 'http://' + chr(39) + ' || ' + lu)} END)")


def match_sql(h: str, suffixes: list[str]) -> str:
    parts = []
    for s in [x.strip().lower() for x in suffixes if x.strip()]:
        parts.append(f"ends_with(lower(trim({h})), '{s}')" if s.startswith(".") else f"lower(trim({h})) = '{s}'")
    return f"coalesce(CASE WHEN lower(trim({h})) <> '' THEN ({' OR '.join(parts) or 'false'}) END, false)"


def _ranges_sql(v: str, cidrs: list[str]) -> str:
    out = []
    for c in cidrs:
        n = ipaddress.ip_network(c)
        out.append(f"({v} BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)})")
    return "(" + " OR ".join(out) + ")"


def internal_sql(u: str, suffixes: list[str]) -> str:
    h = _h_sql(f"ltrim({u})")
    o = [f"TRY_CAST(split_part({h}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    ok = f"(regexp_matches({h}, '{N.IPV4}') AND " + " AND ".join(f"{x} <= 255" for x in o) + ")"
    v = f"({o[0]} * 16777216 + {o[1]} * 65536 + {o[2]} * 256 + {o[3]})"
    ip = f"(CASE WHEN {ok} THEN {_ranges_sql(v, N.PRIVATE_V4)} AND NOT {_ranges_sql(v, N.PRIVATE_V4_EXCEPTIONS)} ELSE false END)"
    # the IPv6 literals of the tables: unique local, link local, loopback; all others there are public
    v6 = f"regexp_matches({h}, '^(::1$|f[cd][0-9a-f][0-9a-f]:|fe[89ab][0-9a-f]:)')"
    return f"coalesce({h} IS NOT NULL AND ({match_sql(h, suffixes)} OR {ip} OR {v6}), false)"


# ---- endpoint variants from pages --------------------------------------------
def endpoint_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs as written, scheme-less, and with user-info and a port."""
    e = views.endpoints(spark, sf)
    bare = F.regexp_replace("url", r"^[a-z]+://", "")
    userinfo = F.regexp_replace("url", r"^([a-z]+://)([^/?#]+)", "$1ops@$2:8443")
    return e.select("name", "url").unionByName(
        e.select(F.concat(F.col("name"), F.lit("-bare")).alias("name"), bare.alias("url"))).unionByName(
        e.select(F.concat(F.col("name"), F.lit("-auth")).alias("name"), userinfo.alias("url")))


VARIANTS_SQL = """SELECT name, url FROM endpoints
  UNION ALL SELECT name || '-bare', regexp_replace(url, '^[a-z]+://', '') FROM endpoints
  UNION ALL SELECT name || '-auth', regexp_replace(url, '^([a-z]+://)([^/?#]+)', '\\1ops@\\2:8443') FROM endpoints"""


def q_endpoint_host(spark, sf):
    return EP.endpoint_hosts(endpoint_variants(spark, sf)).select("name", "url", "host")


QUERIES["endpoint_host"] = q_endpoint_host
ORACLE["endpoint_host"] = with_views(["endpoints"], f"SELECT name, url, {host_sql('url')} AS host FROM v",
                                     extra=[("v", VARIANTS_SQL)])


def q_endpoint_suffix(spark, sf):
    h = EP.endpoint_hosts(views.endpoints(spark, sf))
    return h.select("name", "host", N.matches_suffixes(F.col("host"), ALLOWED).alias("allowed"))


QUERIES["endpoint_suffix"] = q_endpoint_suffix
ORACLE["endpoint_suffix"] = with_views(["endpoints"], f"""SELECT name, host, {match_sql('host', ALLOWED)} AS allowed
  FROM (SELECT name, {host_sql('url')} AS host FROM endpoints)""")


def config_endpoint_rows(spark: SparkSession, sf: str) -> DataFrame:
    cfg = views.pipeline_configs(spark, sf)
    return cfg.select("config_id", F.explode(EP.config_endpoints(cfg)).alias("url")).where(F.col("url") != "")


CFG_EPS_SQL = ("SELECT config_id, unnest(list_concat([devops_url, pipelines_url, repos_url, coalesce(llm_url, '')], "
               "workspace_urls, mcp_urls)) AS url FROM pipeline_configs")


def q_endpoint_internal(spark, sf):
    """C26 over every distinct endpoint of pages and configurations."""
    urls = views.endpoints(spark, sf).select("url").unionByName(config_endpoint_rows(spark, sf).select("url")).distinct()
    return N.with_internal_flag(urls, "url", "internal", K.INTERNAL_HOST_SUFFIXES, True)


QUERIES["endpoint_internal"] = q_endpoint_internal
ORACLE["endpoint_internal"] = with_views(["endpoints", "pipeline_configs"], f"""
SELECT url, {internal_sql('url', K.INTERNAL_HOST_SUFFIXES)} AS internal
FROM (SELECT url FROM endpoints UNION SELECT url FROM ({CFG_EPS_SQL}) WHERE url <> '')""")


def q_egress_violations(spark, sf):
    """F9 over the page endpoints and their variants."""
    return EP.egress_violations(endpoint_variants(spark, sf), ALLOWED)


QUERIES["egress_violations"] = q_egress_violations
ORACLE["egress_violations"] = with_views(["endpoints"], f"""
SELECT DISTINCT CASE WHEN h IS NULL THEN url WHEN NOT {match_sql('h', ALLOWED)} THEN h END AS violation
FROM (SELECT url, {host_sql('url')} AS h FROM v WHERE coalesce(url, '') <> '')
WHERE h IS NULL OR NOT {match_sql('h', ALLOWED)}""", extra=[("v", VARIANTS_SQL)])


def q_suffix_anti_join(spark, sf):
    """Hosts matching no allow-list entry, as an equi-join on host tails."""
    hosts = EP.endpoint_hosts(views.endpoints(spark, sf)).select("host").distinct()
    return EP.suffix_anti_join(hosts, views.suffixes(spark, ALLOWED))


QUERIES["suffix_anti_join"] = q_suffix_anti_join
ORACLE["suffix_anti_join"] = with_views(["endpoints"], f"""
SELECT DISTINCT host FROM (SELECT {host_sql('url')} AS host FROM endpoints)
WHERE host IS NULL OR NOT {match_sql('host', ALLOWED)}""")


# ---- configuration rules -------------------------------------------------------
def configs(spark, sf):
    return views.pipeline_configs(spark, sf)


def q_config_rules(spark, sf):
    c = configs(spark, sf)
    errs = EP.config_errors(c)
    return c.select("config_id", F.size(errs).alias("n_errors"), F.array_join(errs, " || ").alias("errors"))


def _pylist_sql(arr: str) -> str:
    return f"'[' || array_to_string(list_transform({arr}, lambda s: '''' || s || ''''), ', ') || ']'"


BAD_APPLY = "list_sort(list_distinct(list_filter(apply_stages, lambda s: NOT list_contains(stage_sequence, s))))"
BAD_HIL = "list_sort(list_distinct(list_filter(approval_stages, lambda s: NOT list_contains(stage_sequence, s))))"
ERRORS_SQL = f"""list_filter([
  CASE WHEN len(workspace_urls) = 0 THEN 'At least one Databricks workspace URL must be configured.' END,
  CASE WHEN len(list_filter(plugins, lambda p: trim(p) <> '')) = 0 THEN 'transformers.enabled_plugins must include at least one plugin name.' END,
  CASE WHEN len({BAD_APPLY}) > 0 THEN 'workflow.databricks_apply_in_stages must be subset of workflow.stage_sequence. Invalid stages: ' || {_pylist_sql(BAD_APPLY)} END,
  CASE WHEN len({BAD_HIL}) > 0 THEN 'workflow.hil_approval_stages must be subset of workflow.stage_sequence. Invalid stages: ' || {_pylist_sql(BAD_HIL)} END,
  CASE WHEN retry_attempts < 1 THEN 'runtime.retry_attempts must be at least 1.' END,
  CASE WHEN retry_initial <= 0 THEN 'runtime.retry_initial_delay_seconds must be greater than 0.' END,
  CASE WHEN retry_max <= 0 THEN 'runtime.retry_max_delay_seconds must be greater than 0.' END,
  CASE WHEN backoff < 1 THEN 'runtime.retry_backoff_multiplier must be >= 1.' END,
  CASE WHEN max_remediation < 0 THEN 'runtime.max_failure_remediation_attempts must be >= 0.' END,
  CASE WHEN strict AND mode <> 'connected' THEN 'security.strict_private_mode requires integration_mode=''connected'' so the agent runs with real enterprise integrations.' END,
  CASE WHEN strict AND llm_enabled AND coalesce(llm_url, '') = '' THEN 'security.strict_private_mode with llm_enabled=true requires prompts.llm_endpoint_url.' END
], lambda x: x IS NOT NULL)"""

QUERIES["config_rules"] = q_config_rules
ORACLE["config_rules"] = with_views(["pipeline_configs"], f"""
SELECT config_id, CAST(len(e) AS INTEGER) AS n_errors, array_to_string(e, ' || ') AS errors FROM (SELECT config_id, {ERRORS_SQL} AS e FROM pipeline_configs)""")


def q_stage_set_diff(spark, sf):
    """Apply stages that are not in the stage sequence."""
    c = configs(spark, sf)
    d = F.array_sort(F.array_distinct(F.array_except("apply_stages", "stage_sequence")))
    return c.select("config_id", F.array_join(d, ",").alias("invalid_stages")).where(F.col("invalid_stages") != "")


QUERIES["stage_set_diff"] = q_stage_set_diff
ORACLE["stage_set_diff"] = with_views(["pipeline_configs"], f"""
SELECT config_id, array_to_string({BAD_APPLY}, ',') AS invalid_stages FROM pipeline_configs WHERE len({BAD_APPLY}) > 0""")


def q_missing_workspace(spark, sf):
    m = EP.missing_workspaces(configs(spark, sf))
    return m.select("config_id", F.array_join("missing", ",").alias("missing")).where(F.col("missing") != "")


QUERIES["missing_workspace"] = q_missing_workspace
ORACLE["missing_workspace"] = with_views(["pipeline_configs"], """
SELECT config_id, array_to_string(list_filter(apply_stages, lambda s: NOT list_contains(workspace_stages, s)), ',') AS missing
FROM pipeline_configs WHERE len(list_filter(apply_stages, lambda s: NOT list_contains(workspace_stages, s))) > 0""")


def q_host_union(spark, sf):
    """Distinct hosts over all configured endpoint lists (blanks dropped)."""
    e = config_endpoint_rows(spark, sf)
    return e.select(N.hostname(F.col("url")).alias("host")).where(F.col("host").isNotNull()).distinct()


QUERIES["host_union"] = q_host_union
ORACLE["host_union"] = with_views(["pipeline_configs"], f"""
SELECT DISTINCT {host_sql('url')} AS host FROM ({CFG_EPS_SQL}) WHERE url <> '' AND {host_sql('url')} IS NOT NULL""")


BLOCKED_SQL = (f"list_sort(list_distinct(list_filter(list_transform(list_filter(list_concat([devops_url, pipelines_url, repos_url, "
               f"coalesce(llm_url, '')], workspace_urls, mcp_urls), lambda e: e <> ''), lambda e: CASE WHEN {host_sql('e')} IS NULL THEN e "
               f"WHEN NOT {match_sql(host_sql('e'), K.ALLOWED_EGRESS_SUFFIXES)} THEN {host_sql('e')} END), lambda x: x IS NOT NULL)))")


def q_host_list(spark, sf):
    """G4 + F9 per configuration: sorted distinct disallowed hosts."""
    c = configs(spark, sf)
    b = EP.config_egress(EP.config_endpoints(c), K.ALLOWED_EGRESS_SUFFIXES)
    return c.select("config_id", F.array_join(b, ",").alias("blocked")).where(F.col("blocked") != "")


QUERIES["host_list"] = q_host_list
ORACLE["host_list"] = with_views(["pipeline_configs"], f"""
SELECT config_id, array_to_string({BLOCKED_SQL}, ',') AS blocked FROM pipeline_configs WHERE len({BLOCKED_SQL}) > 0""")


def q_readiness_rollup(spark, sf):
    """Readiness checks per configuration and the failed subset."""
    r = EP.readiness(configs(spark, sf)).drop("_blocked")
    ordered = F.array(*[F.concat(F.lit(n + "="), F.col("checks")[n]) for n in K.READINESS_CHECKS])
    return r.select("config_id", F.array_join(ordered, ";").alias("checks"), F.array_join("failed", ",").alias("failed"))


MISSING_WS = "list_filter(apply_stages, lambda s: NOT list_contains(workspace_stages, s))"
CHECKS_SQL = [
    ("azure_devops", "CASE WHEN mode = 'simulate' THEN 'ok(local_mock_present)' ELSE 'ok' END"),
    ("azure_repos", "CASE WHEN NOT checkout_exists THEN 'error(local_checkout_missing:' || checkout_path || ')' WHEN dry_run THEN 'ok(dry_run)' "
                    "WHEN NOT is_work_tree THEN 'error(git_repo_check_failed:fatal: not a git repository)' ELSE 'ok' END"),
    ("azure_pipelines", "CASE WHEN mode = 'simulate' THEN 'ok(simulate_mode)' ELSE 'ok' END"),
    ("databricks", f"CASE WHEN len({MISSING_WS}) > 0 THEN 'error(missing_workspace_urls:' || array_to_string({MISSING_WS}, ',') || ')' "
                   "WHEN mode = 'simulate' THEN 'ok(simulate_mode)' ELSE 'ok' END"),
    ("llm", "CASE WHEN NOT llm_enabled THEN 'ok(disabled)' WHEN coalesce(llm_url, '') = '' THEN 'error(llm_endpoint_missing)' "
            f"WHEN strict AND NOT {internal_sql('llm_url', K.INTERNAL_HOST_SUFFIXES)} THEN 'error(llm_endpoint_not_internal)' ELSE 'ok' END"),
    ("mcp", "CASE WHEN mcp_enabled AND strict AND config_id % 6 = 0 THEN 'error(mcp_endpoints_not_internal:devops_mcp)' "
            "WHEN NOT mcp_enabled THEN 'ok(disabled)' "
            "WHEN config_id % 6 = 2 AND config_id % 10 = 4 THEN 'error(unreachable_servers:docs_mcp)' ELSE 'ok' END"),
    ("security", "CASE WHEN NOT strict THEN 'ok(disabled)' WHEN mode <> 'connected' THEN 'error(strict_private_requires_connected_mode)' "
                 f"WHEN len({BLOCKED_SQL}) > 0 THEN 'error(disallowed_egress_hosts:' || array_to_string({BLOCKED_SQL}, ',') || ')' ELSE 'ok' END"),
]

QUERIES["readiness_rollup"] = q_readiness_rollup
ORACLE["readiness_rollup"] = with_views(["pipeline_configs"], "SELECT config_id, "
    + " || ';' || ".join(f"'{n}=' || ({v})" for n, v in CHECKS_SQL) + " AS checks, "
    + "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT starts_with({v}, 'ok') THEN '{n}' END" for n, v in CHECKS_SQL)
    + "], lambda x: x IS NOT NULL), ',') AS failed FROM pipeline_configs")


def q_endpoint_audit(spark, sf):
    """S2 → C24 → C25/C26 → F9 → G5, one row per configuration."""
    c = configs(spark, sf)
    n_eps = F.size(F.filter(EP.config_endpoints(c), lambda e: e != "")).alias("n_endpoints")
    r = EP.readiness(c, keep=[n_eps])  # one projection per configuration, no self-join
    return r.select("config_id", "n_endpoints", F.array_join("_blocked", ",").alias("blocked_hosts"),
                    F.col("checks")["security"].alias("security"), F.array_join("failed", ",").alias("failed_checks"))


QUERIES["endpoint_audit"] = q_endpoint_audit
ORACLE["endpoint_audit"] = with_views(["pipeline_configs"], f"""
SELECT config_id, CAST(len(list_filter(list_concat([devops_url, pipelines_url, repos_url, coalesce(llm_url, '')], workspace_urls, mcp_urls),
  lambda e: e <> '')) AS INTEGER) AS n_endpoints, array_to_string({BLOCKED_SQL}, ',') AS blocked_hosts,
  {dict(CHECKS_SQL)['security']} AS security,
  array_to_string(list_filter([""" + ", ".join(f"CASE WHEN NOT starts_with({v}, 'ok') THEN '{n}' END" for n, v in CHECKS_SQL)
    + "], lambda x: x IS NOT NULL), ',') AS failed_checks FROM pipeline_configs")
