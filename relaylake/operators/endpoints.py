"""Endpoint audit and configuration rules (C24-C26, E10, E12, F8, F9, F11,
S1, S2, G4, G5, P6).

A configuration is a row; its endpoints, stages and suffix lists are array
columns. Rule checks are Column expressions over those arrays, so a table of
configurations is audited in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import network as N
from relaylake.functions import text as T


def endpoint_hosts(endpoints: DataFrame, url: str = "url") -> DataFrame:
    return endpoints.withColumn("host", N.hostname(F.col(url)))


def suffix_anti_join(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Hosts that match no suffix entry.

    Each host expands to its candidate keys (itself and its '.'-led tails);
    an equi-join against the cleaned suffix table replaces the nested loop of
    ``endswith`` tests, so the suffix table may be large as well.
    """
    s = suffixes.select(F.lower(T.strip(F.col("suffix"))).alias("key")).where(F.col("key") != "").distinct()
    cand = hosts.where(F.col("host").isNotNull()).select("host", F.explode(N.host_suffixes(F.col("host"))).alias("key"))
    matched = cand.join(s, "key", "left_semi").select("host").distinct()
    return hosts.join(matched, "host", "left_anti")


def egress_violations(endpoints: DataFrame, allowed: list[str], url: str = "url") -> DataFrame:
    """hosts outside the allow-list; an endpoint without a parseable host
    is itself the violation (fail closed). Blank endpoints are skipped."""
    e = endpoints.where(F.coalesce(F.col(url), F.lit("")) != "").withColumn("_h", N.hostname(F.col(url)))
    h = F.col("_h")
    v = F.when(h.isNull(), F.col(url)).when(~N.matches_suffixes(h, allowed), h)
    return e.select(v.alias("violation")).where(F.col("violation").isNotNull()).distinct()


# ---- configuration tables ----------------------------------------------------
def _py_list(arr: Column) -> Column:
    """How a sorted list of strings prints in Python: ['a', 'b']."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "), F.lit("]"))


def effective_mode(cfg: DataFrame) -> Column:
    """The integration mode after the legacy alias: a ``local_mode`` column,
    when present and set, means simulate (true) or connected (false)."""
    if "local_mode" not in cfg.columns:
        return F.col("mode")
    lm = F.col("local_mode")
    return F.when(lm.isNull(), F.col("mode")).when(lm, F.lit("simulate")).otherwise(F.lit("connected"))


def config_errors(cfg: DataFrame) -> Column:
    """F11 + S1: every rule violation of a configuration row, in rule order."""
    seq = F.col("stage_sequence")
    bad_apply = F.array_sort(F.array_distinct(F.array_except("apply_stages", seq)))
    bad_hil = F.array_sort(F.array_distinct(F.array_except("approval_stages", seq)))
    plugins = F.filter(F.transform("plugins", lambda p: T.strip(p)), lambda p: p != "")
    return F.array_compact(F.array(
        F.when(F.size("workspaces") == 0, F.lit("At least one Databricks workspace URL must be configured.")),
        F.when(F.size(plugins) == 0, F.lit("transformers.enabled_plugins must include at least one plugin name.")),
        F.when(F.size(bad_apply) > 0, F.concat(
            F.lit("workflow.databricks_apply_in_stages must be subset of workflow.stage_sequence. Invalid stages: "),
            _py_list(bad_apply))),
        F.when(F.size(bad_hil) > 0, F.concat(
            F.lit("workflow.hil_approval_stages must be subset of workflow.stage_sequence. Invalid stages: "),
            _py_list(bad_hil))),
        F.when(F.col("retry_attempts") < 1, F.lit("runtime.retry_attempts must be at least 1.")),
        F.when(F.col("retry_initial") <= 0, F.lit("runtime.retry_initial_delay_seconds must be greater than 0.")),
        F.when(F.col("retry_max") <= 0, F.lit("runtime.retry_max_delay_seconds must be greater than 0.")),
        F.when(F.col("backoff") < 1, F.lit("runtime.retry_backoff_multiplier must be >= 1.")),
        F.when(F.col("max_remediation") < 0, F.lit("runtime.max_failure_remediation_attempts must be >= 0.")),
        F.when(F.col("strict") & (effective_mode(cfg) != "connected"), F.lit(
            "security.strict_private_mode requires integration_mode='connected' "
            "so the agent runs with real enterprise integrations.")),
        F.when(F.col("strict") & F.col("llm_enabled") & (F.coalesce(F.col("llm_url"), F.lit("")) == ""), F.lit(
            "security.strict_private_mode with llm_enabled=true requires prompts.llm_endpoint_url.")),
    ))


def config_endpoints(cfg: DataFrame) -> Column:
    """The endpoints a configuration talks to, in configuration order."""
    return F.concat(
        F.array(F.col("devops_url"), F.col("pipelines_url"), F.col("repos_url"), F.coalesce(F.col("llm_url"), F.lit(""))),
        F.map_values("workspaces"),
        F.map_values("mcp_servers"),
    )


def config_egress(endpoints: Column, allowed: list[str]) -> Column:
    """F9 + G4 per configuration: sorted distinct disallowed hosts."""
    nonblank = F.filter(endpoints, lambda e: e != "")
    # parse each host once, then test it
    parsed = F.transform(nonblank, lambda e: F.struct(e.alias("url"), N.hostname(e).alias("host")))
    hits = F.transform(parsed, lambda p: F.when(p["host"].isNull(), p["url"])
                       .when(~N.matches_suffixes(p["host"], allowed), p["host"]))
    return F.array_sort(F.array_distinct(F.array_compact(hits)))


def readiness(cfg: DataFrame, allowed: list[str] | None = None,
              internal: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The seven readiness checks per configuration as a name → status
    map, plus the failed subset (status not starting with "ok"). ``keep``
    carries further columns (or expressions) through the same projection."""
    allowed = K.ALLOWED_EGRESS_SUFFIXES if allowed is None else allowed
    internal = K.INTERNAL_HOST_SUFFIXES if internal is None else internal
    cfg = cfg.withColumn("_mode", effective_mode(cfg))
    simulate = F.col("_mode") == "simulate"
    cfg = N.with_internal_flag(cfg, "llm_url", "_llm_internal", internal, True)
    cfg = cfg.withColumns({
        "_missing_ws": F.filter("apply_stages", lambda s: ~F.map_contains_key(F.col("workspaces"), s)),
        "_blocked": config_egress(config_endpoints(cfg), allowed),
    })
    # a configuration without these columns makes dry runs and has no tool servers
    has = lambda name, other: F.coalesce(F.col(name), other) if name in cfg.columns else other
    no_map = F.create_map().cast("map<string,string>")
    mcp_on = has("mcp_enabled", F.lit(False))
    not_internal = F.transform(F.filter(F.map_entries(has("mcp_servers", no_map)), lambda e: ~N.is_internal(e["value"], internal, True)), lambda e: e["key"])
    unreachable = F.transform(F.filter(F.map_entries(has("mcp_status", no_map)), lambda e: ~e["value"].startswith("reachable")), lambda e: e["key"])
    cfg = cfg.withColumns({"_not_internal": F.when(mcp_on & F.col("strict"), not_internal), "_unreachable": F.when(mcp_on, unreachable)})
    missing_ws, llm_ok_internal, blocked = F.col("_missing_ws"), F.col("_llm_internal"), F.col("_blocked")
    checks = [
        ("azure_devops", F.when(simulate, F.lit("ok(local_mock_present)")).otherwise(F.lit("ok"))),
        ("azure_repos", F.when(~has("checkout_exists", F.lit(True)), F.concat(F.lit("error(local_checkout_missing:"), has("checkout_path", F.lit("")), F.lit(")")))
         .when(has("dry_run", F.lit(True)), F.lit("ok(dry_run)"))
         .when(~has("is_work_tree", F.lit(True)), F.concat(F.lit("error(git_repo_check_failed:"), has("git_message", F.lit("")), F.lit(")")))
         .otherwise(F.lit("ok"))),
        ("azure_pipelines", F.when(simulate, F.lit("ok(simulate_mode)")).otherwise(F.lit("ok"))),
        ("databricks", F.when(F.size(missing_ws) > 0, F.concat(F.lit("error(missing_workspace_urls:"),
                                                                F.array_join(missing_ws, ","), F.lit(")")))
         .when(simulate, F.lit("ok(simulate_mode)")).otherwise(F.lit("ok"))),
        ("llm", F.when(~F.col("llm_enabled"), F.lit("ok(disabled)"))
         .when(F.coalesce(F.col("llm_url"), F.lit("")) == "", F.lit("error(llm_endpoint_missing)"))
         .when(F.col("strict") & ~llm_ok_internal, F.lit("error(llm_endpoint_not_internal)"))
         .otherwise(F.lit("ok"))),
        ("mcp", F.when(F.size("_not_internal") > 0, F.concat(F.lit("error(mcp_endpoints_not_internal:"), F.array_join("_not_internal", ","), F.lit(")")))
         .when(~mcp_on, F.lit("ok(disabled)"))
         .when(F.size("_unreachable") > 0, F.concat(F.lit("error(unreachable_servers:"), F.array_join("_unreachable", ","), F.lit(")")))
         .otherwise(F.lit("ok"))),
        ("security", F.when(~F.col("strict"), F.lit("ok(disabled)"))
         .when(F.col("_mode") != "connected", F.lit("error(strict_private_requires_connected_mode)"))
         .when(F.size(blocked) > 0, F.concat(F.lit("error(disallowed_egress_hosts:"), F.array_join(blocked, ","), F.lit(")")))
         .otherwise(F.lit("ok"))),
    ]
    entries = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("status")) for n, v in checks])
    return cfg.select(
        "config_id",
        F.map_from_entries(entries).alias("checks"),
        F.transform(F.filter(entries, lambda e: ~e["status"].startswith("ok")), lambda e: e["name"]).alias("failed"),
        "_blocked", *(keep or []),
    )


def missing_workspaces(cfg: DataFrame) -> DataFrame:
    """E12 per configuration: apply stages without a workspace URL."""
    return cfg.select("config_id", F.filter("apply_stages", lambda s: ~F.map_contains_key(F.col("workspaces"), s))
                      .alias("missing"))
