"""Endpoints: host parsing twin, suffix rules, private IP ranges, egress."""

import ipaddress
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import network as N
from relaylake.operators import endpoints as EP

URLS = [
    "https://Dev.Azure.com/org/x", "http://user:pw@Host.Example.org:8080/p?q=1#f", "example.com/path",
    "localhost:3001", "//cdn.example.net/a", "http://[::1]:8000/", "http://10.0.0.1/x", "mailto:x@y.org",
    "", "http://", "ftp://files.corp/x", "  https://lead.example.org", "h_s.example.com/x",
]


def py_hostname(url):
    """Our twin of the scheme-less retry: Python's urlparse decides."""
    p = urlparse(url)
    if p.hostname is None and "://" not in url and not url.startswith("//"):
        p = urlparse("http://" + url)
    return (p.hostname or "").strip().lower() or None


def test_hostname_matches_python(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r.url: r.h for r in df.select("url", N.hostname(F.col("url")).alias("h")).collect()}
    for u in URLS:
        assert got[u] == py_hostname(u), u


def test_suffix_rules(spark):
    df = spark.createDataFrame([("a.x.org",), ("x.org",), ("X.ORG",), ("",)], "host string")
    got = {r.host: r.m for r in df.select("host", N.matches_suffixes(F.col("host"), [".x.org"]).alias("m")).collect()}
    assert got == {"a.x.org": True, "x.org": False, "X.ORG": False, "": False}
    got2 = {r.host: r.m for r in df.select("host", N.matches_suffixes(F.col("host"), ["x.org"]).alias("m")).collect()}
    assert got2["x.org"] is True and got2["a.x.org"] is False


@pytest.mark.parametrize("ip,expected", [
    ("10.0.0.1", True), ("127.0.0.1", True), ("169.254.0.1", True), ("240.0.0.1", True),
    ("100.64.0.1", False), ("8.8.8.8", False), ("192.0.0.9", False), ("192.168.1.1", True), ("01.2.3.4", False),
])
def test_internal_ips(spark, ip, expected):
    df = spark.createDataFrame([(f"http://{ip}/x",)], "url string")
    got = df.select(N.is_internal(F.col("url"), [], True).alias("i")).first().i
    if expected and ip.count(".") == 3 and not ip.startswith("0"):
        a = ipaddress.ip_address(ip)
        assert a.is_private or a.is_loopback or a.is_link_local or a.is_reserved
    assert got is expected


def test_internal_ipv6_and_names(spark):
    urls = ["http://[::1]/", "http://svc.internal/", "svc.internal", "http://[2001:4860::8888]/", "http://[fd00::1]:80/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.i for r in N.with_internal_flag(df, "url", "i", K.INTERNAL_HOST_SUFFIXES, True).collect()}
    assert [got[u] for u in urls] == [True, True, False, False, True]


V6 = ["::1", "::", "fe80::1", "fe80::1%eth0", "fe80::1%", "fc00::", "fdff:1::2", "2001:db8::8", "2001:4860:4860::8888", "2606:4700::1111", "::ffff:10.0.0.1",
      "::ffff:8.8.8.8", "::ffff:a00:1", "64:ff9b::808:808", "64:ff9b:1::1", "100::1", "100:0:0:1::1", "2001::1", "2001:1::1", "2001:1::3", "2001:3::1", "2001:20::1",
      "2001:30::9", "2002::1", "3ffe::1", "ff02::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1::2", "1::2:", "12345::1",
      "g::1", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.400", "::01.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "4000::1", "5fff::1", "e000::1", "fec0::1",
      "2001:4:112::1", "2001:2::1", "2001:200::1", "ABCD::1", "FD00::AB"]


def test_ipv6_literals_follow_the_standard_library(spark):
    df = spark.createDataFrame([(f"http://[{a}]/x",) for a in V6], "url string")
    got = {r.url: (r.a, r.b) for r in N.with_internal_flag(df, "url", "a", [], True).withColumn("b", N.is_internal(F.col("url"), [], True)).collect()}
    for a in V6:
        try:
            ip = ipaddress.ip_address(a)
            want = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved
        except ValueError:
            want = False
        assert got[f"http://[{a}]/x"] == (want, want), a


def test_repository_and_tool_server_checks(spark):
    c = cfg_rows(spark).where("config_id = 1").crossJoin(spark.createDataFrame(
        [(1, True, True, False, True, {"a": "http://x.internal/", "b": "http://[2606:4700::1]/"}, {}),
         (2, True, False, True, True, {"a": "http://[fd00::1]/"}, {"a": "reachable(1)", "z": "timeout"}),
         (3, False, False, True, False, {"b": "https://b.org/"}, {"b": "timeout"}),
         (4, True, False, False, True, {}, {})],
        "n int, checkout_exists boolean, dry_run boolean, is_work_tree boolean, mcp_enabled boolean, servers map<string,string>, mcp_status map<string,string>"))
    c = c.withColumns({"mcp_servers": F.col("servers"), "checkout_path": F.lit("co/x"), "git_message": F.lit("no repo"), "config_id": F.col("n").cast("long")})
    got = {r.config_id: (r.checks["azure_repos"], r.checks["mcp"]) for r in EP.readiness(c).collect()}
    assert got == {1: ("ok(dry_run)", "error(mcp_endpoints_not_internal:b)"), 2: ("ok", "error(unreachable_servers:z)"),
                   3: ("error(local_checkout_missing:co/x)", "ok(disabled)"), 4: ("error(git_repo_check_failed:no repo)", "ok")}


def test_egress_fail_closed(spark):
    df = spark.createDataFrame([("http://",), ("https://dev.azure.com/org",), ("https://evil.example.com",), ("",)], "url string")
    got = sorted(r.violation for r in EP.egress_violations(df, K.ALLOWED_EGRESS_SUFFIXES).collect())
    assert got == ["evil.example.com", "http://"]


def test_suffix_anti_join_equals_rule(spark):
    hosts = spark.createDataFrame([("a.x.org",), ("x.org",), ("b.y.net",), ("y.net",), ("z.com",)], "host string")
    suf = spark.createDataFrame([(".x.org",), ("y.net",), ("",)], "suffix string")
    left = sorted(r.host for r in EP.suffix_anti_join(hosts, suf).collect())
    assert left == ["b.y.net", "x.org", "z.com"]


CFG_SCHEMA = ("config_id long, stage_sequence array<string>, apply_stages array<string>, approval_stages array<string>, "
              "retry_attempts int, retry_initial double, retry_max double, backoff double, max_remediation int, mode string, "
              "strict boolean, llm_enabled boolean, llm_url string, plugins array<string>, workspaces map<string,string>, "
              "mcp_servers map<string,string>, devops_url string, pipelines_url string, repos_url string")


def cfg_rows(spark):
    good = (1, ["dev", "qe"], ["dev"], ["qe"], 3, 1.0, 8.0, 2.0, 2, "connected", True, True, "http://llm.internal/v1",
            ["sql"], {"dev": "https://a.azuredatabricks.net"}, {}, "https://dev.azure.com/o", "https://dev.azure.com/o",
            "https://dev.azure.com/o")
    bad = (2, ["dev"], ["dev", "uat", "uat"], ["qe", "prod"], 0, 0.0, 8.0, 0.5, -1, "simulate", True, True, "",
           [" ", ""], {}, {}, "https://dev.azure.com/o", "https://evil.example.com", "host-only")
    return spark.createDataFrame([good, bad], CFG_SCHEMA)


def test_config_rules(spark):
    c = cfg_rows(spark)
    got = {r.config_id: r.e for r in c.select("config_id", EP.config_errors(c).alias("e")).collect()}
    assert got[1] == []
    assert got[2] == [
        "At least one Databricks workspace URL must be configured.",
        "transformers.enabled_plugins must include at least one plugin name.",
        "workflow.databricks_apply_in_stages must be subset of workflow.stage_sequence. Invalid stages: ['uat']",
        "workflow.hil_approval_stages must be subset of workflow.stage_sequence. Invalid stages: ['prod', 'qe']",
        "runtime.retry_attempts must be at least 1.",
        "runtime.retry_initial_delay_seconds must be greater than 0.",
        "runtime.retry_backoff_multiplier must be >= 1.",
        "runtime.max_failure_remediation_attempts must be >= 0.",
        "security.strict_private_mode requires integration_mode='connected' so the agent runs with real enterprise integrations.",
        "security.strict_private_mode with llm_enabled=true requires prompts.llm_endpoint_url.",
    ]


def test_readiness(spark):
    c = cfg_rows(spark)
    got = {r.config_id: (r.checks, r.failed) for r in EP.readiness(c).collect()}
    checks1, failed1 = got[1]
    assert failed1 == [] and checks1["security"] == "ok" and checks1["llm"] == "ok"
    checks2, failed2 = got[2]
    assert checks2["databricks"] == "error(missing_workspace_urls:dev,uat,uat)"
    assert checks2["llm"] == "error(llm_endpoint_missing)"
    assert checks2["security"] == "error(strict_private_requires_connected_mode)"
    assert failed2 == ["databricks", "llm", "security"]
    blocked = c.select("config_id", EP.config_egress(EP.config_endpoints(c), K.ALLOWED_EGRESS_SUFFIXES).alias("b")).collect()
    assert {r.config_id: r.b for r in blocked} == {1: [], 2: ["evil.example.com", "host-only"]}


def test_local_mode_alias(spark):
    c = cfg_rows(spark).withColumn("local_mode", F.when(F.col("config_id") == 1, F.lit(True)))
    got = {r.config_id: r.checks for r in EP.readiness(c).collect()}
    assert got[1]["azure_pipelines"] == "ok(simulate_mode)"          # alias wins over mode=connected
    assert got[1]["security"] == "error(strict_private_requires_connected_mode)"
    assert got[2]["azure_pipelines"] == "ok(simulate_mode)"          # no alias: mode column
    errs = {r.config_id: r.e for r in c.select("config_id", EP.config_errors(c).alias("e")).collect()}
    assert any(e.startswith("security.strict_private_mode requires") for e in errs[1])
