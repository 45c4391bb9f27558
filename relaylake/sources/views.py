"""Domain tables derived from the driver's parquet tables.

Each view is a deterministic projection of a real table, so its size grows
with the data (see FIXTURES.md section 3 for the binding). Every view is a
lazy DataFrame; nothing is materialised here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaylake import constants as K
from relaylake.functions import text as T
from relaylake.sources.tables import table

TICKET_CRITERIA = "Row counts match the source and keys stay unique."


def _case(col, mapping: list[tuple[object, str]], default: str):
    expr = None
    for value, out in mapping:
        expr = F.when(col == value, F.lit(out)) if expr is None else expr.when(col == value, F.lit(out))
    return expr.otherwise(F.lit(default))


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets: one per order (id, title, description, type, tags, criteria,
    priority, repo_name, state, project, changed_date)."""
    o = table(spark, sf_dir, "orders", spread=True)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    target = F.when(k % 4 != 0, F.concat(F.lit("main.bronze.cust_"), (c % 50).cast("string"))) \
        .otherwise(F.lit("customer data"))
    source = _case(k % 5, [(0, " from jdbc"), (1, " from flat file"), (2, " via edw and csv")], "")
    mode = _case(k % 3, [(0, " append"), (1, " overwrite")], "")
    repo_tag = F.concat(F.lit("repo:repo-"), (c % 7).cast("string"))
    tags = (F.when(k % 13 == 0, T.str_array(["bronze", "repo: ", "repo:late"]))
            .when(k % 6 != 0, F.array(F.lit("bronze"), repo_tag))
            .otherwise(T.str_array(["bronze"])))
    return o.select(
        k.alias("id"),
        F.concat(F.lit("Load "), target, source, mode).alias("title"),
        F.concat(F.lit("Ingest order "), k.cast("string"), F.lit(" of customer "), c.cast("string"),
                 F.lit(".")).alias("description"),
        _case(k % 3, [(0, K.WORK_ITEM_TYPES[0]), (1, K.WORK_ITEM_TYPES[1])], K.WORK_ITEM_TYPES[2]).alias("item_type"),
        tags.alias("tags"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.lit(TICKET_CRITERIA)).alias("acceptance_criteria"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.lit(None).cast("string").alias("repo_name"),
        _case(F.col("o_orderstatus"), [("F", "Closed"), ("O", "Active")], "New").alias("state"),
        F.concat(F.lit("p"), (c % 4).cast("string")).alias("project"),
        F.col("o_orderdate").alias("changed_date"),
        (c % 3).alias("cust_group"),
    )


def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only run ledger (run_key, status, seq): every ticket was started
    once; customers in groups 0 and 1 (custkey % 3) also finished, as
    succeeded and failed respectively."""
    w = work_items(spark, sf_dir)
    k, grp = F.col("id"), F.col("cust_group")
    started = F.struct(F.lit("in_progress").alias("status"), (k * 2).alias("seq"))
    finished = F.struct(F.when(grp == 0, F.lit("succeeded")).otherwise(F.lit("failed")).alias("status"),
                        (k * 2 + 1).alias("seq"))
    # both ledger rows of a ticket come from one scan and one hash
    events = F.when(grp < 2, F.array(started, finished)).otherwise(F.array(started))
    return w.select(T.run_key(k, F.col("title"), F.col("description")).alias("run_key"),
                    F.explode(events).alias("e")).select("run_key", "e.status", "e.seq")


TEAMS = 100


def stage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline runs per (ticket, stage, attempt) from lineitem.

    Line numbers go round the four stages (dev, qe, stg, prod), so every
    line is a run; attempt = order of the runs of one (order, stage) by
    (shipdate, partkey, suppkey, line number)."""
    li = table(spark, sf_dir, "lineitem").withColumn("_ord", ((F.col("l_linenumber") - 1) % len(K.STAGE_SEQUENCE) + 1).cast("int"))
    w = Window.partitionBy("l_orderkey", "_ord").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("work_item_id"),
        F.col("_ord").alias("ord"),
        F.get(T.str_array(K.STAGE_SEQUENCE), F.col("_ord") - 1).alias("environment"),
        F.row_number().over(w).alias("attempt"),
        _case(F.col("l_returnflag"), [("N", "succeeded"), ("A", "failed")], "partiallySucceeded").alias("status"),
        (F.col("l_linestatus") == "O").alias("fix_ok"),
        (F.col("l_suppkey") % TEAMS).alias("team"),
        F.col("l_shipdate").alias("started_at"),
        (F.col("l_quantity") * 60).cast("bigint").alias("duration_s"),
    )


GATE_EPOCH = "1995-01-01 00:00:00"  # the runs' dates; a second of the events' month is GATE_PACE there
GATE_PACE = 80


def gate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and check results by delivery team and stage, from events:
    ``decision`` (approved, actor, comment) or ``checks_passed``, with the time
    from which they hold until the next one."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    decides, checks = kind.isin("signup", "purchase", "error"), kind.isin("view", "click")
    seconds = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) * GATE_PACE
    return e.select(
        (F.col("user_id") % TEAMS).alias("team"),
        F.get(T.str_array(K.STAGE_SEQUENCE), (F.col("event_id") % 4).cast("int")).alias("environment"),
        (F.lit(GATE_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("since"),
        F.col("event_id").alias("seq"),
        F.when(decides, F.struct((kind != "error").alias("approved"), F.concat(F.lit("approver-"), (F.col("event_id") % 9).cast("string")).alias("actor"),
                                 F.coalesce("props", F.lit("")).alias("comment"))).alias("decision"),
        F.when(checks, F.col("value") < 20).alias("checks_passed"))


REPO_STEPS = ["checkout", "change", "tests", "pull request"]


def repo_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of the developer steps before a ticket's stages (work_item_id, step,
    status, detail, seq), from events: four events a ticket."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        F.expr("event_id div 4").alias("work_item_id"), F.get(T.str_array(REPO_STEPS), (k % 4).cast("int")).alias("step"),
        F.when((F.col("event_type") == "error") & (F.col("value") >= 100), F.lit("failed")).otherwise(F.lit("succeeded")).alias("status"),
        F.coalesce("props", F.lit("")).alias("detail"), k.alias("seq"))


def approval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only approval log from events: one request per (user, day)."""
    e = table(spark, sf_dir, "events")
    rid = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.dayofmonth("ts").cast("string"))
    return e.select(
        rid.alias("request_id"),
        F.get(T.str_array(K.STAGE_SEQUENCE), (F.col("user_id") % 4).cast("int")).alias("stage"),
        _case(F.col("event_type"), [("signup", "requested"), ("purchase", "approved"), ("error", "rejected")],
              "comment").alias("event"),
        F.when(F.col("event_id") % 50 == 0, F.lit("x"))
         .otherwise(F.concat(F.lit("approver-"), (F.col("event_id") % 9).cast("string"))).alias("actor"),
        F.col("props").alias("comment"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("work_item_id"),
        F.concat(F.lit("Approve deployment for work item "), F.col("user_id").cast("string")).alias("summary"),
    )


def learning_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome history from part: seq = partkey, source types by part type."""
    p = table(spark, sf_dir, "part")
    t = F.col("p_type")
    sources = (F.when(t == "PROMO", T.str_array(["jdbc"]))
               .when(t == "SMALL", T.str_array(["flat_file"]))
               .when(t == "LARGE", T.str_array(["jdbc", "flat_file"]))
               .otherwise(T.str_array(["unknown"])))
    return p.select(
        F.col("p_partkey").alias("work_item_id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 2 == 0, F.lit("succeeded")).otherwise(F.lit("failed")).alias("status"),
        F.concat(F.lit("wi_"), F.col("p_partkey").cast("string"), F.lit("_table")).alias("target_table"),
        sources.alias("source_types"),
        F.col("p_partkey").alias("seq"),
    )


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), "url")


ENDPOINT_SUFFIXES = [".example.org", ".example.net", "www.cheap-pills.example.com"]


def suffixes(spark: SparkSession, values: list[str] | None = None) -> DataFrame:
    """A configured allow-list as a small DataFrame (size fixed by config)."""
    vals = ENDPOINT_SUFFIXES if values is None else values
    return spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "ord int, suffix string")


# ---- source files: synthetic repository content from part ------------------
def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository files (repo, path, content) generated from part rows."""
    p = table(spark, sf_dir, "part", spread=True)
    k = F.col("p_partkey")
    ks = k.cast("string")
    kind = k % 4
    tbl = F.concat(F.lit("main.bronze.part_"), ks)
    etl = F.concat(
        F.lit('import pyspark\n\ndf = spark.read.table("raw.'), F.col("p_brand"), F.lit('")\n'),
        F.when(F.col("p_size") % 3 == 0,
               F.concat(F.lit('df.write.mode("overwrite")\n    .option("mergeSchema", "true").saveAsTable("'), tbl, F.lit('")\n')))
         .otherwise(F.lit("")),
        F.lit('df.write.mode("append").saveAsTable("'), tbl, F.lit('")\n'),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('df.write.mode( "overwrite" ) .saveAsTable("'), tbl, F.lit('_copy")\n')))
         .otherwise(F.lit("")),
    )
    sql = F.concat(
        F.when(F.col("p_size") % 5 == 0, F.lit("CREATE SCHEMA IF NOT EXISTS main.bronze;\n")).otherwise(F.lit("")),
        F.lit("CREATE TABLE IF NOT EXISTS "), tbl, F.lit(" AS SELECT '"), F.col("p_name"), F.lit("' AS name;\n"),
    )
    nb = F.concat(
        F.when(F.col("p_size") % 4 == 0, F.lit("#!/usr/bin/env python\n# -*- coding: utf-8 -*-\n")).otherwise(F.lit("")),
        F.lit("import os\n\nfrom pyspark.sql import functions as F\n"),
        F.when(F.col("p_size") % 6 == 0, F.concat(F.lit(K.NOTEBOOK_CONF_LINE), F.lit("\n"))).otherwise(F.lit("")),
        F.lit("# transform "), F.col("p_name"), F.lit("\ndf = spark.table(\""), tbl, F.lit("\")\n"),
    )
    tests = F.concat(F.lit("def test_part_"), ks, F.lit('():\n    assert "'), F.col("p_name"), F.lit('"\n'))
    path = (F.when(kind == 0, F.concat(F.lit("etl/load_"), ks, F.lit(".py")))
            .when(kind == 1, F.concat(F.lit("sql/create_"), ks, F.lit(".sql")))
            .when(kind == 2, F.concat(F.lit("notebooks/nb_"), ks, F.lit(".py")))
            .otherwise(F.concat(F.lit("tests/test_"), ks, F.lit(".py"))))
    content = (F.when(kind == 0, etl).when(kind == 1, sql).when(kind == 2, nb).otherwise(tests))
    return p.select(
        F.concat(F.lit("repo-"), (k % 7).cast("string")).alias("repo"),
        path.alias("path"),
        content.alias("content"),
    )


FAILURE_HINT_PHRASES = [
    "AnalysisException: schema mismatch on write",
    "Table or view not found: main.bronze.target",
    "cannot resolve column amount",
    "timeout while waiting for cluster",
]


def failure_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed pipeline runs with log bodies: document text plus a hint phrase."""
    d = table(spark, sf_dir, "documents", spread=True)
    k = F.col("doc_id")
    hint = F.get(T.str_array(FAILURE_HINT_PHRASES), (k % 4).cast("int"))
    return d.select(
        k.alias("run_id"),
        k.alias("work_item_id"),
        F.get(T.str_array(K.STAGE_SEQUENCE), (k % 4).cast("int")).alias("environment"),
        _case(k % 5, [(0, "succeeded"), (1, "Succeeded")], "failed").alias("status"),
        F.when(k % 10 == 9, F.lit("")).otherwise(
            F.concat(F.lit("http://localhost/pipelines/"), k.cast("string"), F.lit("/logs"))).alias("logs_url"),
        F.concat(F.col("text"), F.lit("\n"), hint).alias("log_body"),
    )


def _millis_text(ms):
    return F.concat((ms / 1000).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((ms % 1000).cast("string"), 3, "0"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines in the `ts | level | logger | message k=v ...` format from events."""
    e = table(spark, sf_dir, "events", spread=True)
    level = _case(F.col("event_type"), [("error", "ERROR"), ("click", "WARNING")], "INFO")
    logger = F.concat(F.lit("relay."), F.col("event_type"))
    op = F.concat(F.lit("op_"), (F.col("user_id") % 5).cast("string"))
    ms = F.round(F.col("value") * 1000).cast("bigint")
    finished = F.concat(F.lit("operation_finished name="), op, F.lit(" duration_seconds="), _millis_text(ms),
                        F.lit(" max_rss_kb="), (F.col("event_id") % 1000 + 1000).cast("string"))
    retry = F.concat(F.lit("operation_retry_failed name="), op, F.lit(" attempt="),
                     ((F.col("event_id") % 3) + 1).cast("string"), F.lit("/3 error=boom"))
    msg = (F.when(F.col("event_type") == "error", retry)
           .when(F.col("event_type") == "view", finished)
           .otherwise(F.concat(F.lit("event_seen user_id="), F.col("user_id").cast("string"))))
    return e.select(
        F.col("event_id").alias("line_no"),
        F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), level, logger, msg).alias("value"),
    )


def pipeline_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery configuration per customer (rule checks, endpoints)."""
    c = table(spark, sf_dir, "customer", spread=True)
    k = F.col("c_custkey")
    ks = k.cast("string")
    llm_url = (F.when(k % 4 == 0, F.lit(""))
               .when(k % 4 == 1, F.lit("http://llm.internal:8080/v1"))
               .when(k % 4 == 2, F.lit("https://api.example.com/v1"))
               .when(k % 16 == 7, F.concat(F.lit("http://[fd12:3456::"), F.hex(k % 65536), F.lit("]:8080/v1")))
               .when(k % 16 == 11, F.concat(F.lit("http://[2606:4700::"), F.hex(k % 65536), F.lit("]/v1")))
               .otherwise(F.lit("http://10.1.2.3/v1")))
    ws = F.when(k % 8 == 0, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("dev"), F.concat(F.lit("https://adb-"), ks, F.lit(".azuredatabricks.net"))))
    mcp = F.when(k % 6 == 0, F.create_map(F.lit("devops_mcp"), F.concat(F.lit("https://mcp-"), ks, F.lit(".example.org/api"))))\
        .when(k % 6 == 2, F.create_map(F.lit("devops_mcp"), F.lit("http://mcp.internal/api"), F.lit("docs_mcp"), F.lit("http://[fe80::7%eth0]/api")))\
        .otherwise(F.create_map().cast("map<string,string>"))
    pings = F.when(k % 6 == 2, F.create_map(F.lit("devops_mcp"), F.lit("reachable(tools=3)"), F.lit("docs_mcp"),
                                            F.when(k % 10 == 4, F.lit("unreachable(timeout)")).otherwise(F.lit("reachable(tools=1)"))))\
        .otherwise(F.create_map().cast("map<string,string>"))
    return c.select(
        k.alias("config_id"),
        F.when(k % 5 == 0, T.str_array(["dev", "qe", "prod"])).otherwise(T.str_array(K.STAGE_SEQUENCE)).alias("stage_sequence"),
        F.when(k % 7 == 0, T.str_array(["dev", "uat"])).otherwise(T.str_array(K.APPLY_STAGES)).alias("apply_stages"),
        T.str_array(K.APPROVAL_STAGES).alias("approval_stages"),
        (k % 4).cast("int").alias("retry_attempts"),
        (F.col("c_acctbal") / 1000).alias("retry_initial"),
        F.lit(8.0).alias("retry_max"),
        F.when(k % 11 == 0, F.lit(0.5)).otherwise(F.lit(2.0)).alias("backoff"),
        F.when(k % 13 == 0, F.lit(-1)).otherwise(F.lit(2)).alias("max_remediation"),
        F.when(k % 3 == 0, F.lit("simulate")).otherwise(F.lit("connected")).alias("mode"),
        (k % 2 == 0).alias("strict"),
        (k % 3 == 1).alias("llm_enabled"),
        llm_url.alias("llm_url"),
        F.when(k % 9 == 0, T.str_array(["  ", ""])).otherwise(T.str_array(K.PLUGIN_ORDER)).alias("plugins"),
        ws.alias("workspaces"),
        mcp.alias("mcp_servers"),
        (k % 5 < 3).alias("mcp_enabled"),
        pings.alias("mcp_status"),
        F.concat(F.lit("checkouts/repo-"), (k % 9).cast("string")).alias("checkout_path"),
        (k % 9 < 7).alias("checkout_exists"),
        (k % 4 != 1).alias("dry_run"),
        (k % 7 != 3).alias("is_work_tree"),
        F.lit("fatal: not a git repository").alias("git_message"),
        F.lit("https://dev.azure.com/org").alias("devops_url"),
        F.lit("https://dev.azure.com/org").alias("pipelines_url"),
        F.when(k % 10 == 0, F.lit("git.corp.example.com:7999/scm")).otherwise(F.lit("https://dev.azure.com/org")).alias("repos_url"),
    )
