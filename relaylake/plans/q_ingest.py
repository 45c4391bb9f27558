"""Registered queries: scans, bronze writes and the bronze load.

Each query writes data Spark derived from a test table into the shared
scratch folder (under ``spark.checkpoint.dir``), reads it back through the
operator under test and returns the result; the oracle computes the same
rows directly from the source table (round-trip equality).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake.operators import intake, learning
from relaylake.operators import quality as Q
from relaylake.plans.sqlviews import with_views
from relaylake.session import scratch_path
from relaylake.sinks import bronze
from relaylake.sources import files, views
from relaylake.sources.tables import table

DOC_ENTRIES = 1000  # most entries in a document of a state table, however large the table is
DOC_BUCKETS = 64  # folders that container files are dealt over

QUERIES: dict = {}
ORACLE: dict = {}


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"relaylake-io/{name}-{uuid.uuid4().hex[:12]}")


# ---- A1 + C1 -----------------------------------------------------------------
def q_ticket_json_scan(spark, sf):
    w = views.work_items(spark, sf)
    i = F.col("id")
    out = w.select(
        "id", "title",
        F.when(i % 9 == 0, None).otherwise(F.col("description")).alias("description"),
        F.when(i % 17 == 0, None).otherwise(F.col("item_type")).alias("item_type"),
        F.when(i % 10 == 0, None).otherwise(F.col("tags")).alias("tags"),
        "acceptance_criteria",
        F.when(i % 11 == 0, None).otherwise(F.col("priority")).alias("priority"),
        F.when(i % 23 == 0, F.lit(" repo-x ")).alias("repo_name"),
        F.when(i % 8 == 0, None).otherwise(F.col("state")).alias("state"),
    )
    path = _scratch(spark, "tickets")
    out.write.json(path)  # null fields are omitted from the documents
    t = intake.normalize_tickets(files.read_tickets(spark, path, multiline=False))
    return t.select("id", "title", "description", "item_type", F.array_join("tags", ",").alias("tags"),
                    "acceptance_criteria", "priority", "repo_name", "state")


QUERIES["ticket_json_scan"] = q_ticket_json_scan
ORACLE["ticket_json_scan"] = with_views(["work_items"], """
SELECT id, title, CASE WHEN id % 9 = 0 THEN '' ELSE description END AS description,
  CASE WHEN id % 17 = 0 THEN 'User Story' ELSE item_type END AS item_type,
  CASE WHEN id % 10 = 0 THEN '' ELSE array_to_string(tags, ',') END AS tags,
  acceptance_criteria, CASE WHEN id % 11 = 0 THEN 9999 ELSE priority END AS priority,
  CASE WHEN id % 23 = 0 THEN 'repo-x' WHEN id % 10 = 0 THEN NULL
       ELSE nullif(trim(substr(trim(list_filter(tags, lambda t: starts_with(lower(trim(t)), 'repo:'))[1]), 6)), '') END AS repo_name,
  CASE WHEN id % 8 = 0 THEN 'Active' ELSE state END AS state
FROM work_items""")


# ---- A2 ----------------------------------------------------------------------
def board_payloads(spark, sf, *by):
    """Board payloads of the tickets, one per 100 ids (and value of ``by``):
    each holds at most 100 items."""
    w = views.work_items(spark, sf)
    i = F.col("id")
    fields = F.map_filter(F.create_map(
        F.lit("System.Id"), i.cast("string"),
        F.lit("System.Title"), F.col("title"),
        F.lit("System.Description"), F.col("description"),
        F.lit("System.WorkItemType"), F.when(i % 17 == 0, F.lit("Epic")).otherwise(F.col("item_type")),
        F.lit("System.State"), F.col("state"),
        F.lit("System.Tags"), F.array_join("tags", "; "),
        F.lit("Microsoft.VSTS.Common.AcceptanceCriteria"), F.col("acceptance_criteria"),
        F.lit("Microsoft.VSTS.Common.Priority"), F.when(i % 11 == 0, None).otherwise(F.col("priority").cast("string")),
    ), lambda k, v: v.isNotNull())
    keys = [c.alias(f"by{n}") for n, c in enumerate(by)]
    return w.select((i / 100).cast("bigint").alias("batch"), *keys, F.struct(i.alias("id"), fields.alias("fields")).alias("item")) \
        .groupBy("batch", *[f"by{n}" for n in range(len(by))]).agg(F.count(F.lit(1)).alias("count"), F.collect_list("item").alias("value")).drop("batch")


def q_board_payload_scan(spark, sf):
    path = _scratch(spark, "board")
    board_payloads(spark, sf).write.json(path)
    t = intake.normalize_tickets(files.read_board_payload(spark, path, multiline=False), strict_types=False)
    return t.select("id", "title", "item_type", F.array_join("tags", ",").alias("tags"), "priority", "repo_name")


QUERIES["board_payload_scan"] = q_board_payload_scan
ORACLE["board_payload_scan"] = with_views(["work_items"], """
SELECT id, title, CASE WHEN id % 17 = 0 THEN 'User Story' ELSE item_type END AS item_type,
  array_to_string(list_filter(list_transform(tags, lambda t: trim(t)), lambda t: t <> ''), ',') AS tags,
  CASE WHEN id % 11 = 0 THEN 9999 ELSE priority END AS priority,
  nullif(trim(substr(list_filter(list_transform(tags, lambda t: trim(t)), lambda t: starts_with(lower(t), 'repo:'))[1], 6)), '') AS repo_name
FROM work_items""")


# ---- A4 / B9 -----------------------------------------------------------------
def in_documents(spark: SparkSession, rows: DataFrame, entries: int, name: str = "doc_entries") -> DataFrame:
    """All rows as ``entries``, a list of at most that many a document. A row's
    number in its partition names its document; the numbers are written with
    the rows, so that a task run again finds the same."""
    path = _scratch(spark, name)
    numbered = rows.select(F.monotonically_increasing_id().alias("n"), F.struct("*").alias("entry"))
    numbered.write.parquet(path)
    block = [F.shiftright("n", 33).alias("part"), F.expr(f"(n & {(1 << 33) - 1}) div {entries}").alias("block")]
    return spark.read.schema(numbered.schema).parquet(path).groupBy(*block).agg(F.collect_list("entry").alias("entries")).select("entries")


def q_history_scan(spark, sf, entries=DOC_ENTRIES):
    """A4: the whole history written as ``{"records": [...]}`` documents (of at
    most ``entries`` records) and read back."""
    rec = views.learning_history(spark, sf).select("work_item_id", "title", "status", "target_table", "source_types",
                                                   F.lit(None).cast("string").alias("created_at"))
    doc = in_documents(spark, rec, entries).withColumnRenamed("entries", "records")
    path = _scratch(spark, "history")
    doc.write.json(path)
    h = files.read_history_doc(spark, path, multiline=False)
    return h.select("work_item_id", "title", "status", "target_table", F.array_join("source_types", ",").alias("source_types"))


QUERIES["history_scan"] = q_history_scan
ORACLE["history_scan"] = with_views(["learning_history"], """
SELECT work_item_id, title, status, target_table, array_to_string(source_types, ',') AS source_types
FROM learning_history""")


# ---- A11 + C27 ---------------------------------------------------------------
def q_log_scan(spark, sf):
    path = _scratch(spark, "logs")
    views.log_lines(spark, sf).select("value").write.text(path)
    logs = files.read_logs(spark, path)
    return logs.select("ts", "level", "logger", "event",
                       F.array_join(F.transform("kv", lambda p: F.concat(p["k"], F.lit("="), p["v"])), ";").alias("kv"))


LOG_RE = r"^(\S+) \| (\w+) \| ([^|]+?) \| (\S+)(.*)$"

QUERIES["log_scan"] = q_log_scan
ORACLE["log_scan"] = with_views(["log_lines"], f"""
SELECT strptime(regexp_extract(value, '{LOG_RE}', 1), '%Y-%m-%dT%H:%M:%S') AS ts,
  regexp_extract(value, '{LOG_RE}', 2) AS level, regexp_extract(value, '{LOG_RE}', 3) AS logger,
  regexp_extract(value, '{LOG_RE}', 4) AS event,
  array_to_string(regexp_extract_all(regexp_extract(value, '{LOG_RE}', 5), '(\\w+)=(\\S+)', 0), ';') AS kv
FROM log_lines""")


# ---- A8 ----------------------------------------------------------------------
CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def customer_csv(spark: SparkSession, sf: str) -> str:
    """Customer rows as CSV text with malformed records mixed in: a
    non-numeric key (custkey % 17 = 0), missing fields (% 19 = 0), a
    non-numeric balance (% 23 = 0)."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    key = F.when(k % 17 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string"))
    bal = F.when(k % 23 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    line = F.when(k % 19 == 0, F.concat_ws(",", key, F.col("c_name"), F.col("c_nationkey").cast("string"))) \
        .otherwise(F.concat_ws(",", key, F.col("c_name"), F.col("c_nationkey").cast("string"), bal, F.col("c_mktsegment")))
    path = _scratch(spark, "customer_csv")
    c.select(line.alias("value")).write.text(path)
    return path


def q_csv_quarantine(spark, sf):
    good, _ = files.read_delimited(spark, customer_csv(spark, sf), CUSTOMER_SCHEMA, _scratch(spark, "customer_stage"))
    return good


GOOD_SQL = "c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 23 <> 0"

QUERIES["csv_quarantine"] = q_csv_quarantine
ORACLE["csv_quarantine"] = f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE {GOOD_SQL}"


def q_csv_quarantine_bad(spark, sf):
    _, bad = files.read_delimited(spark, customer_csv(spark, sf), CUSTOMER_SCHEMA, _scratch(spark, "customer_stage"))
    return bad.select(F.split("_corrupt_record", ",")[0].alias("key_text"), "c_name",
                      F.size(F.split("_corrupt_record", ",")).alias("n_fields"))


QUERIES["csv_quarantine_bad"] = q_csv_quarantine_bad
ORACLE["csv_quarantine_bad"] = f"""
SELECT CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE '' END || CAST(c_custkey AS VARCHAR) AS key_text, c_name,
  CASE WHEN c_custkey % 19 = 0 THEN 3 ELSE 5 END AS n_fields
FROM customer WHERE NOT ({GOOD_SQL})"""


# ---- B2 ----------------------------------------------------------------------
def q_overwrite_dedup(spark, sf):
    o = table(spark, sf, "orders")
    path = _scratch(spark, "orders_bronze")
    bronze.write_bronze(o, path, "overwrite", ["o_orderstatus"])
    batch = o.where(F.col("o_orderstatus") == "P")
    bronze.overwrite_partitions(batch.unionByName(batch), path, ["o_orderkey"], ["o_orderstatus"])
    back = spark.read.parquet(path)
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_orderkey").alias("n_keys"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))


QUERIES["overwrite_dedup"] = q_overwrite_dedup
ORACLE["overwrite_dedup"] = """SELECT o_orderstatus, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS total FROM orders GROUP BY o_orderstatus"""


# ---- B3 ----------------------------------------------------------------------
def q_schema_evolve(spark, sf):
    n = table(spark, sf, "nation")
    path = _scratch(spark, "nation_bronze")
    bronze.append_evolving(n.select("n_nationkey", "n_name"), path)
    bronze.append_evolving(n.select("n_nationkey", "n_name", "n_regionkey"), path)
    return bronze.read_evolving(spark, path).select("n_nationkey", "n_name", "n_regionkey")


QUERIES["schema_evolve"] = q_schema_evolve
ORACLE["schema_evolve"] = """SELECT n_nationkey, n_name, CAST(NULL AS INTEGER) AS n_regionkey FROM nation
UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation"""


# ---- B4 + B1 + Q checks: P4 --------------------------------------------------
def bronze_load(spark: SparkSession, sf: str, mode: str = "overwrite") -> DataFrame:
    """Create namespace and table → ingest the flat file (quarantining
    malformed rows) with the plan's mode → run the load checks."""
    base = _scratch(spark, "bronze_db")
    tag = uuid.uuid4().hex[:8]
    schema_name, tbl = f"relaylake_bronze_{tag}", "customer"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema_name} LOCATION '{base}'")
    bronze.bootstrap(spark, schema_name, tbl, CUSTOMER_SCHEMA, f"{base}/{tbl}")
    good, bad = files.read_delimited(spark, customer_csv(spark, sf), CUSTOMER_SCHEMA, _scratch(spark, "customer_stage"))
    good.write.mode(mode).insertInto(f"{schema_name}.{tbl}", overwrite=(mode == "overwrite"))
    landed = spark.table(f"{schema_name}.{tbl}")
    nation = table(spark, sf, "nation")
    checks = (Q.row_count_non_zero(landed, "customer")
              .unionByName(Q.row_rules(landed, "customer", [Q.not_null("c_custkey"), Q.not_null("c_nationkey")]))
              .unionByName(Q.unique(landed, "customer", ["c_custkey"]))
              .unionByName(Q.foreign_key(landed, "c_nationkey", nation, "n_nationkey", "customer")))
    quarantined = bad.agg(F.count(F.lit(1)).alias("failed")).select(
        F.lit("quarantined_records").alias("check"), F.lit("customer").alias("subject"), "failed",
        F.lit(True).alias("passed"), F.lit("info").alias("severity"))
    return checks.unionByName(quarantined)


def q_bronze_load(spark, sf):
    return bronze_load(spark, sf)


QUERIES["bronze_load"] = q_bronze_load
ORACLE["bronze_load"] = f"""
WITH landed AS (SELECT * FROM customer WHERE {GOOD_SQL})
SELECT 'row_count_non_zero' AS "check", 'customer' AS subject, CAST(CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS BIGINT) AS failed,
  count(*) > 0 AS passed, 'critical' AS severity FROM landed
UNION ALL SELECT 'not_null:c_custkey', 'customer', count(*) FILTER (WHERE c_custkey IS NULL), count(*) FILTER (WHERE c_custkey IS NULL) = 0, 'critical' FROM landed
UNION ALL SELECT 'not_null:c_nationkey', 'customer', count(*) FILTER (WHERE c_nationkey IS NULL), count(*) FILTER (WHERE c_nationkey IS NULL) = 0, 'critical' FROM landed
UNION ALL SELECT 'unique:c_custkey', 'customer', count(*), count(*) = 0, 'critical' FROM (SELECT c_custkey FROM landed GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'fk:c_nationkey->n_nationkey', 'customer', count(*), count(*) = 0, 'critical'
  FROM landed WHERE c_nationkey IS NOT NULL AND c_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'quarantined_records', 'customer', count(*), true, 'info' FROM customer WHERE NOT ({GOOD_SQL})"""


# ---- A6 ----------------------------------------------------------------------
def q_file_corpus(spark, sf):
    """Repository files read back through the binaryFile scan.

    The files derived from ``part`` are packed into container files, one JSON
    record a line, dealt over ``DOC_BUCKETS`` folders by repository and path;
    the scan reads every container recursively and keeps valid UTF-8 only."""
    from relaylake.sources import views as V
    base = _scratch(spark, "corpus")
    src = V.source_files(spark, sf).select("repo", "path", "content")
    src.select(F.to_json(F.struct("repo", "path", "content")).alias("value"),
               F.pmod(F.xxhash64("repo", "path"), F.lit(DOC_BUCKETS)).alias("bucket")).write.partitionBy("bucket").text(base)
    lines = files.read_source_files(spark, base, "*.txt").select(F.explode(F.split("content", "\n", -1)).alias("line"))
    record = F.from_json("line", "repo string, path string, content string")
    return lines.where(F.col("line") != "").select(record.alias("r")).select("r.repo", "r.path", "r.content")


QUERIES["file_corpus"] = q_file_corpus
ORACLE["file_corpus"] = with_views(["source_files"], "SELECT repo, path, content FROM source_files")


# ---- A5 / A3: state documents, cut so no document grows with the data -------
def q_ledger_scan(spark, sf, entries=DOC_ENTRIES):
    """A5: the run ledger's latest state written as ``{"runs": {key: {status}}}``
    documents (of at most ``entries`` runs) and read back."""
    from relaylake.operators import intake as I
    latest = I.latest_run_status(views.run_ledger(spark, sf))
    docs = in_documents(spark, latest.select("run_key", F.struct("status").alias("v")), entries).select(F.map_from_entries("entries").alias("runs"))
    path = _scratch(spark, "ledger_docs")
    docs.write.json(path)
    return files.read_ledger_doc(spark, path, multiline=False)


QUERIES["ledger_scan"] = q_ledger_scan
ORACLE["ledger_scan"] = with_views(["run_ledger"], "SELECT run_key, arg_max(status, seq) AS status FROM run_ledger GROUP BY run_key")


def state_documents(spark, sf, entries):
    """Approval requests and clarifications written as state documents of at
    most ``entries`` of either, each with one of the two lists only (a missing
    list reads as empty), and read back. A clarification with many questions
    goes on in further entries of its request."""
    from relaylake.operators import approvals as A
    from relaylake.operators import clarify as C
    from relaylake.plans.q_clarify import pairs
    st = A.latest_state(views.approval_events(spark, sf))
    row = st.select("request_id", "stage", "summary", "status", "approver", F.lit(None).cast("string").alias("comment"),
                    F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
                    F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"))
    docs = in_documents(spark, row, entries).withColumnRenamed("entries", "requests")
    path = _scratch(spark, "approval_docs")
    docs.write.json(path)
    pr = pairs(spark, sf)
    clr = C.clarification_entries(C.answered_questions(pr), C.requests(pr))
    more = _scratch(spark, "clarification_docs")
    in_documents(spark, clr, entries, "clarification_entries").withColumnRenamed("entries", "clarifications").write.json(more)
    return files.read_approvals_doc(spark, [path, more], multiline=False)


def q_state_doc_scan(spark, sf, entries=DOC_ENTRIES):
    """A3: the approval requests of the state documents."""
    reqs, _ = state_documents(spark, sf, entries)
    return reqs.select("request_id", "stage", "status", "approver", "created_at")


def q_clarification_doc_scan(spark, sf, entries=DOC_ENTRIES):
    """A3: the clarifications of the state documents, one row per question."""
    _, clrs = state_documents(spark, sf, entries)
    rows = clrs.select("request_id", "work_item_id", "status", "requester", "responder", "answers", F.explode("questions").alias("question"))
    return rows.select("request_id", "work_item_id", "status", "requester", "responder", "question", F.try_element_at("answers", F.col("question")).alias("answer"))


QUERIES["state_doc_scan"] = q_state_doc_scan


def _state_doc_sql():
    from relaylake.plans.q_approvals import STATE_CTES
    return with_views(["approval_events"], """SELECT request_id, stage, status, approver,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM state""", extra=STATE_CTES)


ORACLE["state_doc_scan"] = _state_doc_sql()


QUERIES["clarification_doc_scan"] = q_clarification_doc_scan


def _clarification_doc_sql():
    from relaylake.plans.q_clarify import PAIR_CTES
    return with_views([], """SELECT c.request_id, c.work_item_id, c.status, 'agent' AS requester,
  CASE WHEN c.status = 'answered' THEN 'conversation' END AS responder, p.question,
  arg_max(p.answer, p.turn) FILTER (WHERE p.answer IS NOT NULL) AS answer
FROM pairs p JOIN creq c ON c.work_item_id = p.conv_id WHERE p.question IS NOT NULL
GROUP BY c.request_id, c.work_item_id, c.status, p.question""", extra=PAIR_CTES)


ORACLE["clarification_doc_scan"] = _clarification_doc_sql()
