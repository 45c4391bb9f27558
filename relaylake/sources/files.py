"""File scans: ticket JSON, board payloads, state documents, logs, source
files, delimited files with malformed records (A1-A6, A8, A11).

All readers take an explicit schema (nothing is inferred), so the scan is a
single pass and its columns are pruned by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylake import constants as K
from relaylake.functions import text as X

TICKET_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("item_type", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("acceptance_criteria", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("repo_name", T.StringType()),
    T.StructField("state", T.StringType()),
])

BOARD_FIELDS = {
    "id": "System.Id", "title": "System.Title", "description": "System.Description",
    "item_type": "System.WorkItemType", "state": "System.State", "tags": "System.Tags",
    "acceptance_criteria": "Microsoft.VSTS.Common.AcceptanceCriteria",
    "priority": "Microsoft.VSTS.Common.Priority",
}
BOARD_SCHEMA = "count bigint, value array<struct<id: bigint, fields: map<string, string>>>"

HISTORY_SCHEMA = ("records array<struct<work_item_id: bigint, title: string, status: string, "
                  "target_table: string, source_types: array<string>, created_at: string>>")
LEDGER_SCHEMA = "runs map<string, struct<status: string>>"
APPROVALS_DOC_SCHEMA = (
    "requests array<struct<request_id: string, stage: string, summary: string, status: string, approver: string, "
    "comment: string, created_at: string, updated_at: string>>, "
    "clarifications array<struct<request_id: string, work_item_id: bigint, work_item_title: string, "
    "questions: array<string>, status: string, answers: map<string, string>, requester: string, responder: string, "
    "created_at: string, updated_at: string>>, last_answers map<string, string>, last_request_id string")


def read_tickets(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A1: tickets from JSON files (top-level arrays when ``multiline``, or
    JSON lines). A missing path yields an empty frame, not an error."""
    try:
        return spark.read.schema(TICKET_SCHEMA).option("multiLine", multiline).json(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return spark.createDataFrame([], TICKET_SCHEMA)
        raise


def read_board_payload(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A2: nested board payloads ``{"value": [{"fields": {...}}]}`` →
    ticket rows; tags split on ';', trimmed, blanks dropped; unknown type →
    default type; missing priority → 9999."""
    return board_items(spark.read.schema(BOARD_SCHEMA).option("multiLine", multiline).json(path))


def board_items(payloads: DataFrame, *more: str) -> DataFrame:
    """The tickets of parsed payloads (``value``), and the columns named."""
    f = F.col("v.fields")
    tags = F.filter(F.transform(F.split(F.coalesce(f[BOARD_FIELDS["tags"]], F.lit("")), ";"), lambda t: X.strip(t)),
                    lambda t: t != "")
    return payloads.select(*more, F.explode("value").alias("v")).select(
        *more,
        f[BOARD_FIELDS["id"]].cast("bigint").alias("id"),
        F.coalesce(f[BOARD_FIELDS["title"]], F.lit("")).alias("title"),
        F.coalesce(f[BOARD_FIELDS["description"]], F.lit("")).alias("description"),
        f[BOARD_FIELDS["item_type"]].alias("item_type"),
        tags.alias("tags"),
        F.coalesce(f[BOARD_FIELDS["acceptance_criteria"]], F.lit("")).alias("acceptance_criteria"),
        F.coalesce(f[BOARD_FIELDS["priority"]].cast("int"), F.lit(K.DEFAULT_PRIORITY)).alias("priority"),
        F.coalesce(f[BOARD_FIELDS["state"]], F.lit(K.DEFAULT_STATE)).alias("state"),
    )


def read_history_doc(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A4: learning-history documents ``{"records": [...]}`` → rows."""
    doc = spark.read.schema(HISTORY_SCHEMA).option("multiLine", multiline).json(path)
    return doc.select(F.inline(F.coalesce("records", F.array().cast(
        "array<struct<work_item_id: bigint, title: string, status: string, target_table: string, "
        "source_types: array<string>, created_at: string>>"))))


def read_ledger_doc(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A5: run-ledger documents ``{"runs": {key: {"status": ...}}}`` → rows."""
    doc = spark.read.schema(LEDGER_SCHEMA).option("multiLine", multiline).json(path)
    return doc.select(F.explode(F.coalesce("runs", F.create_map().cast("map<string,struct<status:string>>")))
                      .alias("run_key", "v")).select("run_key", F.col("v.status").alias("status"))


def read_approvals_doc(spark: SparkSession, path: str | list[str], multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """A3: approval/clarification state documents, tolerant of missing keys
    (an absent list reads as empty)."""
    doc = spark.read.schema(APPROVALS_DOC_SCHEMA).option("multiLine", multiline).json(path)
    req_t = doc.schema["requests"].dataType.simpleString()
    clr_t = doc.schema["clarifications"].dataType.simpleString()
    reqs = doc.select(F.inline(F.coalesce("requests", F.array().cast(req_t))))
    clrs = doc.select(F.inline(F.coalesce("clarifications", F.array().cast(clr_t))))
    return reqs, clrs


LOG_PATTERN = r"^(\S+) \| (\w+) \| ([^|]+?) \| (\S+)(.*)$"
KV_PATTERN = r"(\w+)=(\S+)"


def parse_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """`ts | level | logger | event k=v ...` → columns and a k=v map."""
    v = F.col(value)
    ex = lambda i: F.regexp_extract(v, LOG_PATTERN, i)
    keys = F.regexp_extract_all(ex(5), F.lit(KV_PATTERN), 1)
    vals = F.regexp_extract_all(ex(5), F.lit(KV_PATTERN), 2)
    # pairs stay an ordered array: a repeated key must not fail the parse
    pairs = F.zip_with(keys, vals, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    return lines.select(
        "*",
        F.to_timestamp_ntz(ex(1), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("ts"),
        ex(2).alias("level"), ex(3).alias("logger"), ex(4).alias("event"),
        pairs.alias("kv"),
    )


def kv_get(kv, key: str):
    """Value of the last pair with that key (last write wins), or NULL."""
    return F.get(F.reverse(F.transform(F.filter(kv, lambda p: p["k"] == key), lambda p: p["v"])), 0)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files as lines, parsed."""
    return parse_log_lines(spark.read.text(path))


def read_source_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Every file under ``root`` (recursive) as (path, content); files
    that are not valid UTF-8 are skipped."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
           .option("pathGlobFilter", glob).load(root))
    return raw.where(F.is_valid_utf8(F.col("content").cast("string"))) \
        .select(F.col("path"), F.decode("content", "UTF-8").alias("content"))


def read_delimited(spark: SparkSession, path: str, schema: str, stage_dir: str, sep: str = ",",
                   header: bool = False) -> tuple[DataFrame, DataFrame]:
    """Delimited files in PERMISSIVE mode; malformed records go to a
    quarantine frame with their raw text instead of failing the load.

    The parsed rows are landed once into ``stage_dir`` (partitioned by a
    good / bad flag). Writing references every column, so every field is
    parsed and checked; reading the CSV twice with different projections
    would let the scan prune unparsed columns and miss malformed values.
    """
    full = schema + ", _corrupt_record string"
    df = (spark.read.schema(full).option("mode", "PERMISSIVE").option("sep", sep)
          .option("header", header).option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))
    status = F.when(F.col("_corrupt_record").isNull(), F.lit("good")).otherwise(F.lit("bad"))
    df.withColumn("_status", status).write.mode("overwrite").partitionBy("_status").parquet(stage_dir)
    staged = spark.read.parquet(stage_dir)
    good = staged.where(F.col("_status") == "good").drop("_status", "_corrupt_record")
    bad = staged.where(F.col("_status") == "bad").drop("_status")
    return good, bad
