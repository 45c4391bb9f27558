"""Spark vs DuckDB on sf0.001 for a query from every area (the oracle gate in small)."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from relaylake.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "intake_plan", "intake_two_phase_topk", "queue_head_per_repo", "plan_full", "plan_sources_ranked",
    "learning_cycle", "stage_summary", "stage_details", "remediation_trail", "run_summary_json", "stage_messages",
    "approval_timeout", "approval_gate", "plan_answers", "clarification_comments", "clarification_timeout",
    "dq_rules", "dq_stage_summary", "csv_quarantine_bad", "overwrite_dedup", "ledger_scan",
    "endpoint_audit", "suffix_anti_join", "config_rules", "sql_patch", "remediation_batch",
    "log_metrics", "chat_reply", "resolve_run_names", "stream_approvals",
]
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = df.collect()
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    otypes = {d[0]: str(d[1]).upper() for d in cur.description}
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    for f in df.schema.fields:
        assert TYPES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()) == otypes[f.name], f.name
    order = sorted(df.columns)
    a = sorted((tuple(norm(r[c]) for c in order) for r in rows), key=repr)
    b = sorted((tuple(norm(r[ocols.index(c)]) for c in order) for r in orows), key=repr)
    assert a == b
