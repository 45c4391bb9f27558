"""The driver contract: entry(), queries() and oracle_sql()."""

import re

import __spark_entry__ as E
from relaylake.plans import all_queries


def test_contract_shape():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 90
    assert set(o) <= set(q)
    assert all(isinstance(v, str) and v.strip() for v in o.values())
    # the training-data queries are there or not, all others always
    others = {name for name in q if not re.fullmatch(r"op\d+_\w+|pipeline", name)}
    assert others == set(all_queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "work_item_id" in df.columns and "branch_name" in df.columns


def test_small_sf_sample(spark):
    q = E.queries()
    for name in ["plan_full", "stage_summary", "dq_rules", "endpoint_audit", "approval_timeout"]:
        assert q[name](spark, "/root/testdata/sf0.001").count() > 0, name
