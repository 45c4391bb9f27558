"""Sources and sinks: scans, quarantine, overwrite without duplicates, schema evolution."""

import json
import os

from pyspark.sql import functions as F

from relaylake.sinks import bronze
from relaylake.sources import files


def test_csv_quarantine(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as fh:
        fh.write("1,a\nx,b\n3\n")
    good, bad = files.read_delimited(spark, src, "k int, v string", os.path.join(tmp_dir, "stage"))
    assert [(r.k, r.v) for r in good.collect()] == [(1, "a")]
    assert sorted(r._corrupt_record for r in bad.collect()) == ["3", "x,b"]
    assert bad.count() == 2  # counting the quarantine alone works on the landed copy


def test_ticket_array_file_and_missing_path(spark, tmp_dir):
    path = os.path.join(tmp_dir, "tickets.json")
    with open(path, "w") as fh:
        json.dump([{"id": 1, "title": "a", "tags": ["repo:r"]}, {"id": 2, "title": "b", "priority": 3}], fh)
    got = {r.id: r for r in files.read_tickets(spark, path).collect()}
    assert got[1].tags == ["repo:r"] and got[2].priority == 3
    assert files.read_tickets(spark, os.path.join(tmp_dir, "missing.json")).count() == 0


def test_board_payload(spark, tmp_dir):
    path = os.path.join(tmp_dir, "board.json")
    with open(path, "w") as fh:
        json.dump({"count": 2, "value": [
            {"id": 7, "fields": {"System.Id": "7", "System.Title": "t", "System.Tags": " a ; ;repo:x ",
                                 "System.WorkItemType": "Epic"}},
            {"id": 8, "fields": {"System.Id": "8", "Microsoft.VSTS.Common.Priority": "2"}}]}, fh)
    got = {r.id: r for r in files.read_board_payload(spark, path).collect()}
    assert got[7].tags == ["a", "repo:x"] and got[7].priority == 9999 and got[7].title == "t"
    assert got[8].priority == 2 and got[8].state == "Active" and got[8].tags == []


def test_state_documents(spark, tmp_dir):
    p1 = os.path.join(tmp_dir, "ledger.json")
    with open(p1, "w") as fh:
        json.dump({"runs": {"1:abc": {"status": "succeeded"}, "2:def": {"status": "failed"}}}, fh)
    assert sorted((r.run_key, r.status) for r in files.read_ledger_doc(spark, p1).collect()) == [
        ("1:abc", "succeeded"), ("2:def", "failed")]
    p2 = os.path.join(tmp_dir, "approvals.json")
    with open(p2, "w") as fh:
        json.dump({"requests": [{"request_id": "apr-1", "stage": "qe", "status": "pending"}]}, fh)
    reqs, clrs = files.read_approvals_doc(spark, p2)
    assert reqs.first().request_id == "apr-1" and clrs.count() == 0
    p3 = os.path.join(tmp_dir, "history.json")
    with open(p3, "w") as fh:
        json.dump({"records": [{"work_item_id": 5, "status": "succeeded", "source_types": ["jdbc"]}]}, fh)
    assert files.read_history_doc(spark, p3).first().source_types == ["jdbc"]


def test_documents_hold_a_bounded_number_of_entries(spark, monkeypatch):
    from conftest import SF_SMALL
    from relaylake.plans import q_ingest

    made, scratch = {}, q_ingest._scratch
    monkeypatch.setattr(q_ingest, "_scratch", lambda s, name: made.setdefault(name, scratch(s, name)))
    for query, name, field in ((q_ingest.q_history_scan, "history", "records"), (q_ingest.q_ledger_scan, "ledger_docs", "runs"),
                               (q_ingest.q_state_doc_scan, "approval_docs", "requests")):
        made.pop("doc_entries", None)
        rows = query(spark, SF_SMALL, entries=7).count()
        sizes = [len(json.loads(r.value)[field]) for r in spark.read.text(made[name]).collect()]
        assert sum(sizes) == rows > 7 and max(sizes) == 7


def test_log_lines(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:01 | INFO | relay.x | operation_finished name=op_1 duration_seconds=1.250 max_rss_kb=10",),
                                ("2024-01-01T00:00:02 | ERROR | relay.y | operation_retry_failed name=op_1 attempt=3/3 error=boom",)],
                               "value string")
    rows = files.parse_log_lines(df).collect()
    assert rows[0].level == "INFO" and rows[0].event == "operation_finished"
    assert [(p.k, p.v) for p in rows[1].kv] == [("name", "op_1"), ("attempt", "3/3"), ("error", "boom")]
    from relaylake.operators import runlog
    m = runlog.retry_metrics(files.parse_log_lines(df)).first()
    assert (m.name, m.failures, m.exhausted) == ("op_1", 1, 1)


def test_source_files_skip_non_utf8(spark, tmp_dir):
    root = os.path.join(tmp_dir, "repo")
    os.makedirs(os.path.join(root, "etl"))
    with open(os.path.join(root, "etl", "a.py"), "w") as fh:
        fh.write("import os\n")
    with open(os.path.join(root, "etl", "b.py"), "wb") as fh:
        fh.write(b"\xff\xfe\x00bad")
    got = [(os.path.basename(r.path), r.content) for r in files.read_source_files(spark, root, "*.py").collect()]
    assert got == [("a.py", "import os\n")]


def test_overwrite_without_duplicates(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], "k long, v string, part string")
    bronze.write_bronze(base, path, "overwrite", ["part"])
    again = spark.createDataFrame([(1, "a2", "x"), (1, "a2", "x"), (4, "d", "x")], "k long, v string, part string")
    bronze.overwrite_partitions(again, path, ["k"], ["part"])
    got = sorted((r.k, r.v, r.part) for r in spark.read.parquet(path).collect())
    assert got == [(1, "a2", "x"), (3, "c", "y"), (4, "d", "x")]


def test_schema_evolving_append(spark, tmp_dir):
    path = os.path.join(tmp_dir, "e")
    bronze.append_evolving(spark.createDataFrame([(1, "a")], "k long, v string"), path)
    bronze.append_evolving(spark.createDataFrame([(2, "b", 9)], "k long, v string, extra int"), path)
    got = sorted((r.k, r.extra) for r in bronze.read_evolving(spark, path).collect())
    assert got == [(1, None), (2, 9)]
    u = bronze.union_evolving(spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([(2, "z")], "k long, w string"))
    assert sorted((r.k, r.w) for r in u.collect()) == [(1, None), (2, "z")]


def test_bootstrap_is_idempotent(spark, tmp_dir):
    loc = os.path.join(tmp_dir, "tbl")
    for _ in range(2):
        bronze.bootstrap(spark, "relaylake_test_ns", "t", "k long", loc)
    assert spark.catalog.tableExists("relaylake_test_ns.t")
    spark.createDataFrame([(1,)], "k long").write.mode("append").insertInto("relaylake_test_ns.t")
    assert spark.table("relaylake_test_ns.t").agg(F.count("*")).first()[0] == 1
