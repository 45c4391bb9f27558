"""Approvals: latest state, guidance, deadlines in batch and as a stream."""

import datetime as dt
import time

import pytest

from relaylake.operators import approvals as A
from relaylake.streaming import approvals as SA
from relaylake.streaming.runner import idempotent_sink, run_available_now

SCHEMA = "request_id string, stage string, event string, actor string, comment string, ts timestamp_ntz, seq long, work_item_id long, summary string"
T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def ev(rid, event, minutes, seq, stage="qe"):
    return (rid, stage, event, "approver-1" if event != "requested" else "agent", "", T0 + dt.timedelta(minutes=minutes), seq, 1, "s")


EVENTS = [
    ev("in-time", "requested", 0, 1), ev("in-time", "approved", 10, 2),
    ev("late", "requested", 0, 3), ev("late", "rejected", 90, 4),          # after the 60 min deadline
    ev("none", "requested", 0, 5),
    ev("before", "approved", -5, 6), ev("before", "requested", 0, 7),     # decision before the request is ignored
    ev("flip", "requested", 0, 8), ev("flip", "approved", 5, 9), ev("flip", "rejected", 20, 10),
    ev("orphan", "approved", 1, 11),
]


def test_timeouts_batch(spark):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    got = {r.request_id: (r.outcome, r.outcome_actor, r.final_status) for r in A.timeout_outcomes(df, 3600).collect()}
    assert got["in-time"] == ("approved", "approver-1", "approved")
    assert got["late"] == ("timed_out", "system-timeout", "rejected")   # late decision overwrites
    assert got["none"] == ("timed_out", "system-timeout", "timed_out")
    assert got["before"] == ("timed_out", "system-timeout", "timed_out")
    assert got["flip"] == ("approved", "approver-1", "rejected")
    assert "orphan" not in got
    ign = {r.request_id: r.final_status for r in A.timeout_outcomes(df, 3600, "ignore").collect()}
    assert ign["late"] == "timed_out"


def test_latest_state_and_guidance(spark):
    df = spark.createDataFrame(EVENTS + [ev("p", "requested", 0, 20, stage=" Prod ")], SCHEMA)
    st = {r.request_id: r.status for r in A.latest_state(df).collect()}
    assert st["flip"] == "rejected" and st["none"] == "pending" and st["before"] == "pending"
    g = {r.request_id: r for r in A.with_guidance(A.pending(A.latest_state(df)), A.guidance_table(spark)).collect()}
    assert g["p"].risk_level == "high" and len(g["p"].checklist) == 3
    assert g["none"].risk_level == "medium" and g["none"].checklist[0].startswith("Validate schema")


def streamed(spark, base, batches, files_per_trigger=1):
    """The stream's current view with one file per list of events, in order."""
    # the last file is a newer event, as a continuous stream has them: the timers fire
    for i, rows in enumerate([*batches, [ev("newer", "comment", 30 * 1440, 99)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/in/{i}")
        time.sleep(0.05)  # files are read in the order of their times
    src = (spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger)
           .parquet(f"{base}/in"))
    out = SA.approval_outcomes(src, 3600, "overwrite", lateness="1 day", retention_seconds=86400)
    run_available_now(out, idempotent_sink(f"{base}/out"), f"{base}/ck")
    view = SA.current_view(spark.read.parquet(f"{base}/out").drop("batch")).collect()
    return {r.request_id: (r.outcome, r.outcome_actor, r.final_status) for r in view}


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1]])
def test_result_does_not_depend_on_micro_batches(spark, tmp_dir, order):
    parts = [
        [ev("first", "approved", 10, 2), ev("late", "requested", 0, 1), ev("late", "approved", 90, 5)],
        [ev("first", "requested", 0, 1), ev("late", "rejected", 30, 4), ev("revised", "requested", 0, 1), ev("revised", "approved", 30, 3)],
        [ev("revised", "rejected", 10, 2), ev("open", "requested", 5, 8), ev("earlier", "requested", 40, 20), ev("earlier", "rejected", 20, 21)],
        [ev("earlier", "requested", 10, 19), ev("none", "approved", 1, 30), ev("open", "comment", 6, 9)],
    ]
    stream = streamed(spark, tmp_dir, [parts[i] for i in order])
    df = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    batch = {r.request_id: (r.outcome, r.outcome_actor, r.final_status) for r in A.timeout_outcomes(df, 3600).collect()}
    assert stream == batch
    assert stream["first"][0] == "approved" and stream["late"] == ("rejected", "approver-1", "approved")
    assert stream["revised"] == ("rejected", "approver-1", "approved") and stream["open"][0] == "timed_out"


def test_stream_twin_equals_batch(spark, tmp_dir):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    stream = streamed(spark, tmp_dir, [EVENTS])
    batch = {r.request_id: (r.outcome, r.outcome_actor, r.final_status) for r in A.timeout_outcomes(df, 3600).collect()}
    assert stream == batch


@pytest.mark.parametrize("late", ["overwrite", "ignore"])
def test_outcome_view_has_every_request(spark, late):
    """Requests still open at the last event are in it too (F7, F8, F9), whatever files the events lie in."""
    from relaylake.plans.q_streaming import outcome_view
    df = spark.createDataFrame(EVENTS + [ev(f"r{i}", e, i + (30 if e != "requested" else 0), 100 + 2 * i + (e != "requested"))
                                         for i in range(40) for e in ("requested", "approved", "comment")], SCHEMA)
    view = outcome_view(spark, "test", df.repartition(5), 3600, late).collect()
    batch = A.timeout_outcomes(df, 3600, late).collect()
    columns = ("request_id", "stage", "outcome", "outcome_actor", "final_status")
    assert sorted(tuple(r[c] for c in columns) for r in view) == sorted(tuple(r[c] for c in columns) for r in batch)


def test_many_decisions_of_one_request(spark, tmp_dir):
    """10^5 decisions in one batch and a few in the next: the list of the
    earlier ones isn't read or written again, the result is the batch twin's."""
    rows = [ev("hot", "requested", 0, 1)] + [ev("hot", "approved" if i % 3 else "rejected", 1 + i % 50, 10 + i) for i in range(100_000)]
    start = time.time()
    first = streamed(spark, f"{tmp_dir}/a", [rows])
    took = time.time() - start
    more = [[ev("hot", "rejected", 55, 200_000 + k)] for k in range(3)]
    start = time.time()
    both = streamed(spark, f"{tmp_dir}/b", [rows, *more])
    assert first["hot"][0] == both["hot"][0] == "rejected" and both["hot"][2] == "rejected"
    assert time.time() - start < 4 * took + 60
    df = spark.createDataFrame([*rows, *(r for m in more for r in m)], SCHEMA)
    r = A.timeout_outcomes(df, 3600).first()
    assert both["hot"] == (r.outcome, r.outcome_actor, r.final_status)


def state(spark, base, name):
    return spark.read.format("statestore").option("path", f"{base}/ck").option("stateVarName", name).load()


def block_stream(spark, base, batches, blocks, lateness, retention):
    """Each list of events a run of its own, as from one checkpoint to the next; the outcomes."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/in/{i}")
        src = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{base}/in")
        out = SA.approval_outcomes(src, 3600, "overwrite", lateness=lateness, retention_seconds=retention, blocks=blocks)
        run_available_now(out, idempotent_sink(f"{base}/out"), f"{base}/ck")
    return {r.request_id: (r.outcome, r.outcome_actor, r.final_status) for r in SA.current_view(spark.read.parquet(f"{base}/out").drop("batch")).collect()}


def test_requests_of_a_block_share_a_state(spark, tmp_dir):
    """One state value for the requests of a block (F3, F4); outcomes are the batch twin's, and all state goes in the end."""
    rows = [ev(f"r{i}", e, (7 * i + 11 * k) % 97, 10 * i + k) for i in range(40) for k, e in enumerate(("approved", "requested", "rejected", "approved"))]
    batches = [rows[1::3], rows[0::3], rows[2::3]]
    got = block_stream(spark, tmp_dir, batches, 3, "1 day", 86400)
    assert state(spark, tmp_dir, "block").count() == 3
    newer = [ev("newer", "comment", 30 * 1440, 999)]
    got = block_stream(spark, f"{tmp_dir}/whole", [*batches, newer], 3, "1 day", 86400)
    df = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    assert got == {r.request_id: (r.outcome, r.outcome_actor, r.final_status) for r in A.timeout_outcomes(df, 3600).collect()}
    assert len(got) == 40 and state(spark, f"{tmp_dir}/whole", "block").count() == state(spark, f"{tmp_dir}/whole", "seen").count() == 0


def test_decisions_of_a_block_that_are_done_with_go(spark, tmp_dir):
    """The list of a block is written anew without those of requests behind the watermark; the others are still read."""
    import pickle
    batches = [[ev("old", "requested", 0, 1)] + [ev("old", "approved", 1 + i % 50, 10 + i) for i in range(100)],
               [ev("new", "rejected", 300, 200)], [ev("new", "requested", 290, 199)], [ev("other", "comment", 3000, 300)]]
    block_stream(spark, tmp_dir, batches[:2], 1, "1 hour", 10 * 86400)
    parts = [pickle.loads(r[0]) for r in state(spark, tmp_dir, "seen").select("list_element.decisions").collect()]
    assert [[x[0] for x in p] for p in parts] == [["new"]]
    got = block_stream(spark, f"{tmp_dir}/whole", batches, 1, "1 hour", 10 * 86400)
    assert got == {"old": ("approved", "approver-1", "approved"), "new": ("rejected", "approver-1", "rejected")}


def test_payload_rules(spark):
    df = spark.createDataFrame([(1, "r", "ab", ""), (2, "r", "x", ""), (3, "r", "ok-name", "c" * 501)],
                               "seq long, request_id string, actor string, comment string")
    got = {r.seq: (r.valid, r.reason) for r in A.validate_decisions(df).collect()}
    assert got == {1: (True, None), 2: (False, "approver length"), 3: (False, "comment length")}
