"""Streaming intake and status polling against their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from relaylake.operators import intake, planning
from relaylake.streaming import intake as SI
from relaylake.streaming import ledger as SL
from relaylake.streaming.keytable import KeyTable
from relaylake.streaming.runner import idempotent_sink, run_available_now


def test_stream_intake_dedupes_and_skips(spark, tmp_dir):
    rows = [(1, "Load main.bronze.a from jdbc", "", "Bug", ["repo:r"], "c", 1, None, "Active"),
            (2, "Load x", "", "Bug", [], "c", 2, None, "Active"),
            (3, "Closed one", "", "Bug", [], "c", 1, None, "Closed")]
    schema = ("id long, title string, description string, item_type string, tags array<string>, "
              "acceptance_criteria string, priority int, repo_name string, state string")
    t = spark.createDataFrame(rows, schema).withColumn("ingested_at", F.current_timestamp())
    t.write.parquet(f"{tmp_dir}/in/a")
    t.write.parquet(f"{tmp_dir}/in/b")  # exact repeats
    key2 = intake.with_run_key(intake.normalize_tickets(t)).where("id = 2").first().run_key
    ledger = spark.createDataFrame([(key2, "succeeded", 1)], "run_key string, status string, seq long")
    done = KeyTable(spark, f"{tmp_dir}/done")
    SI.succeeded_keys(ledger, done)
    src = spark.readStream.schema(t.schema).option("recursiveFileLookup", True).parquet(f"{tmp_dir}/in")
    run_available_now(SI.intake_stream(src), idempotent_sink(f"{tmp_dir}/out", SI.plan_batch(lambda: done)), f"{tmp_dir}/ck")
    out = spark.read.parquet(f"{tmp_dir}/out")
    assert sorted(r.work_item_id for r in out.collect()) == [1]
    batch = planning.with_plan(intake.skip_completed(intake.board_filter(intake.normalize_tickets(t.limit(3))), ledger))
    assert out.select("branch_name").first()[0] == batch.select("branch_name").first()[0]


def test_status_polling(spark, tmp_dir):
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([
        (1, 1, 1, None, "notStarted", t0), (1, 1, 1, None, "inProgress", t0 + dt.timedelta(minutes=1)),
        (1, 1, 1, "failed", "completed", t0 + dt.timedelta(minutes=5)),
        (1, 1, 1, "succeeded", "completed", t0 + dt.timedelta(minutes=9)),     # later result, first one wins
        (2, 1, 1, None, "InProgress", t0)], "work_item_id long, ord int, attempt int, result string, state string, ts timestamp_ntz")
    ev.write.parquet(f"{tmp_dir}/in/a")
    src = spark.readStream.schema(ev.schema).option("recursiveFileLookup", True).parquet(f"{tmp_dir}/in")
    stream = SL.first_terminal_status(src, retention_seconds=3600)
    run_available_now(stream, idempotent_sink(f"{tmp_dir}/out"), f"{tmp_dir}/ck")
    got = {r.work_item_id: r.status for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    assert got == {1: "failed"}  # in the batch that brings the status; run 2 never reached one
    spark.createDataFrame([(3, 1, 1, "succeeded", "completed", t0 + dt.timedelta(days=2))], ev.schema).write.parquet(f"{tmp_dir}/in/b")
    run_available_now(stream, idempotent_sink(f"{tmp_dir}/out"), f"{tmp_dir}/ck")
    state = spark.read.format("statestore").option("path", f"{tmp_dir}/ck").option("stateVarName", "first").load()
    assert state.select("key.work_item_id").distinct().count() == 1  # run 1's state is released
    got = {r.work_item_id: r.status for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    assert got == {1: "failed", 3: "succeeded"}


def test_runs_of_a_ticket_share_a_state(spark, tmp_dir):
    """One state value for a ticket's stages and attempts (F6); an earlier status still revises its run only."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    schema = "work_item_id long, ord int, attempt int, result string, state string, ts timestamp_ntz"
    batches = [[(1, 1, 1, "failed", "completed", at(50)), (1, 2, 1, "succeeded", "completed", at(55)), (1, 1, 2, "failed", "completed", at(58)),
                (1, 1, 99, "failed", "completed", at(59)), (2, 1, 1, None, "inProgress", at(1))],
               [(1, 1, 1, "succeeded", "completed", at(40)), (1, 2, 1, "failed", "completed", at(57))],
               [(3, 1, 1, "succeeded", "completed", at(55 + 60 + 60))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_dir}/in/{i}")
        src = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_dir}/in")
        run_available_now(SL.first_terminal_status(src, retention_seconds=3600 - 120), idempotent_sink(f"{tmp_dir}/out"), f"{tmp_dir}/ck")
        if i == 0:
            state = spark.read.format("statestore").option("path", f"{tmp_dir}/ck").option("stateVarName", "first").load()
            assert state.count() == 2  # attempt 99 is in another block
    out = spark.read.parquet(f"{tmp_dir}/out").collect()
    got = sorted((r.work_item_id, r.ord, r.attempt, r.status, (r.ts.replace(tzinfo=None) - t0).seconds // 60) for r in out)
    assert got == [(1, 1, 1, "failed", 50), (1, 1, 1, "succeeded", 40), (1, 1, 2, "failed", 58), (1, 1, 99, "failed", 59), (1, 2, 1, "succeeded", 55),
                   (3, 1, 1, "succeeded", 175)]
    state = spark.read.format("statestore").option("path", f"{tmp_dir}/ck").option("stateVarName", "first").load()
    left = sorted((k.work_item_id, x.ord, x.attempt) for k, v in state.select("key", "value").collect() for x in v.runs)
    assert left == [(1, 1, 2), (1, 1, 99), (3, 1, 1)]  # a run's state goes when its own time comes


def test_neighbouring_tickets_share_a_state(spark, tmp_dir):
    """One state value for several tickets (F2); the results are those of one each."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    schema = "work_item_id long, ord int, attempt int, result string, state string, ts timestamp_ntz"
    batches = [[(i, 1, 1 + i % 2, "failed", "completed", at(50 + i)) for i in (-3, 0, 1, 2, 5, 9)] + [(None, 1, 1, "failed", "completed", at(50))],
               [(1, 1, 2, "succeeded", "completed", at(40)), (2, 1, 1, "succeeded", "completed", at(58)), (3, 1, 1, "succeeded", "completed", at(41))],
               [(10, 1, 1, "succeeded", "completed", at(55 + 60 + 60))]]
    out = {}
    for tickets, values in ((1, 7), (4, 5)):
        base = f"{tmp_dir}/{tickets}"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{i}")
            src = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/in")
            stream = SL.first_terminal_status(src, retention_seconds=3600 - 120, tickets=tickets)
            run_available_now(stream, idempotent_sink(f"{base}/out"), f"{base}/ck")
            if i == 0:
                state = spark.read.format("statestore").option("path", f"{base}/ck").option("stateVarName", "first").load()
                assert state.count() == values
        left = [x for r in spark.read.format("statestore").option("path", f"{base}/ck").option("stateVarName", "first").load().collect() for x in r.value.runs]
        out[tickets] = [sorted(map(str, spark.read.parquet(f"{base}/out").drop("batch").collect())),
                        sorted((x.work_item_id, x.ord, x.attempt) for x in left)]
    assert out[1] == out[4] and len(out[1][0]) == 10
    assert out[1][1] == [(9, 1, 2), (10, 1, 1)]  # a run's state goes when its own time comes


def test_runs_without_a_number_or_a_time(spark, tmp_dir):
    """Null tickets, stages and times come out as nulls, a time beyond pandas' as it was (F2)."""
    t0, far = dt.datetime(2024, 1, 1), dt.datetime(9000, 1, 1)
    schema = "work_item_id long, ord int, attempt int, result string, state string, ts timestamp_ntz"
    rows = [(None, 1, 1, "a", "completed", t0), (0, 1, 1, "b", "completed", t0), (0, None, 1, "c", "completed", t0), (0, 2, None, "d", "completed", t0),
            (1, 1, 1, "e", "completed", None), (2, 1, 1, "f", "completed", None), (2, 1, 1, "g", "completed", far), (3, 1, 1, None, "inProgress", None),
            ((1 << 62) + 1, 1, 1, "h", "completed", t0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_dir}/in/a")
    src = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_dir}/in")
    run_available_now(SL.first_terminal_status(src, tickets=4), idempotent_sink(f"{tmp_dir}/out"), f"{tmp_dir}/ck")
    got = spark.read.parquet(f"{tmp_dir}/out").select(*SL.RUN, F.col("ts").cast("timestamp_ntz").alias("ts"), "status").collect()
    want = [(w, o, a, ts, result) for w, o, a, result, _, ts in rows if result and result != "f"]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_board_feed_goes_on_behind_its_offset(spark, tmp_dir):
    import json
    import os

    from relaylake.sources.board import board_feed

    def land(date, *ids, more=""):
        os.makedirs(f"{tmp_dir}/in/changed={date}")
        for i in ids:
            with open(f"{tmp_dir}/in/changed={date}/p{i}.json", "w") as out:
                item = {"id": i, "fields": {"System.Id": str(i), "System.Title": f"t{i}", "System.Tags": "a; repo:r ;"}}
                out.write(json.dumps({"count": 1, "value": [item]}) + "\n" + more)

    def poll():
        run_available_now(board_feed(spark, f"{tmp_dir}/in", files_per_task="2"), idempotent_sink(f"{tmp_dir}/out"), f"{tmp_dir}/ck")
        return sorted((r.id, r.changed) for r in spark.read.parquet(f"{tmp_dir}/out").collect())

    land("2024-01-01", 1, 2, 3)
    land("2024-01-02", 4, more="\nnot json\n" + json.dumps({"count": 0}))
    first = [(1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-01-01"), (4, "2024-01-02")]
    assert poll() == first
    with open(f"{tmp_dir}/in/changed=2024-01-01/p1.json", "w") as out:
        out.write("[")  # behind the offset: not opened again
    land("2024-01-03", 1, 9)
    assert poll() == sorted(first + [(1, "2024-01-03"), (9, "2024-01-03")])
    assert poll() == sorted(first + [(1, "2024-01-03"), (9, "2024-01-03")])
