"""Intake: normalisation, ranking, repo hints, idempotency keys."""

from pyspark.sql import functions as F

from relaylake.functions import text as T
from relaylake.operators import intake


def tickets(spark, rows):
    schema = "id long, title string, description string, item_type string, tags array<string>, priority int, repo_name string, state string"
    return spark.createDataFrame(rows, schema)


def test_priority_order(spark):
    df = tickets(spark, [(1, "a", "", "Bug", [], 3, None, None), (2, "b", "", "Bug", [], 1, None, None),
                         (3, "c", "", "Bug", [], 2, None, None)])
    got = [r.id for r in intake.top_k(intake.normalize_tickets(df), 10).collect()]
    assert got == [2, 3, 1]


def test_defaults_and_repo_from_tag(spark):
    df = tickets(spark, [
        (1, "a", None, None, ["repo:repo-a"], None, None, None),
        (2, "b", "", "Bug", ["repo: ", "repo:x"], 5, None, None),   # first prefix tag blank → no repo, later not tried
        (3, "c", "", "Bug", ["bronze", " Repo:Svc-1 "], 5, None, None),
        (4, "d", "", "Bug", ["repo:tagged"], 5, "  explicit ", None),  # explicit column wins
        (5, "e", "", "Bug", None, 5, None, "Closed"),
    ])
    rows = {r.id: r for r in intake.normalize_tickets(df).collect()}
    assert rows[1].repo_name == "repo-a" and rows[1].priority == 9999 and rows[1].item_type == "User Story"
    assert rows[1].description == "" and rows[1].state == "Active"
    assert rows[2].repo_name is None
    assert rows[3].repo_name == "Svc-1"
    assert rows[4].repo_name == "explicit"
    assert rows[5].tags == []


def test_unknown_type_fails_on_file_scan(spark):
    df = tickets(spark, [(1, "a", "", "Epic", [], 1, None, None)])
    import pytest
    with pytest.raises(Exception):
        intake.normalize_tickets(df).collect()
    assert intake.normalize_tickets(df, strict_types=False).first().item_type == "User Story"


def test_board_filter(spark):
    df = intake.normalize_tickets(tickets(spark, [(1, "a", "", "Bug", [], 1, None, "Closed"),
                                                  (2, "b", "", "Bug", [], 1, None, "Active")]))
    assert [r.id for r in intake.board_filter(df).collect()] == [2]


def test_run_key_matches_sha256(spark):
    df = spark.createDataFrame([(101, "a", "b"), (102, " a\n", "\tb ")], "id long, title string, description string")
    keys = {r.id: r.k for r in df.select("id", T.run_key(F.col("id"), F.col("title"), F.col("description")).alias("k")).collect()}
    assert keys[101] == "101:aaaa0f56bd4e6203"
    import hashlib
    assert keys[102] == "102:" + hashlib.sha256(b"102|a|b").hexdigest()[:16]


def test_only_succeeded_keys_block(spark):
    t = intake.with_run_key(intake.normalize_tickets(tickets(spark, [
        (1, "a", "", "Bug", [], 1, None, None), (2, "b", "", "Bug", [], 1, None, None), (3, "c", "", "Bug", [], 1, None, None)])))
    keys = {r.id: r.run_key for r in t.collect()}
    ledger = spark.createDataFrame([
        (keys[1], "in_progress", 1), (keys[1], "succeeded", 2),   # done
        (keys[2], "succeeded", 3), (keys[2], "failed", 4),        # last write wins → failed
        (keys[3], "in_progress", 5)], "run_key string, status string, seq long")
    left = sorted(r.id for r in intake.skip_completed(t, ledger).collect())
    assert left == [2, 3]


def test_two_phase_topk(spark):
    df = spark.createDataFrame([(1, 1, "2020-01-01"), (2, 1, "2021-01-01"), (3, 2, "2022-01-01"), (4, 1, "2019-01-01")],
                               "id long, priority int, changed_date string")
    got = [r.id for r in intake.two_phase_top_k(df, 2).collect()]
    assert got == [1, 2]  # chosen by newest date among priority 1, shown by id


def test_queue_head_per_repo(spark):
    df = spark.createDataFrame([(1, 2, "a", "r1"), (2, 1, "b", "r1"), (3, 1, "c", "r2"), (4, 1, "d", "r1")],
                               "id long, priority int, title string, target_repo string")
    got = {r.target_repo: (r.id, r.queue_length) for r in intake.queue_head_per_repo(df).collect()}
    assert got == {"r1": (2, 3), "r2": (3, 1)}
