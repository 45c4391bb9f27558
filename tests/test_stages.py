"""Stage evaluation: gates, promotion, remediation attempts, stop at first failure."""

from pyspark.sql import functions as F

from relaylake.operators import stages

SCHEMA = "work_item_id long, ord int, environment string, attempt int, status string, qa_passed boolean, fix_ok boolean, denied boolean"


def run(spark, rows):
    out = stages.stage_outcomes(spark.createDataFrame(rows, SCHEMA).withColumn("approver", F.lit("ana")))
    summ = stages.run_summaries(out)
    return ({(r.work_item_id, r.ord): r for r in out.collect()},
            {r.work_item_id: r for r in summ.collect()})


def test_qe_rejection_stops_the_run(spark):
    rows = [(1, 1, "dev", 1, "succeeded", True, False, False),
            (1, 2, "qe", 1, "succeeded", True, False, True),     # gate denied
            (1, 3, "stg", 1, "succeeded", True, False, False),
            (1, 4, "prod", 1, "succeeded", True, False, False)]
    out, summ = run(spark, rows)
    assert out[(1, 1)].stage_status == "succeeded" and out[(1, 1)].gate == "not_required"
    assert out[(1, 2)].stage_status == "failed" and out[(1, 2)].gate == "denied"
    s = summ[1]
    assert s.overall_status == "failed"
    assert [x.environment for x in s.stage_results] == ["dev", "qe"]


def test_fail_fix_succeed(spark):
    rows = [(2, 1, "dev", 1, "failed", True, False, False),
            (2, 1, "dev", 2, "Succeeded", True, True, False)]
    out, summ = run(spark, rows)
    o = out[(2, 1)]
    assert o.stage_status == "succeeded" and o.attempts_used == 1
    assert o.trail == ("attempt=1: status=succeeded; detail=fix applied ; "
                       "attempt=1: pipeline recovered and QA passed")
    assert summ[2].overall_status == "succeeded"


def test_denied_remediation_ends_loop(spark):
    rows = [(3, 1, "dev", 1, "failed", True, False, False),
            (3, 1, "dev", 2, "succeeded", True, True, True),     # remediation approval denied
            (3, 1, "dev", 3, "succeeded", True, True, False)]
    o = run(spark, rows)[0][(3, 1)]
    assert o.stage_status == "failed" and o.attempts_used == 1
    assert o.trail == "attempt=1: remediation approval denied by ana"


def test_failed_fix_uses_an_attempt(spark):
    rows = [(4, 1, "dev", 1, "failed", True, False, False),
            (4, 1, "dev", 2, "succeeded", True, False, False),   # fix failed: no rerun
            (4, 1, "dev", 3, "succeeded", True, True, False),    # second fix works, rerun succeeds
            (4, 1, "dev", 4, "succeeded", True, True, False)]    # beyond the two allowed attempts
    o = run(spark, rows)[0][(4, 1)]
    assert o.stage_status == "succeeded" and o.attempts_used == 2
    assert o.trail.startswith("attempt=1: status=failed; detail=fix failed ; attempt=2: status=succeeded")


def test_attempts_are_capped(spark):
    rows = [(5, 1, "dev", a, "failed", True, True, False) for a in range(1, 6)]
    o = run(spark, rows)[0][(5, 1)]
    assert o.stage_status == "failed" and o.attempts_used == 2


def test_promotion_rule(spark):
    df = spark.createDataFrame([(1, 1, "dev", 1, "Succeeded", True, False, False),
                                (1, 2, "qe", 1, "partiallySucceeded", True, False, False),
                                (1, 3, "stg", 1, "completed", False, False, False)], SCHEMA)
    got = {r.ord: (r.can_promote, r.reason) for r in stages.promotion_decision(df).collect()}
    assert got[1] == (True, "Promotion allowed from dev.")
    assert got[2] == (False, "Promotion blocked at qe: pipeline_status=partiallySucceeded, qa_passed=True.")
    assert got[3][0] is False


def test_stage_cross_is_ordered(spark):
    p = spark.createDataFrame([(1,)], "work_item_id long")
    got = [(r.ord, r.environment) for r in stages.stage_cross(p).orderBy("ord").collect()]
    assert got == [(1, "dev"), (2, "qe"), (3, "stg"), (4, "prod")]


def test_failed_repository_step_ends_the_run_before_its_stages(spark):
    rows = [(1, 1, "dev", 1, "succeeded", True, False, False), (2, 1, "dev", 1, "succeeded", True, False, False)]
    out = stages.stage_outcomes(spark.createDataFrame(rows, SCHEMA).withColumn("approver", F.lit("ana")))
    steps = spark.createDataFrame([(1, "checkout", "succeeded", "x", 1), (1, "tests", "failed", "2 of 9", 3), (1, "change", "Failed", None, 2),
                                   (2, "checkout", "succeeded", "x", 4), (3, "checkout", "failed", "no access", 5)],
                                  "work_item_id long, step string, status string, detail string, seq long")
    got = {r.work_item_id: r for r in stages.run_summaries(out, stages.failed_repositories(steps)).collect()}
    assert (got[1].overall_status, got[1].stage_results, got[1].repository_details) == ("failed", [], "change failed: ")
    assert got[2].overall_status == "succeeded" and got[2].repository_details is None and len(got[2].stage_results) == 1
    assert (got[3].overall_status, got[3].stage_results, got[3].first_failed_ord) == ("failed", [], None)  # no stage row at all
    plain = {r.work_item_id: r.overall_status for r in stages.run_summaries(out, stages.failed_repositories(steps.limit(0))).collect()}
    assert plain == {1: "succeeded", 2: "succeeded"}


def test_rows_of_a_run_are_dealt_once(spark):
    runs = spark.createDataFrame([(1, 1, "dev", a, "failed", False, True, True) for a in (1, 2, 3)] + [(None, 2, "qe", 1, "succeeded", False, True, True)],
                                 "work_item_id long, ord int, environment string, attempt int, status string, denied boolean, fix_ok boolean, qa_passed boolean")
    s = stages.run_summaries(stages.stage_outcomes(runs))
    assert s._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.work_item_id: (r.overall_status, r.first_failed_ord, [x.attempts_used for x in r.stage_results]) for r in s.collect()}
    assert got == {1: ("failed", 1, [2]), None: ("succeeded", None, [0])}


def test_artifacts_share_plans_and_outcomes(spark, monkeypatch):
    from relaylake.plans import q_stages

    calls = []
    real = q_stages.outcomes
    monkeypatch.setattr(q_stages, "outcomes", lambda *a: calls.append(1) or real(*a))
    assert q_stages.q_artifact_store(spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
