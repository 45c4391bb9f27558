"""As-of join against a plain search."""

import datetime as dt
import random

import pytest

from relaylake.operators import stages
from relaylake.operators.asof import as_of

T0 = dt.datetime(1969, 12, 30)


@pytest.mark.parametrize("seed,span", [(1, 24), (2, 1), (3, 100_000)])
def test_equals_plain_search(spark, seed, span):
    rng = random.Random(seed)
    when = lambda: T0 + dt.timedelta(minutes=rng.randint(0, 6000))
    left = [(i, rng.choice(["a", "b", "hot", "hot", None]), rng.choice([when(), when(), None]), "x") for i in range(150)]
    right = [(rng.choice(["a", "hot", "c", None]), rng.choice([when(), when(), when(), None]), k, rng.choice([None, f"v{k}"]), rng.choice([None, k])) for k in range(80)]
    right += [("hot", T0 + dt.timedelta(minutes=600), 900 + k, f"tie{k}", None) for k in range(3)]
    left += [(500, "hot", T0 + dt.timedelta(minutes=600), "at the same time")]
    a = spark.createDataFrame(left, "id long, k string, at timestamp_ntz, _row string")
    b = spark.createDataFrame(right, "k string, since timestamp_ntz, seq long, v string, w long")
    got = {r.id: (r.v, r.w, r._row) for r in as_of(a, b, ["k"], "at", "since", "seq", ["v", "w"], span).collect()}
    for i, k, at, note in left:
        before = sorted(((s, seq, v, w) for q, s, seq, v, w in right if k is not None and q == k and s and at and s <= at), key=lambda x: x[:2])
        v = next((x[2] for x in reversed(before) if x[2] is not None), None)
        w = next((x[3] for x in reversed(before) if x[3] is not None), None)
        assert got[i] == (v, w, note)
    assert as_of(a, b.limit(0), ["k"], "at", "since", "seq", ["v"]).where("v IS NULL").count() == len(left)
    assert as_of(a.limit(0), b, ["k"], "at", "since", "seq", ["v"]).count() == 0


def test_gates_hold_from_their_time(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    runs = spark.createDataFrame([(1, 2, "qe", a, "succeeded", True, 7, at(h)) for a, h in ((1, 0), (2, 10), (3, 40), (9, 50))],
                                 "work_item_id long, ord int, environment string, attempt int, status string, fix_ok boolean, team long, started_at timestamp_ntz")
    log = spark.createDataFrame([(7, "qe", at(5), 1, (True, "ana", "go"), None), (7, "qe", at(9), 2, None, True), (7, "qe", at(30), 3, (False, "bo", "no"), None),
                                 (7, "stg", at(1), 4, (True, "cy", ""), False)],
                                "team long, environment string, since timestamp_ntz, seq long, decision struct<approved:boolean,actor:string,comment:string>, checks_passed boolean")
    got = {r.attempt: (r.denied, r.qa_passed, r.approver, r.comment) for r in stages.with_gates(runs, log).collect()}
    assert got == {1: (True, False, "system-timeout", ""), 2: (False, True, "ana", "go"), 3: (True, True, "bo", "no")}


def test_attempts_are_numbered_once(spark, tmp_path):
    """The spans of the runs are found without the runs' own sort."""
    from relaylake.plans import q_stages

    spark.createDataFrame([(1, 1, 1, 1, 5.0, 9.0, 0.0, 0.0, "N", "O", T0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, T0, 1, "signup", 1.0, "p")], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .write.parquet(f"{tmp_path}/events.parquet")
    plan = q_stages.gated_runs(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number() windowspecdefinition") == 1
    assert "l_quantity" not in q_stages.outcomes(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
